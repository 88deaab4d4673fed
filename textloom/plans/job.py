"""One job as a user asks for it: rules and options, checked before anything is read; then extraction, a report or rewriting."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rewrite import compiled
from ..pdf.engine import Options
from ..rules.spec import literal, load_rules
from ..sources import pdf

FONTS = {"auto": "auto", "none": "none", "helvetica": "sans", "times": "serif", "courier": "mono"}


class JobError(ValueError):
    """A job that can't run as asked."""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("textloom", description="Replaces text and links in PDF files.")
    p.add_argument("-i", "--input", required=True, help="a file or folder that Spark can read")
    p.add_argument("-o", "--output", help="a folder that all executors share")
    p.add_argument("-c", "--config", help="a rule script (JSON)")
    p.add_argument("-r", "--replace", nargs=2, action="append", default=[], metavar=("OLD", "NEW"))
    p.add_argument("-p", "--password")
    p.add_argument("--fallback-font", choices=sorted(FONTS), default="auto")
    p.add_argument("--fit", choices=("auto", "strict", "none"), default="auto")
    p.add_argument("--compression", choices=("max", "best", "fast"), default="best")
    for flag in ("allow-growth", "dry-run", "dump-text", "strict", "quiet", "rewrite-all"):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def dump(files: DataFrame, password: str | None) -> DataFrame:
    """(path, page, kind, n, line): text by page, then its links; links that hang on no page come last."""
    text = pdf.extract_text(files, password=password).select("path", "page", F.lit("text").alias("kind"), F.col("unit").alias("n"), F.coalesce("text", "error").alias("line"))
    links = pdf.extract_links(files, password=password).where("error is null").select("path", "page", F.lit("url").alias("kind"), F.col("ord").alias("n"), F.col("uri").alias("line"))
    return text.union(links).orderBy("path", F.col("page").asc_nulls_last(), "kind", "n")


def run(spark: SparkSession, argv: Sequence[str], say=print) -> int:
    """0: done. 1: the job or a file failed. 2: strict, and matches were skipped; nothing was written."""
    a = parser().parse_args(argv)
    try:
        rules = load_rules(Path(a.config).read_text()) if a.config else []
        rules = compiled(rules + [literal(*r) for r in a.replace])
        if not rules and not a.dump_text:
            raise JobError("no rules: give a script or replacements")
        if not a.dump_text and not a.dry_run and not a.output:
            raise JobError("no output folder")
    except (ValueError, OSError) as e:
        say(f"error: {e}")
        return 1
    files = pdf.read_pdf(spark, a.input)
    if a.dump_text:
        for r in dump(files, a.password).toLocalIterator():
            say(f"===== {r['path']} page {r['page']} {r['kind']} =====\n{r['line']}")
        return 0
    options = Options(FONTS[a.fallback_font], a.fit, a.compression, a.allow_growth, not a.rewrite_all)
    out = pdf.rewrite_pdf(files, rules, password=a.password, options=options).persist()
    try:
        for r in out.where("error is not null").select("path", "error").toLocalIterator():
            say(f"{r['path']}: {r['error']}")
        failed = not out.where("error is not null").isEmpty()
        for r in out.where("error is null").select("path", F.explode(F.flatten("stats.skipped")).alias("why")).toLocalIterator():
            say(f"{r['path']}: {r['why']}")
        stats = pdf.rule_stats(out).orderBy("rule_idx").collect()
        for r in stats if not a.quiet else ():
            what = rules[r["rule_idx"]].spec.search
            say(f"rule {r['rule_idx'] + 1} ({what}): {r['text']} in text, {r['links']} in links, {r['fallback']} using a fallback font, {r['condensed']} condensed, {r['actual_text']} in replacement texts, {r['skipped']} skipped")
        if a.strict and any(r["skipped"] for r in stats):
            return 2
        if a.dry_run:
            say("dry run: nothing written")
        else:
            n = pdf.write_pdf(out, a.output)
            size = out.where("error is null").join(files.withColumnRenamed("content", "old"), "path").agg(F.sum(F.octet_length("old")), F.sum(F.octet_length("content"))).first()
            say(f"{n} files written, {size[1] or 0} bytes ({(size[1] or 0) - (size[0] or 0):+d})")
        return int(failed)
    finally:
        out.unpersist()


def main() -> None:
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    sys.exit(run(spark, sys.argv[1:]))
