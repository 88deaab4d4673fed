"""PDF files as tables. A file is one row and one unit of parallelism; its bytes never meet another file's.

All functions keep going when a file can't be read: the row says why in ``error``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rewrite import compiled
from ..pdf.engine import Engine, Options

#: Files in one Arrow batch.
BATCH = 16


def read_pdf(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, content) of the files at a path that Spark can read."""
    out = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", recursive).load(path)
    return out.select("path", "content")


def _map(df: DataFrame, path: str, content: str, schema: str, work) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    spark = df.sparkSession
    fields = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                rows = []
                for p, c in zip(batch.column(0).slice(at, BATCH).to_pylist(), batch.column(1).slice(at, BATCH).to_pylist(), strict=True):
                    try:
                        rows += [(p, *r, None) for r in work(c or b"")]
                    except Exception as e:  # a damaged file must not end the job
                        rows.append((p, *[None] * (len(names) - 2), str(e) or type(e).__name__))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    return df.select(F.col(path).cast("string"), content).mapInArrow(run, schema)


def extract_text(df: DataFrame, path: str = "path", content: str = "content", password: str | None = None) -> DataFrame:
    """(path, page, unit, label, text, error): a row for each content unit, in drawing order."""
    return _map(df, path, content, "path string, page int, unit int, label string, text string, error string", lambda c: [(p, i, label, t) for i, (p, label, t) in enumerate(Engine(c, password).text())])


def extract_links(df: DataFrame, path: str = "path", content: str = "content", password: str | None = None) -> DataFrame:
    """(path, page, ord, uri, error): page is null for links that hang on no page."""
    return _map(df, path, content, "path string, page int, ord int, uri string, error string", lambda c: Engine(c, password).links())


def extract_alternates(df: DataFrame, path: str = "path", content: str = "content", password: str | None = None) -> DataFrame:
    """(path, page, text, error): replacement texts of marked content, in order."""
    return _map(df, path, content, "path string, page int, text string, error string", lambda c: Engine(c, password).alternates())


def rewrite_pdf(df: DataFrame, rules, path: str = "path", content: str = "content", password: str | None = None, options: Options = Options()) -> DataFrame:
    """(path, content, changed, stats, warnings, error): the new file and what each rule did to it."""
    rules = compiled(rules)
    stat = "struct<text:bigint,links:bigint,fallback:bigint,condensed:bigint,actual_text:bigint,skipped:array<string>>"

    def work(data: bytes):
        engine = Engine(data, password, options)
        new, stats = engine.rewrite(rules)
        return [(new, new != data, [asdict(s) for s in stats], engine.warnings)]

    return _map(df, path, content, f"path string, content binary, changed boolean, stats array<{stat}>, warnings array<string>, error string", work)


def rule_stats(rewritten: DataFrame) -> DataFrame:
    """Totals by rule over all files."""
    each = rewritten.where("error is null").select(F.posexplode("stats").alias("rule_idx", "s"))
    sums = [F.sum(f"s.{c}").alias(c) for c in ("text", "links", "fallback", "condensed", "actual_text")]
    return each.groupBy("rule_idx").agg(*sums, F.sum(F.size("s.skipped")).alias("skipped"))


def write_pdf(rewritten: DataFrame, folder: str, strict: bool = False) -> int:
    """Writes every readable file into ``folder`` (one that all executors share) under its own name; returns how many.

    A strict run writes nothing if any match was skipped or any file failed. Nor does any run if two files have one name."""
    if strict and not rewritten.where("error is not null or exists(stats, s -> size(s.skipped) > 0)").isEmpty():
        raise ValueError("some matches or files were skipped; nothing was written")
    fine = rewritten.where("error is null").select("path", "content")
    twice = fine.groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several files are called {twice[0]['name']}; nothing was written")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        n = 0
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = os.path.join(folder, os.path.basename(p))
                with open(f"{name}.part{os.getpid()}", "wb") as f:
                    f.write(c)
                os.replace(f.name, name)  # a task that runs twice leaves one whole file
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return fine.mapInArrow(save, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
