"""Rules applied to columns: one projection, no shuffle. Each rule reads what the one before it wrote.

Patterns that always match something run as built-in expressions; only a pattern that can match nothing goes
through an Arrow function, because the text rules ignore empty matches and Java's find() reports others.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..rules.dialect import Pattern, Rule, compile_rules, expand, java_template
from ..rules.spec import RuleSpec, load_rules


def compiled(rules) -> list[Rule]:
    return [r for r in rules] if rules and isinstance(rules[0], Rule) else compile_rules(load_rules(rules))


def find(pattern, text: str, empty: bool):
    """Leftmost matches that don't overlap; an empty one right after another match is none."""
    at = 0
    for m in pattern.finditer(text):
        if m.end() > m.start() or (empty and not (m.start() == at and at)):
            yield m
        at = m.end() if m.end() > m.start() else at


def _replaced(pattern: Pattern, parts: list, empty: bool):
    @pandas_udf("struct<n:bigint,out:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        compiled_ = pattern.compiled()
        counts, outs = [], []
        for t in texts:
            if t is None:
                counts.append(None), outs.append(None)
                continue
            at, pieces, n = 0, [], 0
            for m in find(compiled_, t, empty):
                pieces += [t[at : m.start()], expand(parts, m)]
                at, n = m.end(), n + 1
            counts.append(n), outs.append("".join(pieces) + t[at:])
        return pd.DataFrame({"n": pd.Series(counts, dtype="Int64"), "out": outs})

    return run


def apply_rule(text: Column, rule: Rule, links: bool = False) -> tuple[Column, Column]:
    """(matches, new text) of one rule on a column."""
    pattern = rule.link if links else rule.text
    parts = rule.template(pattern)
    if pattern.may_be_empty:
        both = _replaced(pattern, parts, links)(text)
        return both["n"], both["out"]
    n = F.regexp_count(text, F.lit(pattern.java)).cast("long")
    return n, F.regexp_replace(text, F.lit(pattern.java), F.lit(java_template(parts)))


def on_pages(rule: Rule, page: Column | None) -> Column:
    if rule.pages is None or page is None:
        return F.lit(True)
    hit = F.lit(False)
    for lo, hi in rule.pages:
        hit = hit | page.between(lo, hi)
    return F.coalesce(hit, F.lit(False))


def rewrite(df: DataFrame, rules, text_col: str = "text", page_col: str | None = None, out: str = "new_text", links: bool = False) -> DataFrame:
    """Adds ``out``, ``changed`` and ``hits`` (matches by rule). Page ranges bind text rules only."""
    rules = compiled(rules)
    step = "_step"
    df = df.withColumn(step, F.col(text_col))
    names = []
    for i, rule in enumerate(rules):
        name = f"_hits_{i}"
        names.append(name)
        if not (rule.on_links if links else rule.on_text):
            df = df.withColumn(name, F.lit(0).cast("long"))
            continue
        here = on_pages(rule, F.col(page_col) if page_col and not links else None)
        n, new = apply_rule(F.col(step), rule, links)
        df = df.withColumns({name: F.when(here, F.coalesce(n, F.lit(0))).otherwise(0).cast("long"), step: F.when(here, new).otherwise(F.col(step))})
    hits = F.array(*[F.col(n) for n in names]) if names else F.array().cast("array<bigint>")
    df = df.withColumns({out: F.col(step), "changed": ~F.col(step).eqNullSafe(F.col(text_col)), "hits": hits})
    return df.drop(step, *names)


def rewrite_links(df: DataFrame, rules, uri_col: str = "uri", out: str = "new_uri") -> DataFrame:
    return rewrite(df, rules, uri_col, None, out, links=True)


def rule_stats(rewritten: DataFrame) -> DataFrame:
    """(rule_idx, matches, rows): totals by rule of a rewritten table."""
    each = rewritten.select(F.posexplode("hits").alias("rule_idx", "n"))
    return each.groupBy("rule_idx").agg(F.sum("n").alias("matches"), F.count_if(F.col("n") > 0).alias("rows"))


def extract_links(df: DataFrame, html_col: str, keep: list[str]) -> DataFrame:
    """(keep..., ord, uri): link targets of an HTML column in order."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(r'href="([^"]*)"'), F.lit(1))
    return df.select(*keep, F.posexplode(found).alias("ord", "uri"))


@dataclass(frozen=True)
class Outcome:
    """What a run returns: the rewritten rows, the totals by rule, and an exit status (0 fine, 2 strict and skipped)."""

    rows: DataFrame
    stats: list[tuple[int, int, int]]
    status: int


def run(df: DataFrame, rules, text_col: str = "text", page_col: str | None = None, dry_run: bool = False, strict: bool = False, skipped_col: str | None = None, sink=None) -> Outcome:
    """Rewrites, counts, and hands the rows to ``sink`` unless this is a dry run or a strict one that skipped matches."""
    rows = rewrite(df, rules, text_col, page_col)
    stats = [tuple(r) for r in rule_stats(rows).orderBy("rule_idx").collect()]
    bad = strict and skipped_col is not None and not rows.where(F.size(skipped_col) > 0).isEmpty()
    if sink is not None and not dry_run and not bad:
        sink(rows)
    return Outcome(rows, stats, 2 if bad else 0)


__all__ = ["Outcome", "RuleSpec", "apply_rule", "compiled", "extract_links", "find", "on_pages", "rewrite", "rewrite_links", "rule_stats", "run"]
