"""Matches with positions, and the smallest edit that a replacement needs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules.dialect import expand as expand_of
from .rewrite import compiled, find

SCHEMA = "rule_idx int, match_no int, cs int, ce int, matched string, replacement string, edit_cs int, edit_ce int, edit_text string"


def trim_common(matched: str, replacement: str) -> tuple[int, int, str]:
    """(characters kept in front, characters kept behind, what replaces the rest); ends of both that agree stay."""
    m = min(len(matched), len(replacement))
    front = 0
    while front < m and matched[front] == replacement[front]:
        front += 1
    back = 0
    while back < m - front and matched[-1 - back] == replacement[-1 - back]:
        back += 1
    return front, back, replacement[front : len(replacement) - back]


def matches(df: DataFrame, rules, id_col: str, text_col: str = "text") -> DataFrame:
    """A row for each match of each text rule; a rule's matches are those in what the rules before it left."""
    rules = compiled(rules)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [(i, r.text.compiled(), r.template(r.text)) for i, r in enumerate(rules) if r.on_text]
        for batch in batches:
            rows: list[tuple] = []
            owner = []
            for at, text in enumerate(batch.column(1).to_pylist()):
                for i, pattern, parts in patterns if text is not None else ():
                    pieces, last = [], 0
                    for no, m in enumerate(find(pattern, text, False)):
                        new = expand_of(parts, m)
                        front, back, rest = trim_common(m[0], new)
                        rows.append((i, no, m.start(), m.end(), m[0], new, m.start() + front, m.end() - back, rest))
                        owner.append(at)
                        pieces += [text[last : m.start()], new]
                        last = m.end()
                    text = "".join(pieces) + text[last:]
            kinds = [pa.int32()] * 4 + [pa.string()] * 2 + [pa.int32()] * 2 + [pa.string()]
            columns = [pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns], [id_col, *(f.split()[0] for f in SCHEMA.split(", "))])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {SCHEMA}")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, as an expression."""
    sizes = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.array_max(F.filter(sizes, lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)))


def minimal_edit(df: DataFrame, old: str, new: str) -> DataFrame:
    """Adds keep_front, keep_back and edit_text for pairs of strings, with built-in functions only."""
    df = df.withColumn("keep_front", common_prefix(F.col(old), F.col(new)))
    rest = lambda c: F.reverse(F.substr(F.col(c), F.col("keep_front") + 1))
    df = df.withColumn("keep_back", common_prefix(rest(old), rest(new)))
    return df.withColumn("edit_text", F.substring(F.col(new), F.col("keep_front") + 1, F.length(new) - F.col("keep_front") - F.col("keep_back")))
