"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, mixing, pii
from .common import table


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multi_index import search

    return search(table(spark, sf_dir, "embeddings"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_digest

    return shard_digest(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(table(spark, sf_dir, "conversations"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import kept

    return kept(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_digest

    return line_digest(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .class_lm import score

    return score(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_digest

    return mix_digest(table(spark, sf_dir, "documents"))


#: Links by counting the shingles that two documents share, components by walking the links.
COMPONENTS_SQL = r"""
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) END AS s FROM words
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM shingles),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (SELECT a AS root, a AS x FROM links UNION SELECT root, b FROM reach JOIN links ON a = x),
least_ AS (SELECT root, min(x) AS least_id FROM reach GROUP BY root)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(least_id, doc_id) AS component_id FROM shingles LEFT JOIN least_ ON root = doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multi_index": op1_multi_index,
    "op2_sharding": op2_sharding,
    "op3_decontamination": op3_decontamination,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_pii": op7_pii,
    "op8_class_lm": op8_class_lm,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_mixing": op10_mixing,
}
ORACLE_SQL: dict[str, str] = {
    "op4_chat_formatting": chat.ORACLE_SQL,
    "op7_pii": pii.ORACLE_SQL,
    "op9_ngram_jaccard": COMPONENTS_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
}
