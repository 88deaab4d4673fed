"""A corpus pipeline over ``documents``: quality, near duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the
last return the columns of ``documents``. SQL can't express the classifier, so there is no oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import cut
from textloom.llm.decontaminate import without_leaks
from textloom.llm.jaccard_join import drop_near_copies
from textloom.llm.mixing import mix
from textloom.llm.quality import THRESHOLD, fit, scored
from textloom.llm.sharding import shard_digest

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A word with the white space before it, matched without backtracking.
_WORD_AND_GAP = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, fit(docs, labels), threshold=THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, the one of the least id stays, every row counting by itself."""
    return drop_near_copies(docs.select(*COLUMNS), k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them whole, and the first words of those that it takes in part."""
    docs = docs.select(*COLUMNS).withColumn("_print", F.xxhash64("text", "source"))
    placed, entries = mix(docs, keep=("_print",))
    taken = placed.join(entries.groupBy("row").agg(F.sum("words").alias("taken")), "row")
    # rows that agree in id, text and source share what is taken of them
    taken = taken.groupBy("doc_id", "_print").agg(F.max("size").alias("_size"), F.array_sort(F.collect_list("taken")).alias("_taken"))
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("_print").alias("_p"), "_size", "_taken")
    both = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_p")))
    both = both.withColumn("_take", F.element_at("_taken", F.lit(-1)))
    copies = F.transform(F.sequence(F.lit(0).cast("long"), F.expr("(_take + _size - 1) div _size - 1")), lambda i: F.least(F.col("_size"), F.col("_take") - i * F.col("_size")))
    both = both.withColumn("_words", F.explode(copies))
    part = F.expr(f"regexp_extract(text, concat('^(?:{_sql(_WORD_AND_GAP)}){{', cast(_words as string), '}}+'), 0)")
    whole = F.col("_words") == F.col("_size")
    both = both.withColumn("text", F.when(whole, F.col("text")).otherwise(part)).withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return both.select(*COLUMNS)


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mix gets a shard and a slot in it."""
    return shard_digest(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
