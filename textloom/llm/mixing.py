"""Mixing sources to target weights along a low-discrepancy schedule, with built-in functions only.

Targets: the budget (``share`` of all words) is dealt out by weight; no source gets more than ``most``
times its size, and what it leaves is dealt out again by weight until none is above. In closed form:
sources are filled up in order of cap/weight for as long as the level reached covers their cap.

Schedule: slot i looks up the point ``i * g mod 2**32`` (g: 2**32 over the golden ratio, to the nearest odd integer) in the
cumulated targets, which gives its source; slots of a source are ranked in order. The words of a source,
documents in a shuffled order (md5 of seed, id and text's md5), form a cycle that is cut into equal blocks of
``block`` words; the slot of rank r takes block r. A source's last slot takes only what is left of
its target, slots beyond it are dropped, and ones the schedule lacks follow at its end; so every source's
words match its rounded target, and all prefixes of the mix are balanced. All sums and ranks run in
hash or index ranges of bounded size, never over a whole source.

Null text: size 0, never taken. Null source: a source of its own, after all others. Null and repeated ids:
every row counts by itself. Empty tables give no rows. The number of sources (not of documents) must fit one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: 2**32 over the golden ratio.
GOLDEN = 2654435769
WEIGHTS = (3, 1, 2)
#: Documents are summed up in shuffle ranges of about so many, slots in index ranges of exactly so many.
RANGE_DOCS, RANGE_SLOTS = 2_000, 4_096
#: Words in a block.
BLOCK = 1_024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, rk, source_size, target, quota) from rows of (source, size)."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("rk", F.row_number().over(by_name) - 1)
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rk") % len(weights) + 1).cast("int")).cast("double")).withColumn("cap", F.lit(most) * F.col("source_size"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), "rk")
    before, rest, everyone = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    src = src.withColumn("budget", F.lit(share) * F.sum("source_size").over(everyone))
    src = src.withColumn("full", F.col("cap") / F.col("weight") <= (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everyone)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everyone), F.lit(0.0))
    src = src.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * left / open_weight))
    return src.select("source", "rk", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("quota"))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """(position, rk, rank, words): the slots of the mix in order."""
    spark = sources.sparkSession
    got = sources.select("rk", "quota", F.ceil(F.col("quota") / block).cast("long").alias("slots")).orderBy("rk").collect()
    ends, total = [], 0
    for r in got:
        total += r["slots"]
        ends.append(total)
    slots = spark.range(total).withColumn("at", F.expr(f"(((id * {GOLDEN}L) & 4294967295L) * {total}L) >> 32" if total < 1 << 31 else f"cast(((id * {GOLDEN}L) & 4294967295L) * ({total} / 4294967296.0D) as long)"))
    before = F.array(*[F.lit(e).cast("long") for e in ends])
    slots = slots.withColumn("rk", F.size(F.filter(before, lambda e: e <= F.col("at"))))
    chunk = F.expr(f"id div {RANGE_SLOTS}")
    slots = cut(slots.select("id", "rk", chunk.alias("chunk")))
    counts = slots.groupBy("rk", "chunk").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("rk").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = slots.withColumn("in", F.row_number().over(Window.partitionBy("rk", "chunk").orderBy("id")) - 1).join(counts, ["rk", "chunk"])
    ranked = ranked.select(F.col("id").alias("position"), "rk", (F.col("in") + F.col("first")).alias("rank"))
    have = counts.groupBy("rk").agg(F.sum("n").alias("have"))
    wanted = sources.select("rk", "quota", F.ceil(F.col("quota") / block).cast("long").alias("slots"))
    late = wanted.join(have, "rk", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < slots")
    late = late.select((F.lit(total) + F.col("have")).alias("position"), "rk", F.explode(F.expr("sequence(have, slots - 1)")).alias("rank"))
    late = late.withColumn("position", F.lit(total) + F.col("rank"))
    return ranked.union(late).join(wanted, "rk").where("rank < slots").select("position", "rk", "rank", F.least(F.lit(block).cast("long"), F.col("quota") - F.col("rank") * block).alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents, entries). documents: row, doc_id, size, source, source_size, target (and ``keep``); entries:
    (position, row, start, words): so many words of a document, from word ``start`` on, at a position of the mix."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.md5(F.coalesce(text_col, F.lit(""))).alias("digest"), *keep)
    own = cut(own.withColumn("key", F.expr(f"cast(conv(substring(md5(concat({seed}, ':', coalesce(cast(doc_id as string), ''), ':', digest)), 1, 10), 16, 10) as long)")).drop("digest"))
    targets = cut(source_targets(own, weights, share, most))
    bits = min(24, max(0, (own.count() // RANGE_DOCS).bit_length()))
    names = targets.select(F.col("source").alias("_source"), "rk", "source_size", "target", "quota")
    own = own.join(names, own["source"].eqNullSafe(names["_source"])).drop("_source").withColumn("range", F.expr(f"key >> {40 - bits}"))
    # where a document starts in the cycle of its source: ranges first, then within the range
    ranges = own.groupBy("rk", "range").agg(F.sum("size").alias("n"))
    ranges = ranges.select("rk", "range", F.coalesce(F.sum("n").over(Window.partitionBy("rk").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    within = Window.partitionBy("rk", "range").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("in", F.coalesce(F.sum("size").over(within), F.lit(0))).join(ranges, ["rk", "range"])
    placed = cut(placed.withColumn("start", F.col("in") + F.col("first")).drop("in", "first", "range", "key"))
    # the stretch of each pass over the cycle that the target covers, cut at block borders
    passes = placed.where("size > 0").withColumn("pass", F.explode(F.expr(f"sequence(0, {int(most) + 1})")))
    passes = passes.withColumn("lo", F.expr("start + pass * source_size")).withColumn("hi", F.expr("least(lo + size, quota)")).where("lo < hi")
    parts = passes.select("row", "rk", "lo", "hi", F.explode(F.expr(f"sequence(lo div {block}, (hi - 1) div {block})")).alias("rank"))
    parts = parts.select("row", "rk", "rank", F.expr(f"greatest(lo, rank * {block}) - lo").alias("start"), F.expr(f"least(hi, (rank + 1) * {block}) - greatest(lo, rank * {block})").alias("words"))
    entries = parts.join(schedule(targets, block).select("position", "rk", "rank"), ["rk", "rank"]).select("position", "row", "start", "words")
    return placed.drop("rk", "quota", "start"), entries


def mix_digest(docs: DataFrame) -> DataFrame:
    """What the mix takes of every document, and the position at which it first does (-1: never)."""
    placed, entries = mix(docs)
    taken = entries.groupBy("row").agg(F.sum("words").alias("taken"), F.min("position").alias("first_position"))
    return placed.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("first_position", F.lit(-1)).cast("long").alias("first_position"))


#: The digest in SQL: whole passes and the rest of each source's target over its documents in shuffled order; slots by the golden ratio.
ORACLE_SQL = rf"""
WITH own AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 10))::BIGINT AS key FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM own GROUP BY source),
ranked AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS rk, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM src),
level AS (SELECT *, cap / weight <= (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled FROM ranked),
goal AS (SELECT source, rk, source_size, CASE WHEN filled THEN cap ELSE weight * (budget - coalesce(sum(CASE WHEN filled THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT filled THEN weight END) OVER () END AS target FROM level),
quotas AS (SELECT *, floor(target + 0.5)::BIGINT AS quota, ((floor(target + 0.5)::BIGINT + {BLOCK - 1}) // {BLOCK})::BIGINT AS slots FROM goal),
ends AS (SELECT rk, slots, sum(slots) OVER (ORDER BY rk)::BIGINT AS stop, sum(slots) OVER ()::BIGINT AS total FROM quotas),
points AS (SELECT i, ((((i * {GOLDEN}) & 4294967295) * total) >> 32)::BIGINT AS spot, total FROM (SELECT unnest(range(total)) AS i, total FROM (SELECT DISTINCT total FROM ends))),
slot AS (SELECT i AS position, rk, row_number() OVER (PARTITION BY rk ORDER BY i) - 1 AS rank FROM points JOIN ends ON spot >= stop - slots AND spot < stop),
late AS (SELECT e.total + r.rank AS position, e.rk, r.rank FROM ends e, LATERAL (SELECT unnest(range(e.slots)) AS rank) r WHERE r.rank >= (SELECT count(*) FROM slot WHERE slot.rk = e.rk)),
slots AS (SELECT position, rk, rank FROM slot UNION ALL SELECT position, rk, rank FROM late),
placed AS (SELECT doc_id, size, source_size, target, quota, rk, coalesce(sum(size) OVER (PARTITION BY own.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM own JOIN quotas ON own.source IS NOT DISTINCT FROM quotas.source),
took AS (SELECT *, (CASE WHEN source_size = 0 THEN 0 ELSE quota // source_size * size + least(greatest(quota % source_size - start, 0), size) END)::BIGINT AS taken FROM placed)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN position ELSE -1 END::BIGINT AS first_position FROM took LEFT JOIN slots ON slots.rk = took.rk AND slots.rank = start // {BLOCK}
"""
