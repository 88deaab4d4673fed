"""Sharding documents by multi-way differencing (Karmarkar-Karp), law ``bytes``.

Equal texts form a group that no shard border cuts (null texts are one group, empty ones another). A
partial partition is a vector of k sums; again and again the two with the largest spread become one, the
largest sum of either with the smallest of the other. What is differenced are units: every group of more than 1 / ``UNITS`` of
all bytes by itself, and all smaller ones together in ``UNITS`` hash buckets, since they are too small to matter one by one. So there
are at most twice ``UNITS`` sums, whatever the size of the table, on the driver. Rows find their shard by two broadcast joins
of as many entries and are not shuffled by group; a very common text is no hot key. Numbering rows within a shard goes by ranges.

Null ids, repeated rows and extra columns: every row gets a shard and a slot. Very long texts are groups like
others; one larger than a fair share has a shard of its own. Ties keep the order of buckets and hashes. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered

SHARDS = 24
#: Hash buckets of small groups, and as many large groups at most.
UNITS = 8_192


def differencing(vectors: Sequence[Sequence[int]], k: int) -> list[list[int]]:
    """For each vector of up to k sums: the part (0 to k-1) that each of its entries goes to. Ties keep
    the order given, so the result is reproducible."""
    nodes: list[tuple] = []  # (left, right, order) or None for a leaf; slots of a node run from its largest sum down
    heap = []
    leaf_order = []
    for i, v in enumerate(vectors):
        order = sorted(range(len(v)), key=lambda j: -v[j])
        sums = [v[j] for j in order] + [0] * (k - len(v))
        leaf_order.append(order)
        nodes.append(None)
        heap.append((sums[-1] - sums[0], i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        both = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(k), key=both.__getitem__, reverse=True)
        sums = [both[j] for j in order]
        nodes.append((a, b, order))
        heapq.heappush(heap, (sums[-1] - sums[0], len(nodes) - 1, sums))
    out: list[list[int]] = [[] for _ in vectors]
    stack = [(len(nodes) - 1, list(range(k)))] if nodes else []
    while stack:
        n, part = stack.pop()
        if nodes[n] is None:
            places = [0] * len(leaf_order[n])
            for slot, j in enumerate(leaf_order[n]):
                places[j] = part[slot]
            out[n] = places
            continue
        a, b, order = nodes[n]
        left, right = [0] * k, [0] * k
        for slot, j in enumerate(order):
            left[j] = right[k - 1 - j] = part[slot]
        stack += [(a, left), (b, right)]
    return out


def shard(docs: DataFrame, k: int = SHARDS, units: int = UNITS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) and the columns ``keep``."""
    spark, text = docs.sparkSession, F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("_group"),
        *keep,
    )
    rows = cut(rows)
    groups = cut(rows.groupBy("_group").agg(F.sum("size").alias("bytes")))
    bucket = F.pmod(F.xxhash64("_group"), F.lit(units)).cast("int")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    large = groups.where(F.col("bytes") * units > total).orderBy("_group").collect()
    small = groups.where(F.col("bytes") * units <= total).groupBy(bucket.alias("bucket")).agg(F.sum("bytes").alias("bytes")).orderBy("bucket").collect()
    to = [p[0] for p in differencing([[r["bytes"]] for r in [*large, *small]], k)]
    own = spark.createDataFrame([(r["_group"], s) for r, s in zip(large, to, strict=False)], "_group binary, _own int")
    shared = spark.createDataFrame([(r["bucket"], s) for r, s in zip(small, to[len(large) :], strict=True)], "_bucket int, _shared int")
    rows = rows.withColumn("_bucket", bucket).join(F.broadcast(own), "_group", "left").join(F.broadcast(shared), "_bucket", "left")
    rows = cut(rows.withColumn("shard", F.coalesce("_own", "_shared")).drop("_group", "_bucket", "_own", "_shared"))
    return numbered(rows, ["shard"], [F.col("doc_id"), F.col("size"), F.col("text_crc32")], rows.count(), k, "slot")


def shard_digest(docs: DataFrame, k: int = SHARDS) -> DataFrame:
    out = shard(docs, k)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
