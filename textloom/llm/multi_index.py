"""Approximate nearest neighbours with an inverted multi-index.

Each vector is cut into two halves, each half goes to its nearest of K centroids, and the pair is the
vector's cell. A query walks the pairs of centroids in order of their summed distance, with a heap over two
sorted lists, until the cells walked hold a share of all rows; every vector in them is scored again with
the exact inner product on the original values, in double precision, and the best stay.

The codebooks are fitted on a bounded sample (``SAMPLE`` rows, least hash of the id first); every row is indexed.
K, the share, and whether cells are walked by Euclidean distance or by inner product, are calibrated on that sample: for each K
the least share that would have found ``recall`` of the true neighbours there, and of all K the one with the least
work, rows reranked and cells walked. Vectors without any structure need a large share, clustered ones a
small one; the larger the table against the sample, the closer its neighbours are and the safer the share is.

Work is dealt out by (first centroid, chunk of vectors, chunk of queries), all of bounded size, and each task
returns the best of its chunk only. Rows take no part if their id or vector is null, a component is null or not
finite, the vector is zero, or its length is not the usual one. Repeated ids: a row never finds rows of its own
id. Ties go to the smaller id. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, cut

SAMPLE = 20_000
VECTOR_CHUNK, QUERY_CHUNK = 16_384, 4_096
#: Codebook sizes that are tried, and what walking a cell costs in rows reranked.
BOOKS, CELL_COST = (4, 8, 16, 32, 64, 128), 4.0


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(points, centers)
        total = np.zeros_like(centers)
        np.add.at(total, own, points)
        n = np.bincount(own, minlength=len(centers))
        centers[n > 0] = total[n > 0] / n[n > 0, None]
    return centers


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1) - 2 * points @ centers.T).argmin(1)


def distances(part: np.ndarray, centers: np.ndarray, inner: bool) -> np.ndarray:
    product = part @ centers.T
    return -product if inner else (centers**2).sum(1) - 2 * product


def walk(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: int) -> np.ndarray:
    """Mask over centroid pairs: those walked, nearest sum first, until they hold ``enough`` rows."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2, held = d1[o1], d2[o2], 0
    mask = np.zeros(counts.shape, bool)
    heap = [(s1[0] + s2[0], 0, 0)]
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = o1[i], o2[j]
        held += counts[cell]
        mask[cell] = True
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return mask


def calibrate(sample: np.ndarray, c1: np.ndarray, c2: np.ndarray, top: int, recall: float) -> tuple[bool, float, float]:
    """(by inner product?, share of rows to walk, share of cells to walk) for the wanted recall on the sample."""
    h = sample.shape[1] // 2
    cell = nearest(sample[:, :h], c1) * len(c2) + nearest(sample[:, h:], c2)
    counts = np.bincount(cell, minlength=len(c1) * len(c2))
    queries = np.arange(len(sample))[:: max(1, len(sample) // 256)]
    scores = sample[queries] @ sample.T
    scores[np.arange(len(queries)), queries] = -np.inf
    true = np.argsort(-scores, axis=1, kind="stable")[:, : min(top, len(sample) - 1)]
    best = (False, 1.0, 1.0)
    for inner in (False, True):
        rows, cells = [], []
        for q, own in zip(sample[queries], true, strict=True):
            d = distances(q[None, :h], c1, inner)[0][:, None] + distances(q[None, h:], c2, inner)[0][None, :]
            order = np.argsort(d.ravel(), kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            held = np.cumsum(counts[order]) / len(sample)
            rows += held[place[cell[own]]].tolist()
            cells.append(held)
        share = float(np.quantile(rows, recall)) if rows else 1.0
        if share < best[1]:
            best = (inner, share, float(np.mean([np.searchsorted(x, share) + 1 for x in cells]) / len(counts)))
    return best


def fit(sample: np.ndarray, total: int, top: int, recall: float) -> tuple[np.ndarray, np.ndarray, bool, float]:
    """(first codebook, second codebook, by inner product?, share): of the codebook sizes, the one with the least work."""
    h, best = sample.shape[1] // 2, None
    for k in BOOKS:
        if best and k * k > len(sample):
            break
        books = kmeans(sample[:, :h], k), kmeans(sample[:, h:], k, seed=1)
        inner, share, cells = calibrate(sample, *books, top, recall)
        work = share * total + CELL_COST * cells * len(books[0]) * len(books[1])
        if best is None or work < best[0]:
            best = (work, *books, inner, share)
    return best[1:]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_py(), np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def search(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, top: int = 20, recall: float = 0.93) -> DataFrame:
    """(query_id, rank, vec_id, score): the rows whose id is divisible by ``every`` against all others."""
    spark = table.sparkSession
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return spark.createDataFrame([], schema)
    dims, total = usual["d"], usual["count"]
    rows = rows.where(F.size("v") == dims)
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()])
    h = dims // 2
    c1, c2, inner, share = fit(sample, total, top, recall)
    books = spark.sparkContext.broadcast((c1, c2))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = books.value
        for batch in batches:
            v = np.array(batch.column(1).flatten(), dtype=np.float64).reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest(v[:, :h], a), pa.int32()), pa.array(nearest(v[:, h:], b), pa.int32()), pa.array([x.tobytes() for x in v], pa.binary())], ["vec_id", "c1", "c2", "v"])

    indexed = cut(rows.mapInArrow(index, "vec_id long, c1 int, c2 int, v binary"))
    counts = np.zeros((len(c1), len(c2)), np.int64)
    for r in indexed.groupBy("c1", "c2").count().collect():
        counts[r["c1"], r["c2"]] = r["count"]
    enough = max(top + 1, int(np.ceil(share * total)))
    filled = spark.sparkContext.broadcast(counts)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = books.value
        for batch in batches:
            ids, v = batch.column(0).to_pylist(), _matrix(batch.column(1))
            out: list[list] = [[], [], [], []]
            if ids:
                d1, d2 = distances(v[:, :h], a, inner), distances(v[:, h:], b, inner)
            for i, q in enumerate(ids):
                mask = walk(d1[i], d2[i], filled.value, enough)
                for c in np.flatnonzero(mask.any(axis=1)).tolist():
                    for column, x in zip(out, (q, c, np.packbits(mask[c]).tobytes(), v[i].tobytes()), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["query_id", "c1", "cells", "q"])

    queries = indexed.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    chunks = max(1, min(200, buckets_for(total, every * 250)))
    routed = cut(queries.repartition(chunks).mapInArrow(route, "query_id long, c1 int, cells binary, q binary"))
    # the grid of each first centroid: so many chunks of vectors and of queries
    asked = {r["c1"]: r["count"] for r in routed.groupBy("c1").count().collect()}
    grid = [(c, buckets_for(int(counts[c].sum()), VECTOR_CHUNK), buckets_for(asked.get(c, 0), QUERY_CHUNK)) for c in range(len(c1))]
    grids = [F.broadcast(spark.createDataFrame(grid, f"c1 int, nv{side} int, nq{side} int")) for side in (1, 2)]
    right = indexed.join(grids[0], "c1").select("c1", F.pmod(F.xxhash64("vec_id"), "nv1").alias("vc"), F.explode(F.expr("sequence(0L, nq1 - 1L)")).alias("qc"), "vec_id", "c2", "v")
    left = routed.join(grids[1], "c1").select("c1", F.explode(F.expr("sequence(0L, nv2 - 1L)")).alias("vc"), F.pmod(F.xxhash64("query_id"), "nq2").alias("qc"), "query_id", "cells", "q")

    def rerank(key, asks, vectors):
        import pandas as pd

        ids, found = [], []
        if len(vectors) and len(asks):
            vectors = vectors.sort_values("vec_id", kind="stable")
            own, c = vectors["vec_id"].to_numpy(np.int64), vectors["c2"].to_numpy(np.int64)
            v = np.stack([np.frombuffer(x, np.float64) for x in vectors["v"]])
            longest = np.linalg.norm(v, axis=1).max()
            for at in range(0, len(asks), 256):
                part = asks.iloc[at : at + 256]
                q = np.stack([np.frombuffer(x, np.float64) for x in part["q"]])
                open_ = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=len(c2)).astype(bool) for x in part["cells"]])
                s = np.where(open_[:, c], q @ v.T, -np.inf)
                qid = part["query_id"].to_numpy(np.int64)
                s[qid[:, None] == own[None, :]] = -np.inf
                n = min(top, s.shape[1])
                bar = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
                slack = 1e-13 * v.shape[1] * np.linalg.norm(q, axis=1) * longest  # beyond what rounding can do
                for i in range(len(part)):
                    near = np.flatnonzero((s[i] >= bar[i] - slack[i]) & (s[i] > -np.inf))
                    exact = (v[near] * q[i]).sum(axis=1)
                    order = np.lexsort((own[near], -exact))[:top]
                    ids.append(int(qid[i]))
                    found.append([{"score": float(e), "vec_id": int(o)} for e, o in zip(exact[order], own[near][order], strict=True)])
        return pd.DataFrame({"query_id": pd.Series(ids, dtype="int64"), "found": pd.Series(found, dtype=object)})

    best = left.groupBy("c1", "vc", "qc").cogroup(right.groupBy("c1", "vc", "qc")).applyInPandas(rerank, "query_id long, found array<struct<score:double,vec_id:long>>")
    # at most ``top`` of each chunk meet here
    pool = F.flatten(F.collect_list("found"))
    ordered = F.array_sort(F.transform(pool, lambda x: F.struct((-x["score"]).alias("s"), x["vec_id"].alias("vec_id"))))
    merged = best.groupBy("query_id").agg(F.slice(ordered, 1, top).alias("found"))
    out = merged.select("query_id", F.posexplode("found").alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
