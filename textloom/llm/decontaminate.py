"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact check.

Words are lower-cased runs of letters, digits and non-ASCII bytes; features are 5-word shingles (an item of fewer words is one
shingle as a whole, and is met by windows of as many words). A window of a document as long as an item (shorter only if the
document is) leaks the item if

* its 64-bit SimHash differs from the item's in at most ``radius`` bits, and
* their weighted shingles (weight: number of occurrences) reach ``threshold``: sum of minima over sum of maxima.

Windows are fingerprinted for each size that items have, and look their candidates up in tables of four blocks of 16 bits: two fingerprints
within the radius differ by at most radius // 4 bits in some block, and the table of a block lists the items so near to each
of its 65,536 values. So all items within the radius are found; the shingles of a window only verify what the tables propose. Windows without a
single benchmark shingle are left out, which loses nothing: their similarity to every item is 0. At a similarity of 0.8 the bits
expected to differ are 10 of 64, so radius 20 lies 3.5 standard deviations off.

The items' tables are shared with all tasks in batches of at most ``BATCH`` items and words; documents are read
once for each batch and never shuffled. Null texts and texts without words match nothing. Null ids and repeated rows or items
stay as they are. Of equally similar windows the one with fewer differing bits is reported, then the first. Empty tables give no leaks. Other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SHINGLE, RADIUS, THRESHOLD = 5, 20, 0.8
#: A batch shares so many items and item words at most.
BATCH_ITEMS, BATCH_WORDS = 65_536, 4_000_000
GROUP = 512


def fingerprint_sums(features: np.ndarray) -> np.ndarray:
    """Cumulated +1/-1 votes of 64-bit features, one row more than features."""
    bits = np.unpackbits(features.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def to_bits(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64).ravel()


class BlockIndex:
    """Which of up to GROUP fingerprints may lie within the radius of a value, by blocks of 16 bits."""

    def __init__(self, prints: np.ndarray, radius: int):
        masks = np.arange(65_536, dtype=np.uint16)
        masks = masks[np.bitwise_count(masks) <= radius // 4]
        self.tables = np.zeros((4, 65_536, (len(prints) + 7) // 8), np.uint8)
        for i, p in enumerate(prints):
            for b in range(4):
                value = np.uint16((int(p) >> (16 * b)) & 0xFFFF)
                self.tables[b, value ^ masks, i >> 3] |= np.uint8(1 << (i & 7))

    def near(self, values: np.ndarray) -> np.ndarray:
        """Candidates of each value as a packed row of bits."""
        out = self.tables[0, (values & np.uint64(0xFFFF)).astype(np.int64)]
        for b in range(1, 4):
            out = out | self.tables[b, ((values >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)]
        return out


class Sized:
    """The items of one size, at most GROUP of them."""

    def __init__(self, words: int, members: list[int], shingles: list[np.ndarray], radius: int):
        self.words, self.members, self.radius = words, members, radius
        self.prints = np.array([to_bits(fingerprint_sums(shingles[i])[-1:])[0] for i in members], dtype=np.uint64)

    def candidates(self, prints: np.ndarray, index: BlockIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, place in members, bits that differ) of all items within the radius of a window's fingerprint."""
        out = []
        for at in range(0, len(prints), 4_096):
            part = prints[at : at + 4_096]
            window, item = np.nonzero(np.unpackbits(index.near(part), axis=1, count=len(self.prints), bitorder="little"))
            bits = np.bitwise_count(part[window] ^ self.prints[item]).astype(np.int64)
            near = bits <= self.radius
            out.append((window[near] + at, item[near], bits[near]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


class Items:
    """One batch of benchmark items, ready for the search."""

    def __init__(self, ids: list, texts: pa.Array, radius: int, threshold: float):
        self.radius, self.threshold = radius, threshold
        self.ids, self.shingles = [], []
        by_size: dict[int, list[int]] = {}
        for first, data, offsets in K.pieces(texts):
            words, bounds = K.word_hashes(data, offsets, letters_only=True)
            hashes, ends = K.shingle_hashes(words, bounds, SHINGLE)
            for row in range(len(offsets) - 1):
                if n := int(bounds[row + 1] - bounds[row]):
                    by_size.setdefault(n, []).append(len(self.ids))
                    self.ids.append(ids[first + row])
                    self.shingles.append(hashes[ends[row] : ends[row + 1]])
        self.weights = [np.unique(s, return_counts=True) for s in self.shingles]
        self.groups = [Sized(n, own[a : a + GROUP], self.shingles, radius) for n, own in sorted(by_size.items()) for a in range(0, len(own), GROUP)]
        # which shingles any item has, by the words that a shingle spans
        self.tables = {}
        for k in sorted({min(g.words, SHINGLE) for g in self.groups}):
            table = np.unique(np.concatenate([self.shingles[i] for g in self.groups if min(g.words, SHINGLE) == k for i in g.members]))
            seen = np.zeros(1 << 20, bool)
            seen[(table >> np.uint64(44)).astype(np.int64)] = True
            self.tables[k] = (table, seen)
        self.indexes: OrderedDict[int, BlockIndex] = OrderedDict()

    def index(self, g: int) -> BlockIndex:
        """The block tables of a group; some tens of MB of them are kept."""
        if g not in self.indexes:
            self.indexes[g] = BlockIndex(self.groups[g].prints, self.radius)
            while sum(x.tables.nbytes for x in self.indexes.values()) > 64 << 20 and len(self.indexes) > 1:
                self.indexes.popitem(last=False)
        self.indexes.move_to_end(g)
        return self.indexes[g]

    def known(self, k: int, hashes: np.ndarray) -> np.ndarray:
        """Places of shingles that some item has."""
        table, seen = self.tables[k]
        maybe = np.flatnonzero(seen[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(table, hashes[maybe]), len(table) - 1)
        return maybe[table[at] == hashes[maybe]]

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int, float]]:
        """Yields (row, item, first word, words, bits that differ, similarity): the best window of each pair."""
        for first, data, offsets in K.pieces(texts):
            words, bounds = K.word_hashes(data, offsets, letters_only=True)
            for k in self.tables:
                hashes, ends = K.shingle_hashes(words, bounds, k)
                places = self.known(k, hashes)
                rows = np.searchsorted(ends, places, side="right") - 1
                cuts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1], [True]])) if len(rows) else []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    row = int(rows[a])
                    for item, start, n, bits, similarity in self.leaks_of(k, hashes[ends[row] : ends[row + 1]], int(bounds[row + 1] - bounds[row]), places[a:b] - ends[row]):
                        yield first + row, item, start, n, bits, similarity

    def leaks_of(self, k: int, doc: np.ndarray, n_words: int, hits: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """doc: all shingles of a document; hits: the places of those that some item has."""
        marks = np.zeros(len(doc) + 1, np.int64)
        marks[hits + 1] = 1
        held = np.cumsum(marks)
        votes = None
        for g, group in enumerate(self.groups):
            if min(group.words, SHINGLE) != k:
                continue
            m = min(group.words - k + 1, len(doc))
            starts = np.flatnonzero(held[m:] - held[: len(doc) - m + 1])
            if votes is None:
                votes = fingerprint_sums(doc)
            prints = to_bits(votes[starts + m] - votes[starts])
            window, place, bits = group.candidates(prints, self.index(g))
            best: dict[int, tuple] = {}
            for j in np.lexsort((starts[window], bits, place)).tolist():
                item, start = group.members[place[j]], int(starts[window[j]])
                similarity = self.similarity(item, doc[start : start + m])
                if similarity >= self.threshold and (item not in best or similarity > best[item][3]):
                    best[item] = (start, min(group.words, n_words), int(bits[j]), similarity)
            for item, found in best.items():
                yield (item, *found)

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Sum of minima over sum of maxima of the weights."""
        keys, weights = self.weights[item]
        at = np.searchsorted(keys, window)
        at[at == len(keys)] = 0
        inside = at[keys[at] == window]
        both = np.minimum(np.bincount(inside, minlength=len(keys)), weights).sum()
        return float(both / (weights.sum() + len(window) - both))


def batches_of(bench: DataFrame, id_col: str, text_col: str, radius: int, threshold: float) -> Iterator[Items]:
    """The benchmark in batches of bounded size."""
    rows = bench.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // (BATCH_ITEMS // 2)), -(-size // (BATCH_WORDS * 3)))
    for p in range(parts):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == p).orderBy("id", "text").toArrow()
        if part.num_rows:
            yield Items(part["id"].to_pylist(), part["text"].combine_chunks(), radius, threshold)


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", radius: int = RADIUS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, hamming, similarity): each item that a document leaks, at its best window."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, first_word long, n_words long, hamming int, similarity double"
    out = None
    for items in batches_of(bench, item_col, item_text, radius, threshold):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                found = list(items.search(batch.column(1)))
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                rest = [[items.ids[f[1]] for f in found], *([f[c] for f in found] for c in range(2, 6))]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(r, k) for r, k in zip(rest, kinds, strict=True))], ["doc_id", "item_id", "first_word", "n_words", "hamming", "similarity"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", radius: int = RADIUS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns as they are, that leak no item."""
    at = docs.columns.index(text_col)
    for items in batches_of(bench, item_col, item_text, radius, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in shared.value.search(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
