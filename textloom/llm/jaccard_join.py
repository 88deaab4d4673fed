"""N-gram Jaccard join over whole documents, as a prefix-tree join.

A document's set holds its distinct k-word shingles. Two documents link when
``percent * |union| <= 100 * |intersection|``; a component is what links reach.

1. Documents with the same set are one class (a grouped aggregate, combined before the shuffle) with a number of its own.
2. One global order ranks shingles: by their count in a sketch of bounded size, rarest first, then by
   hash. Any fixed order gives the same links; this one fills the prefixes with rare shingles.
3. Linked sets share ``SHARED`` shingles of their prefixes (as many as they must have in common at all, if that is less). Of a shingle
   that few classes hold there, each pair is counted, and pairs that come together often enough meet. Of one that more classes hold, all
   form a *star* around the least of them; stars with the same centre are one. Others need never meet: nothing
   is closed transitively, so a long chain of chance likenesses stays a chain of small stars, and most of those are left out.
4. A star is dealt out in blocks of bounded rows and shingles; small stars share a task. A task holds one block as a trie over
   the global order and walks it with another block's sets: what a path has in common with all probes
   is counted once, and a subtree ends where the shingles left can't reach the threshold any more.
5. Links inside a task become a spanning forest. A star of several blocks is joined with its first block
   before (pivots); blocks that this unites wholly are never compared again, so a large group of copies costs linear work.

Null or empty texts: an empty set, ``n_shingles`` 0, linked with nothing (component: the own id).
Fewer than k words: the whole sequence is the only shingle. Every row counts by itself, whatever its id: rows of one id may hold
different texts, and each links by its own; a row's component is then the least id that its own links reach. Null ids link and
bridge like others; their component is the least id that they reach, null if there is none. Empty tables give no rows. Other
columns are ignored. Shingles are compared by 64-bit hashes, sets by two such hashes and their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, buckets_for

#: The sketch of shingle frequencies has 2**24 cells at most, of a byte each; it only shapes the order.
SKETCH_BITS = 24
#: Prefix shingles in cells of more than so many sightings are matched by joins, which split them, not by a task each.
HOT = 20_000
#: Prefix shingles that linked sets share at least, and how many classes may hold a shingle for their pairs to be counted.
SHARED, FEW = 4, 6
#: A block has so many sets and so many shingles at most (or one set).
BLOCK_SETS, BLOCK_SHINGLES = 512, 80_000
#: The members of all stars (24 bytes each) go to the sets by a broadcast join up to so many, else by a shuffle.
BROADCAST_MEMBERS = 200_000


def _need(n: int, percent: int) -> int:
    """The least overlap of a set of n with any other."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return n - _need(n, percent) + min(SHARED, _need(n, percent))


def _signature(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = np.bitwise_xor.reduce(K.mix(s)) if len(s) else np.uint64(0)
        b = np.sum(K.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)
    return int(a.astype(np.uint64).view(np.int64)), int(b.view(np.int64))


def shingle_sketch(docs: DataFrame, text: str, k: int, cells: int) -> np.ndarray:
    """Levels (8 times the binary logarithm) of how often shingles occur, by hash in ``cells`` (a power of two) cells. A task counts up to 255."""
    shift = np.uint64(64 - cells.bit_length() + 1)
    block = min(cells, 1 << 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tally = np.zeros(cells, np.uint8), K.Tally(500_000)

        def take(at: np.ndarray, n: np.ndarray) -> None:
            held[at] = np.minimum(held[at] + n, 255).astype(np.uint8)

        for batch in batches:
            for _, s in K.distinct_sets(batch.column(0), k):
                for got in tally.add((s >> shift).astype(np.uint32)):
                    take(*got)
        for got in tally.rest():
            take(*got)
        for i in range(cells // block):
            part = held[i * block : (i + 1) * block]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total.setdefault(i, np.zeros(block, np.uint32))
                total[i] += np.frombuffer(c.as_buffer(), np.uint8)
        for i, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([level(n).astype(np.uint8).tobytes()], pa.binary())], ["block", "levels"])

    parts = docs.select(text).mapInArrow(count, "block long, counts binary").repartition("block").mapInArrow(add, "block long, levels binary").toArrow()
    out = np.zeros(cells, np.uint8)
    for i, c in zip(parts["block"].to_pylist(), parts["levels"].to_pylist(), strict=True):
        out[i * block : (i + 1) * block] = np.frombuffer(c, np.uint8)
    return out


def level(counts) -> np.ndarray:
    return np.minimum(8 * np.log2(np.asarray(counts) + 1.0), 255)


def _ranked(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """A set in the global order."""
    return s[np.argsort(_cells(s, sketch), kind="stable")]


def _cells(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return sketch[s >> np.uint64(64 - len(sketch).bit_length() + 1)]


def _prefixes(docs: DataFrame, k: int, percent: int, shared) -> DataFrame:
    """docs: row, doc_id, text, print."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, prefix = [], [], [], []
            for _, s in K.distinct_sets(batch.column(2), k):
                sig = _signature(s)
                n.append(len(s))
                a.append(sig[0])
                b.append(sig[1])
                prefix.append(_ranked(s, shared.value)[: prefix_length(len(s), percent)].tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3)), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(prefix, pa.binary())], ["row", "doc_id", "print", "n", "a", "b", "prefix"])

    return docs.mapInArrow(run, "row string, doc_id long, print long, n long, a long, b long, prefix binary")


def _keys(classes: DataFrame, percent: int, shared, hot: int) -> DataFrame:
    """(rep, key, tag, hot): the prefix shingles of the classes (rep, n, prefix). tag: twice the number of them that a link needs, plus 1
    in the second of the two keys of a shingle.

    Sizes fall into steps of the threshold's ratio; sets that can link are in the same or in adjacent steps, so a
    shingle is a key in its own step and in the next one."""
    from_level = int(level(hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                rep, n = (np.array(batch.column(i)[at : at + 1_024], dtype=np.int64) for i in (0, 1))
                tokens = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(2)[at : at + 1_024]]
                sizes = [len(t) for t in tokens]
                flat = np.concatenate([*tokens, np.zeros(0, np.uint64)])
                often = _cells(flat, shared.value) >= from_level
                step = np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent) + 1e-9).astype(np.uint64)
                step = np.repeat(step, sizes)
                both = np.concatenate([K.mix(flat ^ K.mix(step)), K.mix(flat ^ K.mix(step + np.uint64(1)))])
                least = np.repeat(2 * np.minimum(SHARED, -(-percent * n // 100)), sizes).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.repeat(rep, sizes), 2)), pa.array(K.signed(both)), pa.array(np.concatenate([least, least + 1]), pa.int8()), pa.array(np.tile(often, 2))], ["rep", "key", "tag", "hot"])

    return classes.select("rep", "n", "prefix").mapInArrow(run, "rep long, key long, tag byte, hot boolean")


def _meetings(rep: np.ndarray, key: np.ndarray, tag: np.ndarray, few: int) -> tuple[np.ndarray, ...]:
    """(center, rep, times, least) of whole runs of a key, sorted by key and rep: pairs in short runs, stars in long ones."""
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff([*head, len(key)])
    out = []
    for m in range(2, few + 1):
        rows = head[size == m][:, None] + np.arange(m)
        for i in range(m):
            for j in range(i + 1, m):
                x, y = rows[:, i], rows[:, j]
                own = (tag[x] & 1 & tag[y]) == 0  # two of one step meet in the first of their two keys
                out.append((rep[x][own], rep[y][own], np.ones(own.sum(), np.int64), np.minimum(tag[x], tag[y])[own] >> 1))
    long = size > few
    to, at = np.repeat(head[long], size[long]), np.flatnonzero(np.repeat(long, size))
    out.append((rep[to], rep[at], np.full(len(at), SHARED), np.ones(len(at), np.int8)))
    center, other, times, least = (np.concatenate(x) for x in zip(*out, strict=True))
    keep = center != other
    return center[keep], other[keep], times[keep], least[keep]


def _stars(classes: DataFrame, percent: int, shared, hot: int) -> DataFrame:
    """(center, rep) of classes that must be compared, center < rep: pairs, and members of stars with the first class of a
    key. Most keys come sorted to a task and are streamed; those that may be very common meet their first class by a join
    instead, which can split them."""
    few = FEW

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["center", "rep", "times", "least"]
        held, star = None, None  # rows of a run that may go on; (key, center) of one that is a star already

        def given(rows: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in _meetings(*rows, few)], names)

        for batch in batches:
            rows = [np.array(batch.column(i)) for i in range(3)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if star and len(rows[1]):
                same = int(np.searchsorted(rows[1], star[0], side="right"))
                part, rows = rows[0][:same], [x[same:] for x in rows]
                part = part[part != star[1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), star[1])), pa.array(part), pa.array(np.full(len(part), SHARED)), pa.array(np.ones(len(part), np.int64))], names)
                star = star if not len(rows[1]) else None
            held = None
            if len(rows[1]):
                last = int(np.searchsorted(rows[1], rows[1][-1], side="left"))
                if len(rows[1]) - last > few:
                    star = (rows[1][last], rows[0][last])
                    yield given(rows)
                else:
                    held = [x[last:] for x in rows]
                    yield given([x[:last] for x in rows])
        if held is not None:
            yield given(held)

    rows = _keys(classes, percent, shared, hot)
    cold = rows.where("not hot").select("rep", "key", "tag").repartition("key").sortWithinPartitions("key", "rep").mapInArrow(stars, "center long, rep long, times long, least long")
    common = rows.where("hot").select("rep", "key")
    firsts = common.groupBy("key").agg(F.min("rep").alias("center"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key", "center")
    joined = common.join(firsts, "key").where("center <> rep").select("center", "rep", F.lit(SHARED).cast("long").alias("times"), F.lit(1).cast("long").alias("least"))
    met = cold.union(joined).groupBy("center", "rep").agg(F.sum("times").alias("times"), F.min("least").alias("least"))
    return met.where("times >= least").select("center", "rep")


def contract(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of (a, b) edges as (a, root) with the least member as root. Each round a
    node takes the least root among its neighbours (a grouped aggregate with partial sums, so a node
    with very many edges is no hot spot), then the root of that root, which halves the way left; it
    ends when no root falls. First each task thins its own edges out to a spanning forest."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for z in (x, y):
                    root.setdefault(z, z)
                while root[x] != x:
                    root[x] = x = root[root[x]]
                while root[y] != y:
                    root[y] = y = root[root[y]]
                if x != y:
                    root[max(x, y)] = min(x, y)
                    kept.append((max(x, y), min(x, y)))
            if len(root) > 200_000:  # forgetting costs a few needless edges only
                root.clear()
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], ["a", "b"])

    total = F.sum(F.col("root").cast("decimal(38,0)"))
    thin = edges.select("a", "b").where("a <> b").mapInArrow(forest, "a long, b long")
    links = scratch.keep(thin.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*"))
    roots = scratch.keep(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")), total=total)
    while True:
        hung = links.join(roots, "a").select(F.col("b").alias("a"), "root")
        step = hung.union(roots).groupBy("a").agg(F.min("root").alias("root"))
        up = roots.select(F.col("a").alias("_a"), F.col("root").alias("_up"))
        now = scratch.keep(step.join(up, step["root"] == up["_a"], "left").select("a", F.least("root", F.coalesce("_up", "root")).alias("root")), total=total)
        same = scratch.seen(now)["total"] == scratch.seen(roots)["total"]
        scratch.drop(roots)
        roots = now
        if same:
            scratch.drop(links)
            return roots


class _Trie:
    """Sets in the global order of the task, as a path-compressed prefix tree in sorted row order."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        # rows in lexicographic order, compared as big-endian bytes
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.rows = [sets[i] for i in self.order]
        self.sizes = sizes[self.order]
        self.lcp = [0] * len(sets)
        for i in range(1, len(self.rows)):
            x, y = self.rows[i - 1], self.rows[i]
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            self.lcp[i] = int(differ[0]) if len(differ) else m


def trie_links(left: list[np.ndarray], left_sizes: np.ndarray, right: list[np.ndarray], right_sizes: np.ndarray, percent: int, same: bool) -> Iterator[tuple[int, int]]:
    """Pairs (left row, right row) that reach the threshold; with ``same`` a spanning forest of one list."""
    both = left if same else left + right
    tokens, at = np.unique(np.concatenate([*both, np.zeros(0, np.uint64)]), return_inverse=True)
    often = np.bincount(at, minlength=len(tokens))
    # shingles of one set only add nothing to any overlap; the rest rank by frequency, then by hash
    rank = np.full(len(tokens), -1, np.int64)
    shared = np.flatnonzero(often > 1)
    rank[shared[np.argsort(often[shared], kind="stable")]] = np.arange(len(shared))
    ends = np.cumsum([0, *map(len, both)])
    local = [np.sort(r[r >= 0]).astype(np.uint32) for r in (rank[at[ends[i] : ends[i + 1]]] for i in range(len(both)))]
    tree_sets, probe_sets = (local, local) if same else (local[: len(left)], local[len(left) :])
    probe_sizes = left_sizes if same else right_sizes
    tree = _Trie(tree_sets, left_sizes)
    width = len(shared) + 1
    has = np.zeros((len(probe_sets), width), np.uint8)
    lengths = np.array([len(p) for p in probe_sets], dtype=np.int64)
    for i, p in enumerate(probe_sets):
        has[i, p] = 1
    parent = list(range(len(probe_sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def need(a: np.ndarray, b) -> np.ndarray:
        return -(-percent * (a + b) // (100 + percent))

    everyone = np.arange(len(probe_sets))
    # (first row, end row, depth reached, live probes, their overlaps with the path)
    stack = [(0, len(tree.rows), 0, everyone, np.zeros(len(everyone), np.int64))] if tree.rows else []
    while stack:
        lo, hi, depth, live, common = stack.pop()
        # the path all rows lo..hi share goes on to their least common prefix
        to = min([len(tree.rows[lo]), *tree.lcp[lo + 1 : hi]])
        if to > depth:
            edge = tree.rows[lo][depth:to]
            common = common + has[live[:, None], edge[None, :]].sum(axis=1, dtype=np.int64)
        sizes = tree.sizes[lo:hi]
        longest = max(len(r) for r in tree.rows[lo:hi]) - to
        bound = common + np.minimum(longest, lengths[live] - common)
        stays = (bound >= need(probe_sizes[live], sizes.min())) & (100 * probe_sizes[live] >= percent * sizes.min()) & (percent * probe_sizes[live] <= 100 * sizes.max())
        live, common = live[stays], common[stays]
        if not len(live):
            continue
        row = lo
        while row < hi and len(tree.rows[row]) == to:  # sets that end here
            hit = live[common >= need(probe_sizes[live], tree.sizes[row])]
            own = tree.order[row]
            for probe in hit.tolist():
                if not same:
                    yield own, probe
                elif probe != own and (a := find(own)) != (b := find(probe)):
                    parent[a] = b
                    yield own, probe
            row += 1
        # children start where a row no longer shares more than the path with the one before
        cuts = [row, *(i for i in range(row + 1, hi) if tree.lcp[i] <= to), hi] if row < hi else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            stack.append((a, b, to, live, common))


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int, n: int) -> DataFrame:
    """(rep, n, set) of the n classes in ``wanted`` (rep, n, a, b, print), from one text of each. A bit map of at most 2 MB, filled by the
    texts' hashes, spares most other documents the work; the join removes what it lets through by chance."""
    bits = 1 << min(24, max(10, int(n * 16).bit_length()))
    place = F.pmod("print", F.lit(bits))
    words = wanted.select(place.alias("p")).groupBy((F.col("p") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("m")).toArrow()
    bitmap = np.zeros(bits // 64 + 1, np.uint64)
    bitmap[np.array(words["w"], dtype=np.int64)] = np.array(words["m"], dtype=np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            prints = np.array(batch.column(1), dtype=np.int64)
            p = prints % bits
            may = np.flatnonzero((shared.value[p // 64] >> (p % 64).astype(np.uint64)) & np.uint64(1))
            new = []  # a text once a task is enough
            for i in may.tolist():
                if (x := int(prints[i])) not in given:
                    given.add(x)
                    new.append(i)
            if len(given) > 100_000:
                given.clear()
            for at in range(0, len(new), 256):
                some = batch.take(pa.array(new[at : at + 256]))
                sets = [x for _, x in K.distinct_sets(some.column(0), k)]
                signs = [_signature(x) for x in sets]
                yield pa.RecordBatch.from_arrays([some.column(1), *(pa.array([x[i] for x in signs], pa.int64()) for i in (0, 1)), pa.array([x.tobytes() for x in sets], pa.binary())], ["print", "a", "b", "set"])

    found = docs.select("text", "print").mapInArrow(run, "print long, a long, b long, set binary")
    once = found.groupBy("print", "a", "b").agg(F.first("set").alias("set"))
    return once.join(wanted, ["print", "a", "b"]).select("rep", "n", "set")


def _forest(pairs: list[tuple]) -> list[tuple]:
    """Of links, those that unite something new."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            kept.append((a, b))
    return kept


def _lists(frame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in frame["set"]], frame["n"].to_numpy(np.int64), frame["rep"].to_numpy(np.int64)


def _small(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links inside stars of one block. sets: bucket, center, rep, n, set."""

    def run(frame):
        import pandas as pd

        pairs = []
        for _, star in frame.sort_values(["center", "rep"]).groupby("center"):
            lists, sizes, ids = _lists(star)
            pairs += [(ids[a], ids[b]) for a, b in trie_links(lists, sizes, lists, sizes, percent, True)]
        return pd.DataFrame(_forest(pairs), columns=["a", "b"], dtype="int64")

    return sets.groupBy("bucket").applyInPandas(run, "a long, b long")


def _compare(sets: DataFrame, tasks: DataFrame, percent: int) -> DataFrame:
    """(a, b) links of block pairs. sets: center, block, rep, n, set; tasks: center, i, j with i <= j."""

    def run(key, frame):
        import pandas as pd

        i, j = int(key[1]), int(key[2])
        frame = frame.sort_values("rep")
        sides = [_lists(frame[frame["block"] == x]) for x in ((i,) if i == j else (i, j))]
        (left, left_sizes, left_ids), (right, right_sizes, right_ids) = sides[0], sides[-1]
        found = trie_links(left, left_sizes, right, right_sizes, percent, i == j)
        # one link is enough for what is united already
        return pd.DataFrame(_forest([(left_ids[a], right_ids[b]) for a, b in found]), columns=["a", "b"], dtype="int64")

    dealt = sets.join(tasks.select("center", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")), ["center", "block"])
    return dealt.groupBy("center", "i", "j").applyInPandas(run, "a long, b long")


def _links(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, root) of all classes that link. members: center, rep, n; sets: rep, n, set."""
    small = F.broadcast if scratch.seen(members)["n"] <= BROADCAST_MEMBERS else lambda x: x
    stars = members.groupBy("center").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_c"))
    parts = F.greatest(F.ceil(F.col("_c") / (BLOCK_SETS * 3 // 4)), F.ceil(F.col("_n") / (BLOCK_SHINGLES * 3 // 4)))
    one = (F.col("_c") <= BLOCK_SETS) & (F.col("_n") <= BLOCK_SHINGLES)
    stars = scratch.keep(stars.select("center", "_n", F.when(one, 1).otherwise(parts).cast("long").alias("blocks")), shingles=F.coalesce(F.sum(F.when(F.col("blocks") == 1, F.col("_n"))), F.lit(0)), most=F.coalesce(F.max("blocks"), F.lit(0)))
    seen = scratch.seen(stars)
    buckets = buckets_for(seen["shingles"], BLOCK_SHINGLES)
    few = stars.where("blocks = 1").select("center", F.pmod(F.xxhash64("center"), F.lit(buckets)).alias("bucket"))
    links = scratch.keep(_small(sets.join(small(members.select("center", "rep").join(few, "center")), "rep"), percent))
    if seen["most"] <= 1:
        return contract(links, scratch)
    large = stars.where("blocks > 1")
    dealt = members.select("center", "rep").join(large.select("center", "blocks"), "center").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    blocks = scratch.keep(sets.join(small(dealt), "rep"))
    # each block with itself and with its star's first block
    own = blocks.groupBy("center", "block").agg(F.count(F.lit(1)).alias("_c"))
    near = own.select("center", F.col("block").alias("i"), F.col("block").alias("j")).union(own.where("block > 0").select("center", F.lit(0).cast("long"), "block"))
    links = scratch.keep(links.union(_compare(blocks, near, percent)))
    roots = contract(links, scratch)
    # of blocks that lie in one component already, no two need comparing
    state = blocks.select("rep", "center", "block").join(roots.withColumnRenamed("a", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    state = scratch.keep(state.groupBy("center", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("block > 0"))
    x, y = (state.select([F.col(c).alias(f"{p}_{c}") for c in state.columns]) for p in ("x", "y"))
    united = (F.col("x_lo") == F.col("y_hi")) & (F.col("x_hi") == F.col("y_lo")) & (F.col("x_lo") == F.col("x_hi"))
    far = x.join(y, (F.col("x_center") == F.col("y_center")) & (F.col("x_block") < F.col("y_block")) & ~united)
    far = scratch.keep(far.select(F.col("x_center").alias("center"), F.col("x_block").alias("i"), F.col("y_block").alias("j")), tasks=F.count(F.lit(1)))
    if not scratch.seen(far)["tasks"]:
        return roots
    return contract(links.union(_compare(blocks, far, percent)), scratch)


def ngram_rows(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(row, doc_id, n_shingles, component, component_id) for every row: the string in ``row_col`` if there is one, the number of its component (null for
    an empty set) and the least id in that."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    row = F.col(row_col) if row_col else F.lit(None).cast("string")
    docs = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("print", F.xxhash64("text"))
    cells = 1 << min(SKETCH_BITS, max(10, (64 * docs.count()).bit_length()))
    sketch = spark.sparkContext.broadcast(shingle_sketch(docs, "text", k, cells))
    every = scratch.keep(_prefixes(docs, k, percent, sketch))
    classes = every.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("least"), F.min("print").alias("print"), F.first("prefix").alias("prefix"))
    classes = scratch.keep(classes.withColumn("rep", F.monotonically_increasing_id()))
    # a class whose prefix shingles are all its own is in no star
    stars = scratch.keep(_stars(classes, percent, sketch, HOT))
    sketch.destroy()  # the rows are written; workers would hold it until they end
    members = stars.union(stars.select("center", F.col("center").alias("rep")).distinct())
    members = scratch.keep(members.join(classes.select("rep", "n"), "rep"), n=F.count(F.lit(1)))
    wanted = scratch.keep(members.select("rep").distinct().join(classes.select("rep", "n", "a", "b", "print"), "rep"), n=F.count(F.lit(1)))
    sets = scratch.keep(_sets_of(docs, wanted, k, scratch.seen(wanted)["n"]))
    roots = _links(members, sets, percent, scratch)
    scratch.drop(stars, members, wanted, sets)
    named = classes.join(roots.withColumnRenamed("a", "rep"), "rep", "left").select("a", "b", F.col("n").alias("_n"), "least", F.coalesce("root", "rep").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.drop("least").join(least, "component")
    out = every.join(named, (every["a"] == named["a"]) & (every["b"] == named["b"]) & (every["n"] == named["_n"]) & (every["n"] > 0), "left")
    return out.select("row", "doc_id", every["n"].alias("n_shingles"), "component", F.when(every["n"] > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def ngram_components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; see the module text for method and edge cases."""
    return ngram_rows(docs, k, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns as they are, without those that link to another one that stays: of each component the row of the least
    id stays (null ids last; of repeated ids the first in the input). Rows without words link with nothing and stay. Rows are known by
    their place, which scans of files, tables and checkpoints give alike each time, and by a hash of all that they hold."""
    place = F.concat_ws(":", F.monotonically_increasing_id(), F.xxhash64(*docs.columns))
    numbered = docs.withColumn("_row", place)
    groups = ngram_rows(numbered, k, percent, id_col, text_col, "_row").where("component is not null")
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")
    first = groups.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    gone = groups.join(first, "component").where("row <> first.row").select(F.col("row").alias("_row"))
    return numbered.join(gone, "_row", "left_anti").select(*docs.columns)
