"""Class-based n-gram language model (Brown classes by exchange clustering), trained and applied on whole texts.

A word's probability after another is P(class | class before) * P(word | class).

1. Words of all training texts are counted. The ``HEAD`` most frequent are shared with all tasks; every other
   word finds its exact count by a join, so nothing depends on the size of the vocabulary.
2. Bigrams of the ``CLUSTERED`` most frequent words (all other words are one symbol) are counted over all
   training texts, and exchange clustering moves each word to the class that raises the
   likelihood of the class bigrams most, until nothing moves or ``rounds`` are over.
3. Every other word of the training texts goes to the class that makes its own occurrences likeliest,
   by the classes before and after each of them, counted over all training texts. Class transitions are then
   counted anew with every word in its class; those of words that are not shared by a join.
4. Unknown words share one more class. Words seen once stand for them: its transitions are those of the training
   texts with words seen once taken as unknown. The end of a text has its own class. Transitions are smoothed
   towards the class frequencies. Probabilities of all words and one unknown type sum to 1, as those of the
   unigram base do.

Words are compared by 64-bit hashes. Null and empty texts: one token, the end. Null ids count as training
rows; repeated rows stay. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut

HEAD, CLUSTERED, CLASSES = 400_000, 1_500, 48
#: The token that ends every text.
END = np.uint64(0xE0D0E0D0E0D0E0D1)


def tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, token hashes with an end after each row, bounds by row)."""
    for first, data, offsets in K.pieces(texts):
        words, bounds = K.word_hashes(data, offsets)
        n = len(bounds) - 1
        out = np.empty(len(words) + n, np.uint64)
        ends = bounds[1:] + np.arange(n)
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[ends], out[inside] = END, words
        yield first, out, np.concatenate([[0], ends + 1])


def lookup(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index in a sorted table, -1 where it is missing."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def exchange(counts: np.ndarray, classes: int, fixed: int, rounds: int = 6) -> np.ndarray:
    """Class of each symbol, from bigram counts; the last ``fixed`` symbols keep classes of their own.

    The likelihood of a class bigram model depends on sum f(N(c,d)) - sum f(left(c)) - sum f(right(c)),
    f(x) = x log x; a move of a word changes the rows and columns of two classes only."""
    n = len(counts)
    free = n - fixed
    total = classes + fixed
    own = np.concatenate([np.arange(free) % classes, classes + np.arange(fixed)])
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    member = np.zeros((n, total))
    member[np.arange(n), own] = 1
    pairs = member.T @ counts @ member
    left, right = pairs.sum(1), pairs.sum(0)
    for _ in range(rounds):
        moved = 0
        for w in range(free):
            c = own[w]
            out, into, self_ = counts[w] @ member, counts[:, w] @ member, counts[w, w]
            out[c] -= self_
            into[c] -= self_  # now: to and from the others
            pairs[c] -= out
            pairs[:, c] -= into
            pairs[c, c] -= self_
            lw, rw = out.sum() + self_, into.sum() + self_
            left[c] -= lw
            right[c] -= rw
            # gain of each class d: row d grows by out, column d by into, cell (d, d) by both and self
            rows = (f(pairs + out) - f(pairs)).sum(1)
            cols = (f(pairs + into[:, None]) - f(pairs)).sum(0)
            diag = np.diagonal(pairs)
            corner = f(diag + out + into + self_) - f(diag + out) - f(diag + into) + f(diag)
            gain = rows + cols + corner - (f(left + lw) - f(left)) - (f(right + rw) - f(right))
            d = int(np.argmax(gain[:classes]))
            if gain[d] <= gain[c] + 1e-9:
                d = int(c)
            pairs[d] += out
            pairs[:, d] += into
            pairs[d, d] += self_
            left[d] += lw
            right[d] += rw
            member[w, c], member[w, d] = 0, 1
            own[w] = d
            moved += d != c
        if not moved:
            break
    return own


def _tallied(texts: DataFrame, values) -> DataFrame:
    """(key, n): counts of what ``values`` yields from token arrays, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = K.Tally(4_000_000)
        give = lambda h, n: pa.RecordBatch.from_arrays([pa.array(K.signed(h)), pa.array(n.astype(np.int64))], ["key", "n"])
        for batch in batches:
            for _, t, bounds in tokens(batch.column(0)):
                for got in tally.add(values(t, bounds)):
                    yield give(*got)
        for got in tally.rest():
            yield give(*got)

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Model:
    """What scoring needs: bounded tables, shared with all tasks."""

    def __init__(self, head: np.ndarray, head_counts: np.ndarray, clustered: np.ndarray, bigrams: np.ndarray, n: int, v: int, classes: int):
        self.n, self.v = n, v
        order = np.argsort(head)
        self.head, self.counts = head[order], head_counts[order]
        # symbols: the clustered words, then the rare one, then the end
        own = exchange(bigrams, classes, 2)
        k = classes + 2
        member = np.zeros((len(bigrams), k))
        member[np.arange(len(bigrams)), own] = 1
        self.rare_class, self.end_class = classes, classes + 1
        self.word_class = np.full(len(self.head), classes)
        self.word_class[lookup(self.head, clustered)] = own[: len(clustered)]
        self.word_class[self.head == END] = classes + 1
        self.clustered = clustered
        self.base_floor = float(np.log10(n + 0.5 * (v + 1)))
        self.log_counts = np.log10(self.counts + 0.5)
        self.settle(member.T @ bigrams @ member, len(clustered) + (1 if n else 0))

    def settle(self, pairs: np.ndarray, known: int, once: np.ndarray | None = None) -> None:
        """Transitions from class bigrams, and emissions of the shared words. known: words with a class that is not the rare one;
        once: class bigrams with words seen once in the rare class, for the transitions to and from unknown words."""
        k, rare = len(pairs), self.rare_class
        size = pairs.sum(0)
        if once is not None:
            pairs = pairs.copy()
            pairs[rare], pairs[:, rare] = once[rare], once[:, rare]
        reached = pairs.sum(0)
        share = (reached + 0.5) / (reached.sum() + 0.5 * k)
        smooth = 5.0
        self.step = np.log10((pairs + smooth * share) / (pairs.sum(1, keepdims=True) + smooth))
        self.log_size = np.log10(np.maximum(size, 1))
        self.rare_floor = float(np.log10(int(size[rare]) + 0.5 * (max(self.v - known, 0) + 1)))
        self.emit = np.where(self.word_class == rare, self.log_counts - self.rare_floor, np.log10(self.counts) - self.log_size[self.word_class])
        self.emit[self.word_class == self.end_class] = 0.0

    def classes(self, t: np.ndarray, bounds: np.ndarray, of_head: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(class of each token, class of the one before it); -1 for words that are not shared."""
        at = lookup(self.head, t)
        of_head = self.word_class if of_head is None else of_head
        cls = np.where(at >= 0, of_head[np.maximum(at, 0)], -1) if len(self.head) else np.full(len(t), -1)
        cls[bounds[1:] - 1] = self.end_class
        before = np.empty_like(cls)
        before[1:] = cls[:-1]
        before[bounds[:-1]] = self.end_class
        return cls, before


TAIL = "array<struct<key: long, pos: int, before: int, after: int>>"
TAIL_TYPE = pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("after", pa.int32())]))


def _tails(t: np.ndarray, bounds: np.ndarray, cls: np.ndarray, before: np.ndarray) -> pa.Array:
    """The words of each text that are not shared, with their places and the classes around them (-1: not shared either)."""
    at = np.flatnonzero(cls < 0)
    counts = np.searchsorted(at, bounds)
    start = np.repeat(bounds[:-1], np.diff(counts))
    # a word is never the last token of its text: that is the end
    columns = (K.signed(t[at]), (at - start).astype(np.int32), before[at].astype(np.int32), cls[at + 1].astype(np.int32))
    return pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), pa.StructArray.from_arrays([pa.array(c) for c in columns], ["key", "pos", "before", "after"]))


def _placed(part: DataFrame, words: DataFrame, rare: int) -> DataFrame:
    """(row, n, cls, before, after) for every word of a tail array: its training count, its class and those of its neighbours; after is
    null where that is such a word, too, whose own row has the transition."""
    tail = part.select("row", F.inline("tail")).join(words, "key", "left")
    tail = tail.select("row", "pos", "before", "after", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cls", F.lit(rare)).alias("cls"))
    last = F.lag("cls").over(Window.partitionBy("row").orderBy("pos"))
    return tail.select("row", "n", "cls", F.when(F.col("before") >= 0, F.col("before")).otherwise(last).alias("before"), F.when(F.col("after") >= 0, F.col("after")).alias("after"))


def assign(texts: DataFrame, model: Model) -> DataFrame:
    """(key, n, cls) of all training words that were not clustered, from the classes around them."""
    shared = texts.sparkSession.sparkContext.broadcast((model.clustered, model.word_class[lookup(model.head, model.clustered)], model.step, model.log_size))
    rare, end = model.rare_class, model.end_class
    k = rare + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = shared.value[:2]
        held, size = [], 0

        def rest() -> pa.RecordBatch:
            t, code = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, at = np.unique(t, return_inverse=True)
            got, n = np.unique(at.astype(np.int64) * (k * k) + code, return_counts=True)
            code = got % (k * k)
            return pa.RecordBatch.from_arrays([pa.array(K.signed(keys[got // (k * k)])), pa.array((code // k).astype(np.int32)), pa.array((code % k).astype(np.int32)), pa.array(n.astype(np.int64))], ["key", "before", "after", "n"])

        for batch in batches:
            for _, t, bounds in tokens(batch.column(0)):
                at = lookup(words, t)
                cls = np.where(at >= 0, own[np.maximum(at, 0)], rare) if len(words) else np.full(len(t), rare)
                cls[bounds[1:] - 1] = end
                before = np.empty_like(cls)
                before[1:] = cls[:-1]
                before[bounds[:-1]] = end
                other = np.flatnonzero((cls == rare) & (t != END))
                held.append((t[other], before[other] * k + cls[other + 1]))
                size += len(other)
                if size >= 1_000_000:
                    yield rest()
                    held, size = [], 0
        if size:
            yield rest()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, log_size = shared.value[2:]
        # log likelihood of an occurrence in each class, by the class before and the class after
        gain = np.concatenate([step[:, :rare], step[:rare].T])
        for batch in batches:
            lists = batch.column(1)
            flat, lengths = lists.flatten(), np.diff(np.asarray(lists.offsets))
            at = np.repeat(np.arange(len(lengths)), lengths) * (2 * k) + np.asarray(flat.field("side"))
            seen = np.bincount(at, np.asarray(flat.field("n")), len(lengths) * 2 * k).reshape(-1, 2 * k)
            n = seen[:, :k].sum(1)
            best = np.argmax(seen @ gain - n[:, None] * np.log10(10 ** log_size[:rare] + n[:, None]), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(best.astype(np.int32))], ["key", "n", "cls"])

    sides = F.explode(F.array("before", F.col("after") + k)).alias("side")
    seen = texts.mapInArrow(run, "key long, before int, after int, n long").repartition("key").select("key", sides, "n")
    seen = seen.groupBy("key", "side").agg(F.sum("n").alias("n")).groupBy("key").agg(F.collect_list(F.struct("side", "n")).alias("seen"))
    return cut(seen.mapInArrow(choose, "key long, n long, cls int"))


def transitions(texts: DataFrame, model: Model, words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Class bigrams of all training texts: with every word in its class, and with words seen once in the rare one."""
    k = model.rare_class + 2
    # classes from k on: of words seen once
    of_head = model.word_class + k * ((model.counts == 1) & (model.word_class < model.rare_class))
    words = words.select("key", "n", (F.col("cls") + F.when(F.col("n") == 1, k).otherwise(0)).alias("cls"))
    shared = texts.sparkSession.sparkContext.broadcast((model, of_head))

    def seen(t: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return shared.value[0].classes(t, bounds, shared.value[1])

    def pairs(t: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        cls, before = seen(t, bounds)
        return (before * 2 * k + cls)[(cls >= 0) & (before >= 0)].astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tail = [_tails(t, bounds, *seen(t, bounds)) for _, t, bounds in tokens(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.concat_arrays(tail) if tail else pa.array([], TAIL_TYPE)], ["row", "tail"])

    part = texts.select(F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, f"row long, tail {TAIL}")
    met = F.array(F.col("before") * (2 * k) + F.col("cls"), F.col("cls") * (2 * k) + F.col("after"))
    more = _placed(part, words, model.rare_class).select(F.explode(met.cast("array<long>")).alias("key")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    out = np.zeros(4 * k * k)
    for got in (_tallied(texts, pairs).toArrow(), more.toArrow()):
        np.add.at(out, np.array(got["key"], dtype=np.int64), np.array(got["n"], dtype=np.int64))
    out = out.reshape(2 * k, 2 * k)
    rare = np.where(np.arange(2 * k) < k, np.arange(2 * k), model.rare_class)
    return tuple(m.T @ out @ m for m in (np.eye(k)[np.arange(2 * k) % k], np.eye(k)[rare]))


def train(texts: DataFrame, counts: DataFrame, classes: int = CLASSES, clustered: int = CLUSTERED, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model, and (key, n, cls) of all words that were not clustered. texts: training texts, counts: their (key, n)."""
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("n"), "key").limit(head).toArrow()
    keys, n = np.array(top["key"], dtype=np.int64).view(np.uint64), np.array(top["n"], dtype=np.int64)
    order = np.lexsort((keys, -n))
    keys, n = keys[order], n[order]
    words = np.sort(keys[keys != END][:clustered])
    m = len(words) + 2

    def pairs(t: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        s = lookup(words, t)
        s = np.where(s < 0, m - 2, s)
        s[bounds[1:] - 1] = m - 1
        before = np.empty_like(s)
        before[1:] = s[:-1]
        before[bounds[:-1]] = m - 1
        return (before * m + s).astype(np.uint64)

    got = _tallied(texts, pairs).toArrow()
    bigrams = np.zeros(m * m)
    bigrams[np.array(got["key"], dtype=np.int64)] = np.array(got["n"], dtype=np.int64)
    model = Model(keys, n, words, bigrams.reshape(m, m), int(sums[0]), int(sums[1]), min(classes, max(1, len(words))))
    others = assign(texts, model)
    top = others.orderBy(F.desc("n"), "key").limit(head).select("key", "cls").toArrow()
    at = lookup(model.head, np.array(top["key"], dtype=np.int64).view(np.uint64))
    model.word_class[at[at >= 0]] = np.array(top["cls"], dtype=np.int64)[at >= 0]
    every, once = transitions(texts, model, others)
    model.settle(every, model.v, once)
    return model, others


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, clustered: int = CLUSTERED, head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    doc_id = F.col(id_col)
    held = F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))
    rows = docs.select(doc_id.alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out"))
    texts = rows.where(~F.col("held_out")).select("text")
    counts = cut(_tallied(texts, lambda t, bounds: t))
    model, words = train(texts, counts, classes, clustered, head)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            tail, cols = [], [[] for _ in range(5)]
            for _, t, bounds in tokens(batch.column(2)):
                at = lookup(m.head, t)
                inside = at >= 0
                safe = np.maximum(at, 0)
                cls, before = m.classes(t, bounds)
                step = np.where((cls >= 0) & (before >= 0), m.step[before, cls], 0.0)
                base = np.where(inside, m.log_counts[safe] if len(m.head) else 0.0, 0.0)
                emit = np.where(inside, m.emit[safe] if len(m.head) else 0.0, 0.0)
                if not len(m.head):  # the end is in the head unless nothing was learnt
                    base[bounds[1:] - 1] = np.log10(0.5)
                total = lambda x: np.add.reduceat(x, bounds[:-1])
                for c, x in zip(cols, (np.diff(bounds), total(inside.astype(np.int64)), total(base), total(step), total(emit)), strict=True):
                    c.append(x)
                tail.append(_tails(t, bounds, cls, before))
            cols = [np.concatenate(c) if c else np.zeros(0) for c in cols]
            n_tokens, known, base, step, emit = cols
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 1, 3)), *(pa.array(x, k) for x, k in zip((n_tokens, known, base, step + emit), kinds, strict=True)), pa.concat_arrays(tail) if tail else pa.array([], TAIL_TYPE)],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "model", "tail"],
            )

    def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n, cls = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            before, after = batch.column(3).to_numpy(), batch.column(4).fill_null(-1).to_numpy()
            base = np.log10(n + 0.5)
            emit = np.where(cls == m.rare_class, base - m.rare_floor, np.log10(np.maximum(n, 1)) - m.log_size[cls])
            model = emit + m.step[before, cls] + np.where(after >= 0, m.step[cls, after], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((n > 0).astype(np.int64)), pa.array(base), pa.array(model)], ["row", "more", "more_base", "more_model"])

    kind = dict(rows.dtypes)["doc_id"]
    part = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "held_out")
    part = cut(part.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double, tail {TAIL}"))
    # words outside the shared table: their exact counts and classes, joined
    tail = _placed(part, words, model.rare_class).mapInArrow(worth, "row long, more long, more_base double, more_model double")
    tail = tail.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("more", "more_base", "more_model")))
    out = part.drop("tail").join(tail, "row", "left")
    more, more_base, more_model = (F.coalesce(c, F.lit(z)) for c, z in (("more", 0), ("more_base", 0.0), ("more_model", 0.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + more).cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + more_base - F.col("n_tokens") * F.lit(model.base_floor)).alias("base_score"), (F.col("model") + more_model).alias("score"),
    )
