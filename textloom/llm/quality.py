"""Quality classifier: a weak-label model over overlapping labellers, then a hashed linear scorer.

Two traits make a document unfit, and each has labellers of its own that vote good, bad or not at all:

* form: shares of symbol-ended words, of repeated neighbours, of table bars, of capitals and of function words,
  length, and the quality label where there is one;
* toxicity: a list of insults, word stems mined from the labelled sample, and the toxic label where there is one.

Expectation-maximisation estimates, from the votes alone, how often each labeller votes what on good and on bad
documents; the posterior of each sampled document is its training label. A logistic scorer over hashed features (word stems, word endings,
levels of the form shares) learns from them, on those features only that tell the classes apart by a
G-test. The score of a document is 1 - (1 - p_form)(1 - p_toxic); it is rejected from ``THRESHOLD`` on.

The fit uses at most ``SAMPLE`` labelled documents (least hash of the id first); every document is scored on its
whole text. Without labelled documents a sample of all documents is used, without documents nothing is rejected.
Null and empty texts have no words: only the length labeller speaks. Repeated rows, null ids and extra columns
stay as they are; of repeated labels the worst counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SAMPLE, THRESHOLD = 8_000, 0.5
#: Features are hashed into so many places; few of them get a weight.
SPACE = 1 << 31
#: Each round of training shows this share of the features, so that one of several that go together is enough later.
DROPOUT = 0.3
#: Rarer features than this can't pass the test and are not looked at.
LEAST_SEEN = 3
#: Only features of which so many sightings are in bad documents can weigh at all.
PURE = 0.9
GOOD, BAD, NONE = 0, 1, 2
#: Insults (fixed values).
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb imbecile bastard filth vermin".split()
#: Function words of four languages (fixed values).
FUNCTION_WORDS = (
    "the of and to in a is that it for was on with as be by at are this from or an not have he they "
    "der die das und ist nicht ein eine zu den von mit sich auf dem des im als auch "
    "le la les de des et un une est que en pour qui dans pas sur au avec ne "
    "el los las del que y una en es por con para se su al lo como no"
).split()
FORMS = ("symbols", "repeats", "bars", "capitals", "function", "length")


def _hash_words(words: list[str]) -> np.ndarray:
    out = [K.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), True)[0] for w in words]
    return np.unique(np.concatenate(out))


_INSULTS, _FUNCTION = _hash_words(INSULTS), _hash_words(FUNCTION_WORDS)


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


@dataclass
class Parts:
    """Form shares by row (rows x FORMS), insults by row, and hashed features with bounds by row."""

    forms: np.ndarray
    insults: np.ndarray
    stems: list[np.ndarray]
    endings: list[np.ndarray]


def _bounds_sum(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x)])
    return total[bounds[1:]] - total[bounds[:-1]]


def parts(texts: pa.Array) -> Iterator[tuple[int, Parts]]:
    """Yields (first row, parts) for runs of rows."""
    for first, data, offsets in K.pieces(texts):
        rows, n = len(offsets) - 1, len(data)
        words, bounds = K.word_hashes(data, offsets)
        count = np.maximum(np.diff(bounds), 1)
        spaced = ~((data == 32) | ((data - np.uint8(9)) < 5)) if n else np.zeros(0, bool)
        last, start = spaced.copy(), spaced.copy()
        if n:
            last[:-1] &= ~spaced[1:]
            start[1:] &= ~spaced[:-1]
            edge = offsets[(offsets > 0) & (offsets < n)]
            last[edge - 1], start[edge] = spaced[edge - 1], spaced[edge]
        ends = np.flatnonzero(last)
        single = np.flatnonzero(start) == ends
        e1, e2 = (data[ends], data[np.maximum(ends - 1, 0)]) if n else (data, data)
        symbol = np.isin(e1, np.frombuffer(b"%&*#$@!~^=_<>{}", np.uint8)) & (e1 == e2) & ~single
        again = np.zeros(len(words), bool)
        again[1:] = words[1:] == words[:-1]
        again[bounds[:-1][np.diff(bounds) > 0]] = False
        bar = (e1 == ord("|")) & single
        upper = ((data - np.uint8(65)) < 26) if n else np.zeros(0, bool)
        letter = upper | (((data - np.uint8(97)) < 26) if n else upper)
        pure, pure_bounds = K.word_hashes(data, offsets, letters_only=True)
        pure_count = np.maximum(np.diff(pure_bounds), 1)
        letters = np.maximum(_bounds_sum(letter, offsets), 1)
        forms = np.stack([_bounds_sum(symbol, bounds) / count, _bounds_sum(again, bounds) / count, _bounds_sum(bar, bounds) / count, _bounds_sum(upper, offsets) / letters, _bounds_sum(_member(pure, _FUNCTION), pure_bounds) / pure_count, np.diff(bounds).astype(float)], axis=1)
        insults = _bounds_sum(_member(pure, _INSULTS), pure_bounds)
        # stems: whole words and their first 4 to 8 bytes
        low = data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32) if n else data
        inside = (((low - np.uint8(97)) < 26) | ((low - np.uint8(48)) < 10) | (low >= 128)) if n else spaced
        begin = inside.copy()
        if n:
            begin[1:] &= ~inside[:-1]
            begin[edge] = inside[edge]
        begins = np.flatnonzero(begin)
        total = np.zeros(n + 1, np.uint64)
        if n:
            np.cumsum((low.astype(np.uint64) + np.uint64(1)) * K.powers(K.BASE, n), out=total[1:])
        run = np.minimum.accumulate(np.where(inside, n, np.arange(n))[::-1])[::-1] if n else np.zeros(0, np.int64)
        row_end = np.repeat(offsets[1:], np.diff(pure_bounds))
        length = np.minimum(run[begins] if n else run, row_end) - begins
        stem = [pure ^ np.uint64(11)]
        which = [np.arange(len(pure))]
        for size in (4, 5, 6, 7, 8):
            long = np.flatnonzero(length > size)
            h = (total[begins[long] + size] - total[begins[long]]) * K.powers(K.INVERSE, max(n, 1))[begins[long]]
            stem.append(K.mix(h) ^ np.uint64(size))
            which.append(long)
        stem, which = np.concatenate(stem), np.concatenate(which)
        owner = np.searchsorted(pure_bounds, which, side="right") - 1
        ending = (e1.astype(np.int64) * 256 + e2) % SPACE
        ending_owner = np.searchsorted(bounds, np.arange(len(words)), side="right") - 1
        insulting = np.flatnonzero(insults > 0)
        stem, owner = np.concatenate([stem % np.uint64(SPACE), np.full(len(insulting), SPACE - 38, np.uint64)]), np.concatenate([owner, insulting])
        yield first, Parts(forms, insults, _by_row(stem, owner, rows), _by_row(ending, ending_owner, rows))


def _by_row(values: np.ndarray, owner: np.ndarray, rows: int) -> list[np.ndarray]:
    both = np.unique(owner.astype(np.int64) * SPACE + values.astype(np.int64))
    cuts = np.searchsorted(both, np.arange(rows + 1) * SPACE)
    return [(both[a:b] % SPACE).astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def form_votes(forms: np.ndarray) -> np.ndarray:
    """rows x 6 votes."""
    symbols, repeats, bars, capitals, function, length = forms.T
    pick = lambda bad, good: np.where(bad, BAD, np.where(good, GOOD, NONE))
    return np.stack([
        pick(symbols >= 0.3, symbols < 0.05), pick(repeats >= 0.3, repeats < 0.15), pick(bars >= 0.2, bars == 0),
        pick(capitals >= 0.5, capitals < 0.2), pick((function == 0) & (length >= 40), function >= 0.05), pick(length < 3, np.zeros(len(length), bool)),
    ], axis=1)


def levels(forms: np.ndarray) -> np.ndarray:
    """Hashed features of the form shares: which tenth each lies in, and whether any labeller calls the form bad."""
    tenth = np.concatenate([np.minimum((forms[:, :5] * 10).astype(int), 9), np.minimum(np.log2(forms[:, 5:] + 1).astype(int), 9)], axis=1)
    places = SPACE - 100 + np.arange(6) * 10 + tenth
    doubt = np.where((form_votes(forms) == BAD).any(axis=1), SPACE - 40, SPACE - 39)
    return np.concatenate([places, doubt[:, None]], axis=1).astype(np.int32)


def label_model(votes: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over votes: (posterior of bad by row, rates[labeller, class, vote])."""
    patterns, at, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    at = at.ravel()
    bad = np.where((patterns == BAD).any(axis=1), 0.9, 0.05)
    rates = np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - bad) * n, bad * n])
        prior = (weight.sum(1) + 1) / (n.sum() + 2)
        for j in range(votes.shape[1]):
            for v in (GOOD, BAD, NONE):
                rates[j, :, v] = weight[:, patterns[:, j] == v].sum(1) + 0.1
        rates /= rates.sum(axis=2, keepdims=True)
        logs = np.log(prior)[:, None] + sum(np.log(rates[j][:, patterns[:, j]]) for j in range(votes.shape[1]))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - bad).max() < 1e-6:
            break
        bad = new
    return bad[at], rates


@dataclass
class Scorer:
    """Weights of some places of the hashed space (sorted); all others weigh nothing."""

    places: np.ndarray
    weights: np.ndarray
    bias: float

    def find(self, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of every feature that has a weight."""
        flat = np.concatenate([*features, np.zeros(0, np.int32)])
        row = np.repeat(np.arange(len(features)), [len(f) for f in features])
        if not len(self.places):
            return row[:0], row[:0]
        at = np.minimum(np.searchsorted(self.places, flat), len(self.places) - 1)
        known = self.places[at] == flat
        return row[known], at[known]

    def __call__(self, features: list[np.ndarray]) -> np.ndarray:
        row, at = self.find(features)
        s = np.bincount(row, weights=self.weights[at], minlength=len(features)) + self.bias
        return 1 / (1 + np.exp(-np.clip(s, -50, 50)))


def fit_scorer(features: list[np.ndarray], bad: np.ndarray, epochs: int = 120) -> Scorer:
    """Logistic regression on the features that pass a G-test against the soft labels, at a level at which
    chance would let about one in three of such fits keep a feature that means nothing."""
    none = np.zeros(0, np.int32)
    n, b = len(features), float(bad.sum())
    if not n or b < 1 or n - b < 1:
        return Scorer(none, np.zeros(0), -50.0 if b < 1 else 0.0)
    flat = np.concatenate(features)
    places, sightings = np.unique(flat, return_counts=True)
    tested = len(places)
    places = places[sightings >= LEAST_SEEN]
    if not len(places):
        return Scorer(none, np.zeros(0), -50.0)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(f) for f in features])
    at = np.minimum(np.searchsorted(places, flat), len(places) - 1).astype(np.int32)
    keep = places[at] == flat
    flat, row = at[keep], row[keep]
    del at, keep
    seen = np.bincount(flat, minlength=len(places)).astype(float)
    with_bad = np.bincount(flat, weights=bad[row], minlength=len(places))
    g = np.zeros(len(places))
    for got, all_ in ((with_bad, b), (seen - with_bad, n - b)):
        for o, e in ((got, seen * all_ / n), (all_ - got, (n - seen) * all_ / n)):
            g += 2 * np.where(o > 1e-9, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0)
    chosen = (g >= 2 * np.log(tested) + 2) & (with_bad >= PURE * seen)
    keep = chosen[flat]
    flat, row, places = (np.cumsum(chosen) - 1)[flat[keep]], row[keep], places[chosen]
    m = len(places)
    weights, step = np.zeros(m), np.zeros(m)
    bias, bias_step = float(np.log(b / (n - b))) - 2.0, 0.0
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        shown = rng.random(len(flat)) < DROPOUT
        f, r = flat[shown], row[shown]
        s = np.bincount(r, weights=weights[f], minlength=n) + bias
        error = 1 / (1 + np.exp(-np.clip(s, -50, 50))) - bad
        grad = np.bincount(f, weights=error[r], minlength=m) + 0.02 * weights
        step += grad**2
        weights -= 0.7 * grad / np.sqrt(step + 1e-6)
        bias_step += error.sum() ** 2
        bias -= 0.7 * error.sum() / np.sqrt(bias_step + 1e-6)
    return Scorer(places, weights, bias)


@dataclass
class Classifier:
    form: Scorer
    toxic: Scorer
    form_rates: np.ndarray | None = None
    toxic_rates: np.ndarray | None = None

    def __call__(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, p in parts(texts):
            form = self.form([np.concatenate([e, lv]) for e, lv in zip(p.endings, levels(p.forms), strict=True)])
            out[first : first + len(form)] = 1 - (1 - form) * (1 - self.toxic(p.stems))
        return out


def fit(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Classifier:
    """labels: (doc_id, quality, toxic), or None."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = None
    if labels is not None:
        marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = rows.join(F.broadcast(marks), "doc_id")
    if chosen is None or chosen.isEmpty():
        chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "text", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, p in parts(batch.column(0)):
                some = batch.slice(first, len(p.insults))
                yield pa.RecordBatch.from_arrays([some.column(1), some.column(2), pa.array([f.tobytes() for f in p.forms], pa.binary()), pa.array(p.insults.astype(np.int64)), pa.array(p.stems, pa.list_(pa.int32())), pa.array(p.endings, pa.list_(pa.int32()))], ["quality", "toxic", "forms", "insults", "stems", "endings"])

    got = chosen.select("text", F.col("quality").cast("int"), F.col("toxic").cast("int")).mapInArrow(run, "quality int, toxic int, forms binary, insults long, stems array<int>, endings array<int>").toArrow()
    if not got.num_rows:
        return Classifier(fit_scorer([], np.zeros(0)), fit_scorer([], np.zeros(0)))
    forms = np.stack([np.frombuffer(f, np.float64) for f in got["forms"].to_pylist()])
    lists = lambda c: [np.asarray(x.values, dtype=np.int32) for x in got[c]]
    stems, endings = lists("stems"), lists("endings")
    label = lambda c, bad: np.array([NONE if v is None else BAD if v == bad else GOOD for v in got[c].to_pylist()])
    quality, toxic = label("quality", 0), label("toxic", 1)
    insults = np.where(np.array(got["insults"]) > 0, BAD, NONE)
    del got
    bad_form, form_rates = label_model(np.column_stack([form_votes(forms), quality]))
    # the mining labeller knows stems that insulting or marked documents have and no other ones
    known = np.where(toxic != NONE, toxic == BAD, insults == BAD).astype(float)
    votes = np.full(len(stems), GOOD)
    votes[fit_scorer(stems, known, epochs=0).find(stems)[0]] = BAD
    bad_toxic, toxic_rates = label_model(np.column_stack([insults, votes, toxic]))
    features = [np.concatenate([e, lv]) for e, lv in zip(endings, levels(forms), strict=True)]
    return Classifier(fit_scorer(features, bad_form), fit_scorer(stems, bad_toxic), form_rates, toxic_rates)


def scored(docs: DataFrame, classifier: Classifier, text_col: str = "text", name: str = "badness", threshold: float | None = None) -> DataFrame:
    """The documents with their score added, or, with a threshold, those below it with their own columns only."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    schema = docs.schema if threshold is not None else docs.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value(batch.column(at))
            if threshold is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], [*batch.schema.names, name])
            else:
                yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, schema)


def kept(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, badness, keep) of the documents that stay."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = scored(rows, fit(docs, labels, id_col, text_col), threshold=None)
    return out.where(F.col("badness") < threshold).select("doc_id", "badness", F.lit(True).alias("keep"))
