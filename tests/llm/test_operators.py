"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import chat, class_lm, decontaminate, jaccard_join, kernels, line_dedup, mixing, multi_index, pii, quality, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, a int, key string, row int, size int"
EXTRA = (1, 1, "k", 5, 5)


def docs(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, source); further columns clash with names used inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *EXTRA) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def words(rng, n, v=400):
    return " ".join(f"w{rng.randrange(v)}" for _ in range(n))


def collected(df):
    return [tuple(r) for r in df.collect()]


# ---------- kernels


def test_words_and_shingles_match_plain_python():
    texts = ["The  the\tTHE x", "", None, "a b", "é É\x0bz\n", "one", "a b c a b c", " lead", "trail "]
    seen = {}
    for first, data, offsets in kernels.pieces(pa.array(texts)):
        hashes, bounds = kernels.word_hashes(data, offsets)
        for i in range(len(offsets) - 1):
            plain = (texts[first + i] or "").encode().lower().split()
            got = hashes[bounds[i] : bounds[i + 1]].tolist()
            assert len(got) == len(plain)
            for w, h in zip(plain, got, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    sizes = {r: len(s) for r, s in kernels.distinct_sets(pa.array(texts), 3)}
    assert [sizes[i] for i in range(len(texts))] == [2, 0, 0, 1, 1, 1, 3, 1, 1]


def test_slices_of_arrays_and_long_texts():
    long = " ".join(f"x{i}" for i in range(400_000))
    array = pa.array(["skip me", "a b c", long, None]).slice(1)
    assert {r: len(s) for r, s in kernels.distinct_sets(array, 3)} == {0: 1, 1: 399_998, 2: 0}


# ---------- 1


def test_multi_index_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(1, 8)), 80, axis=0)])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [None] * 8, 1), (1004, [1.0], 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, c1 int")
    found = {}
    for q, rank, v, s in collected(multi_index.search(df)):
        found.setdefault(q, {})[rank] = (v, s)
    assert sorted(found) == list(range(0, 380, 20))
    hit = 0
    for q, got in found.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -np.round(s, 9)))[:20]
        assert sorted(got) == list(range(1, 21))
        assert all(abs(s[v] - score) < 1e-9 for v, score in got.values())
        assert [got[r][1] for r in sorted(got)] == sorted((g[1] for g in got.values()), reverse=True)
        hit += len({v for v, _ in got.values()} & set(best.tolist()))
    assert hit >= 0.9 * 20 * len(found)


def test_multi_index_prunes_clustered_vectors(monkeypatch):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(64, 16)) * 8
    x = np.concatenate([c + rng.normal(size=(60, 16)) for c in centers])
    _, _, _, share = multi_index.fit(x, len(x), 20, 0.93)
    assert share < 0.15
    # what a walk opens: the nearest cells, until they hold enough
    d1, d2 = np.array([3.0, 1.0, 2.0]), np.array([5.0, 1.0])
    counts = np.array([[1, 1], [4, 2], [0, 3]])
    assert (multi_index.walk(d1, d2, counts, 4) == np.array([[False, False], [False, True], [False, True]])).all()
    assert multi_index.walk(d1, d2, counts, 99).all()


def test_multi_index_of_large_components(spark):
    """Ties and neighbours are told apart relative to the size of the numbers."""
    rng = np.random.default_rng(6)
    x = rng.integers(-9, 10, size=(200, 6)) * 1e9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x) if v.any()], "vec_id long, embedding array<double>")
    for q, rank, v, s in collected(multi_index.search(df, top=200, recall=1.0)):
        assert s == x[q] @ x[v]
    assert {q for q, *_ in collected(multi_index.search(df))} == {i for i in range(0, 200, 20) if x[i].any()}


def test_multi_index_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert collected(multi_index.search(spark.createDataFrame([], schema))) == []
    assert sorted(collected(multi_index.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0])], schema)))) == [(0, 1, 1, 2.0), (0, 2, 2, 2.0)]


# ---------- 2


def test_sharding(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randrange(1, 60))) for i in range(600)] + [(i, "same text") for i in range(600, 700)] + [(i, None) for i in range(700, 720)] + [(5, ""), (None, "x"), (None, "x")]
    out = collected(sharding.shard_digest(docs(spark, rows)))
    assert len(out) == len(rows)
    by_id = {r[0]: r for r in out}
    assert by_id[600][1:3] == (17, zlib.crc32(b"same text")) and by_id[700][1:3] == (8, None)
    assert len({r[4] for r in out if r[2] == zlib.crc32(b"same text")}) == 1 and len({r[4] for r in out if r[2] is None}) == 1
    load = Counter()
    slots = {}
    for r in out:
        load[r[4]] += r[1]
        slots.setdefault(r[4], []).append(r[5])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    rest = sorted(load.values())[:-1]  # one shard holds the indivisible group
    assert set(load) <= set(range(24)) and max(rest) - min(rest) <= 0.02 * max(rest)
    assert collected(sharding.shard_digest(docs(spark, []))) == []


def plain_differencing(sizes, k):
    """The largest spreads first, with whole lists of members in place of trees."""
    parts = [sorted([(s, [i])] + [(0, [])] * (k - 1)) if k > 1 else [(s, [i])] for i, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1][0] - p[0][0])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(((x + y, m + n) for (x, m), (y, n) in zip(a, reversed(b), strict=True)), key=lambda z: z[0]))
    return sorted(s for s, _ in parts[0])


def test_differencing_matches_plain_lists():
    rng = random.Random(2)
    for k in (2, 3, 7):
        for _ in range(15):
            sizes = rng.sample(range(1, 100_000), rng.randrange(1, 25))
            load = [0] * k
            for s, p in zip(sizes, sharding.differencing([[s] for s in sizes], k), strict=True):
                load[p[0]] += s
            if k == 2:  # without ties between parts there is one way only
                assert sorted(load) == plain_differencing(sizes, k)
            # never worse than greedy by more than the largest size
            greedy = [0] * k
            for s in sorted(sizes, reverse=True):
                greedy[greedy.index(min(greedy))] += s
            assert sum(load) == sum(sizes) and max(load) <= max(greedy) + max(sizes)


def test_sharding_of_large_and_small_groups(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(1, 5_000)) for i in range(1_500)] + [(9_999, "long " * 60_000)] + [(20_000 + i, "twice") for i in range(300)]
    for units in (40, 400):
        out = collected(sharding.shard(docs(spark, rows), 5, units))
        load, where = Counter(), {}
        for _, size, crc, shard, _ in out:
            load[shard] += size
            where.setdefault(crc, set()).add(shard)
        assert len(out) == len(rows) and sum(load.values()) == sum(len(t) + 8 for _, t in rows) and all(len(x) == 1 for x in where.values())
        assert max(load.values()) - min(load.values()) <= (0.01 * max(load.values()) if units == 400 else sum(load.values()) / units)


def test_differencing_is_tighter_than_greedy():
    sizes = [8, 7, 6, 5, 4]
    parts = sharding.differencing([[s] for s in sizes], 2)
    load = Counter()
    for s, p in zip(sizes, parts, strict=True):
        load[p[0]] += s
    assert abs(load[0] - load[1]) == 2
    rng = random.Random(0)
    sizes = [rng.randrange(1, 10_000) for _ in range(2_000)]
    load = Counter()
    for s, p in zip(sizes, sharding.differencing([[s] for s in sizes], 24), strict=True):
        load[p[0]] += s
    assert max(load.values()) - min(load.values()) <= 2


# ---------- 3


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, words(rng, 30, 5_000)) for i in range(20)] + [(50, "three word item"), (51, None), (52, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    item = items[3][1]
    edited = item.split()
    edited[0] = "changed"
    far = item.split()
    far[8] = far[16] = far[24] = "other"
    filler = words(rng, 300, 5_000)
    rows = [(1, f"{filler} {item.upper()}. {filler}"), (2, filler), (3, " ".join(edited)), (4, " ".join(far)), (5, None), (6, ""), (7, "two word item"), (9, "a three word item"), (8, f"{item} {items[7][1]}"), (1, f"{item}")]
    out = collected(decontaminate.leaks(docs(spark, rows), bench))
    assert sorted((d, i) for d, i, *_ in out) == [(1, 3), (1, 3), (3, 3), (8, 3), (8, 7), (9, 50)]
    assert {(d, i): (w, n, s) for d, i, w, n, _, s in out if d == 8} == {(8, 3): (0, 30, 1.0), (8, 7): (30, 30, 1.0)}
    kept = decontaminate.without_leaks(docs(spark, rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6, 7] and kept.columns == DOCS.replace("n_chars long", "n_chars long").replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert collected(decontaminate.leaks(docs(spark, []), bench)) == []
    assert collected(decontaminate.leaks(docs(spark, rows), bench.where("false"))) == []


def brute_leaks(rows, items, radius, threshold):
    """Every window of every document against every item, in plain Python on kernel hashes."""
    def shingles(t, k):
        out = [np.zeros(0, np.uint64)]
        for _, data, offsets in kernels.pieces(pa.array([t])):
            w, bounds = kernels.word_hashes(data, offsets, letters_only=True)
            out = [kernels.shingle_hashes(w, bounds, k)[0], len(w)]
        return out if len(out) == 2 else (out[0], 0)

    def print_(s):
        votes = [sum(1 if int(x) >> b & 1 else -1 for x in s) for b in range(64)]
        return sum(1 << b for b in range(64) if votes[b] > 0)

    found = set()
    for item, text in items:
        n = shingles(text, 5)[1]
        if not n:
            continue
        k = min(n, 5)
        own = shingles(text, k)[0]
        weight, mark = Counter(own.tolist()), print_(own)
        for d, t in rows:
            doc, _ = shingles(t, k)
            m = min(len(own), len(doc))
            for a in range(len(doc) - m + 1 if m else 0):
                window = Counter(doc[a : a + m].tolist())
                both = sum((weight & window).values())
                if both / (len(own) + m - both) >= threshold and (print_(doc[a : a + m]) ^ mark).bit_count() <= radius:
                    found.add((d, item))
                    break
    return found


def test_decontamination_against_all_windows(spark, monkeypatch):
    rng = random.Random(14)
    items = [(i, words(rng, rng.choice([3, 5, 6, 12, 20, 21]), 40)) for i in range(40)] + [(60, "x y x y x y x y x y")]
    rows = [(900, None), (901, ""), (902, "x y x y x y x y"), (903, "y x y x y x y x y x y x")]
    for d in range(60):
        part = rng.choice(items)[1].split()
        for _ in range(rng.randrange(4)):
            part[rng.randrange(len(part))] = rng.choice(["other", "w1", "w2"])
        rows.append((d, f"{words(rng, rng.randrange(12), 40)} {' '.join(part)} {words(rng, rng.randrange(12), 40)}".strip()))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for radius, threshold in ((20, 0.8), (12, 0.5)):
        got = collected(decontaminate.leaks(docs(spark, rows), bench, radius=radius, threshold=threshold))
        assert len(got) == len({r[:2] for r in got}) and {r[:2] for r in got} == brute_leaks(rows, items, radius, threshold)
        assert len(got) > 10
    # the block tables are the only source of candidates
    data = decontaminate.Items([i for i, _ in items], pa.array([t for _, t in items]), 20, 0.8)
    assert list(data.search(pa.array([items[0][1]])))
    monkeypatch.setattr(decontaminate.BlockIndex, "near", lambda self, values: np.zeros((len(values), self.tables.shape[2]), np.uint8))
    assert not list(data.search(pa.array([items[0][1]])))


def test_decontamination_of_a_long_text():
    rng = random.Random(15)
    item = words(rng, 30, 5_000)
    data = decontaminate.Items([1], pa.array([item]), 20, 0.8)
    found = list(data.search(pa.array([words(rng, 200_000, 5_000) + " " + item, None, ""])))
    assert [(f[0], f[1], f[2], f[5]) for f in found] == [(0, 0, 200_000, 1.0)]


def test_block_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 2**63, 40, dtype=np.uint64)
    index = decontaminate.BlockIndex(prints, 20)
    for i, p in enumerate(prints):
        for flips in range(21):
            bits = rng.choice(64, flips, replace=False)
            value = np.array([int(p) ^ sum(1 << int(b) for b in bits)], dtype=np.uint64)
            assert index.near(value)[0, i >> 3] >> (i & 7) & 1


# ---------- 4


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\<|end|>\\", "<\\[\\\\", "", None, "a\n<|turn|>assistant<|text|>x<|end|>", "\\"]
    rows = [(7, i, ["user", "assistant", "sys<|text|>", None][i % 4], t, 1) for i, t in enumerate(nasty)] + [(8, 0, "user", "x", 1), (8, 0, "user", "x", 1), (None, 1, "assistant", "y", 1)]
    got = {r[0]: r[1:] for r in collected(chat.chat_digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record int")))}

    def digest(turns):
        said = "".join(t for r, t in turns if r == "assistant")
        return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()

    want = {7: [(r or "", t or "") for _, _, r, t, _ in rows[:7]], 8: [("user", "x")] * 2, None: [("assistant", "y")], -1: [("user", nasty[0]), ("assistant", nasty[0])]}
    assert {k: v[:4] for k, v in got.items()} == {k: digest(t) for k, t in want.items()}


@pytest.mark.parametrize("record,turns", [
    ('{"messages":[{"role":"user","content":"q"},{"content":"a","role":"assistant"}]}', [("user", "q"), ("assistant", "a")]),
    ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":null}]}', [("user", "q"), ("assistant", "")]),
    ('{"output":"o","instruction":"i","input":""}', [("user", "i"), ("assistant", "o")]),
    ('{"prompt":"p","response":"r"}', [("user", "p"), ("assistant", "r")]),
    ('{"question":"p","answer":"r"}', [("user", "p"), ("assistant", "r")]),
    ('{"unknown":{"deep":1}}', None),
    ('{"id":1,"messages":[{"role":"user","content":"q","name":"n"},{"role":"assistant","content":"a","meta":{"x":{"y":[1]}}}],"tags":["t"]}', [("user", "q"), ("assistant", "a")]),
    ('{"messages":[]}', []),
    ('{"messages":[{"role":"user"}]}', None),
    ('{"messages":"text"}', None),
    ('{"meta":{"prompt":"inner"},"question":"p","answer":{"text":"r"}}', [("user", "p"), ("assistant", '{"text":"r"}')]),
    ('[1,2]', None),
    ('null', None),
])
def test_layouts(spark, record, turns):
    row = chat.format_records(spark.createDataFrame([(record,)], "json string"), F.parse_json("json")).first()
    assert (None if row["turns"] is None else [tuple(t) for t in row["turns"]]) == turns
    if turns:
        assert row["formatted"].count("<|turn|>") == len(turns)
    if "tags" in record:
        assert row["unknown"] == ["id", "messages[].meta", "messages[].name", "tags"]


def test_chat_of_empty_and_long_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert [r[0] for r in collected(chat.chat_digest(spark.createDataFrame([], schema)))] == [-1]
    long = "[<\\" * 200_000
    for i in range(3):  # each layout
        got = {r[0]: r for r in collected(chat.chat_digest(spark.createDataFrame([(i, 0, "assistant", long)], schema)))}
        assert got[i][3:5] == (len(long), hashlib.sha256(long.encode()).hexdigest())


# ---------- 5


def test_quality(spark):
    rng = random.Random(5)
    clean = [(i, words(rng, 80, 300) + " the of and to in") for i in range(120)]
    junk = [(200 + i, " ".join(f"{w}%%%" for w in words(rng, 60).split())) for i in range(20)] + [(230 + i, "same " * 50) for i in range(20)]
    toxic = [(300 + i, words(rng, 60, 300) + " the of and zorgling vermin idiot zorglers") for i in range(30)]
    held = [(400, words(rng, 60, 300) + " the of and zorglest"), (401, words(rng, 60, 300) + " the of and"), (402, "|".join(["x"] * 3) + " *** $$$ %%% !!! ### " * 9)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in junk] + [(i, 1, 1) for i, _ in toxic] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    every = docs(spark, clean + junk + toxic + held + [(500, None), (501, ""), (401, held[1][1])])
    kept = Counter(r[0] for r in collected(quality.kept(every, labels)))
    assert all(kept[i] for i, _ in clean) and not any(kept[i] for i, _ in junk + toxic)
    assert not kept[400] and kept[401] == 2 and not kept[402]
    assert collected(quality.kept(docs(spark, []), labels)) == []
    assert sum(1 for _ in collected(quality.kept(docs(spark, clean), labels.where("false")))) == len(clean)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(4_000) < 0.3
    rates = (0.95, 0.8, 0.7)
    votes = np.stack([np.where(rng.random(4_000) < 0.2, quality.NONE, np.where(rng.random(4_000) < r, truth, ~truth)) for r in rates], axis=1).astype(int)
    posterior, got = quality.label_model(votes)
    accuracy = [(got[j, 0, 0] / got[j, 0, :2].sum() + got[j, 1, 1] / got[j, 1, :2].sum()) / 2 for j in range(3)]
    assert all(abs(a - r) < 0.05 for a, r in zip(accuracy, rates, strict=True))
    assert ((posterior > 0.5) == truth).mean() > 0.9


def plain_label_model(votes, rounds=50):
    """Expectation-maximisation row by row."""
    bad = [0.9 if quality.BAD in v else 0.05 for v in votes]
    for _ in range(rounds):
        rates = []
        for j in range(len(votes[0])):
            count = [[0.1] * 3, [0.1] * 3]
            for v, b in zip(votes, bad, strict=True):
                count[0][v[j]] += 1 - b
                count[1][v[j]] += b
            rates.append([[x / sum(c) for x in c] for c in count])
        prior = (sum(bad) + 1) / (len(bad) + 2)
        new = []
        for v in votes:
            good_, bad_ = 1 - prior, prior
            for j, x in enumerate(v):
                good_, bad_ = good_ * rates[j][0][x], bad_ * rates[j][1][x]
            new.append(bad_ / (good_ + bad_))
        done = max(abs(a - b) for a, b in zip(new, bad, strict=True)) < 1e-6
        if done:
            break
        bad = new
    return bad, rates


def test_label_model_against_plain_python():
    rng = np.random.default_rng(7)
    votes = rng.choice(3, size=(300, 4), p=[0.3, 0.2, 0.5])
    posterior, rates = quality.label_model(votes)
    want, want_rates = plain_label_model([tuple(int(x) for x in v) for v in votes])
    assert np.allclose(posterior, want, atol=1e-6) and np.allclose(rates, np.array(want_rates), atol=1e-6)


def plain_hash(word: bytes) -> int:
    mask = (1 << 64) - 1
    x = sum((b + 1) * pow(kernels.BASE, i, 1 << 64) for i, b in enumerate(word)) & mask
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
    x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
    return x ^ x >> 31


def test_quality_features_against_plain_python():
    import re

    texts = ["The cat, the CAT and zorglings!! idiot", "", None, "a|| b%% b%% c", "| | x |", "% %%", "ÉTÉ été  the\tof", "x", "stupidly stupid worthlessness " * 40]
    at = 0
    for first, p in quality.parts(pa.array(texts)):
        assert first == at
        for i, stems in enumerate(p.stems):
            data = (texts[at + i] or "").encode()
            low = bytes(c + 32 if 65 <= c <= 90 else c for c in data)
            spaced, pure = low.split(), re.findall(rb"[a-z0-9\x80-\xff]+", low)
            want = {(plain_hash(w) ^ 11) % quality.SPACE for w in pure} | {(plain_hash(w[:n]) ^ n) % quality.SPACE for w in pure for n in range(4, 9) if len(w) > n}
            insults = sum(w in {x.encode() for x in quality.INSULTS} for w in pure)
            assert set(stems.tolist()) == want | ({quality.SPACE - 38} if insults else set()) and p.insults[i] == insults
            n = max(len(spaced), 1)
            letters = max(sum(65 <= c <= 90 or 97 <= c <= 122 for c in data), 1)
            shares = [
                sum(len(w) > 1 and w[-1] == w[-2] and w[-1:] in b"%&*#$@!~^=_<>{}" for w in spaced) / n, sum(a == b for a, b in zip(spaced, spaced[1:], strict=False)) / n,
                sum(w == b"|" for w in spaced) / n, sum(65 <= c <= 90 for c in data) / letters,
                sum(w.decode(errors="replace") in quality.FUNCTION_WORDS for w in pure) / max(len(pure), 1), len(spaced),
            ]
            assert np.allclose(p.forms[i], shares), (texts[at + i], p.forms[i], shares)
        at += len(p.stems)
    assert at == len(texts)


def test_scorer_keeps_what_the_g_test_keeps():
    rng = np.random.default_rng(8)
    features = [np.unique(rng.choice(60, 12)).astype(np.int32) for _ in range(400)]
    bad = np.array([float(3 in f or 9 in f) for f in features])
    scorer = quality.fit_scorer(features, bad)
    n, b, want = len(features), bad.sum(), set()
    for x in range(60):
        seen = [x in f for f in features]
        table = [[sum(s and y == c for s, y in zip(seen, bad, strict=True)), sum(not s and y == c for s, y in zip(seen, bad, strict=True))] for c in (1, 0)]
        g = 2 * sum(o * math.log(o * n / (sum(row) * (table[0][k] + table[1][k]))) for row in table for k, o in enumerate(row) if o)
        if g >= 2 * math.log(60) + 2 and table[0][0] >= quality.PURE * sum(seen):
            want.add(x)
    assert set(scorer.places.tolist()) == want == {3, 9} and b
    assert ((scorer(features) > 0.5) == (bad > 0.5)).mean() > 0.95


# ---------- 6


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, s, n):
    s = list(s)
    for _ in range(n):
        at = rng.randrange(len(s))
        s[at : at + rng.randrange(2)] = rng.choice(["", "ü", "q"])
    return "".join(s)


def test_banded_distance(spark):
    rng = random.Random(6)
    pairs = []
    for _ in range(250):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(4, 40)))
        b = changed(rng, a, rng.randrange(5)) or "x"
        if abs(len(a) - len(b)) <= 2:
            pairs.append((a, b))
    pairs += [("same", "same"), ("ab", "abcd"), ("xab", "ab")]
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.banded_distance(a, b, 2), line_dedup.edit_distance(a, b, 2), (F.length("a") < 7) | (F.length("b") < 7) | line_dedup.segments_fit(a, b, 2)).collect()
    for a, b, d, e, fits in got:
        assert min(d, 3) == min(e, 3) == min(edits(a, b), 3)
        assert fits or d > 2


def test_line_dedup(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(33, 70))).strip() + "z" * 9 for _ in range(40)]
    lines = base + [changed(rng, rng.choice(base), rng.randrange(4)) for _ in range(80)] + ["short", "shor", "", "  ", "\t"] * 4
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(5))) for i in range(60)] + [(100, None), (101, ""), (59, "short\nshort"), (None, base[0])]
    got = Counter(collected(line_dedup.line_digest(docs(spark, rows))))
    distinct = sorted({x for _, t in rows if t is not None for x in t.split("\n")})
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if len(x) >= 12 and len(y) >= 12 and edits(x, y) <= 2:
                root[find(x)] = find(y)
    places = sorted(((-1 if d is None else d, p, r) for r, (d, t) in enumerate(rows) if t is not None for p in range(len(t.split("\n")))))
    first = {}
    for d, p, r in places:
        first.setdefault(find(rows[r][1].split("\n")[p]), (d, p, r))
    seen_59 = [r for r, (d, _) in enumerate(rows) if d == 59]
    for r, (d, t) in enumerate(rows):
        if r in seen_59:
            continue  # two rows of one id: which of them comes first is open
        parts = [] if t is None else t.split("\n")
        gone = [p for p, x in enumerate(parts) if x.strip() and first[find(x)] != (-1 if d is None else d, p, r)]
        assert got[(d, len(parts), len(gone), ",".join(map(str, gone)))], (d, gone)
    assert sum(got.values()) == len(rows)
    assert collected(line_dedup.line_digest(docs(spark, []))) == []


def test_line_dedup_of_short_lines(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefghijklm .,") for _ in range(n)).strip(" ") for n in range(8, 36) for _ in range(3)]
    lines = sorted({x for b in base for x in (b, changed(rng, b, 1), changed(rng, b, 2), changed(rng, b, 3))} | {"Are, is anwh reenen.", "Are. Is anwh reenen."})
    near = spark.createDataFrame([(x,) for x in lines], "text string")
    name = {bytes(r[0]): r[1] for r in near.select(line_dedup.line_id(F.col("text")), "text").collect()}
    got = {frozenset((name[bytes(a)], name[bytes(b)])) for a, b in collected(line_dedup.near_links(near))}
    want = {frozenset((x, y)) for i, x in enumerate(lines) for y in lines[:i] if min(len(x), len(y)) >= 12 and edits(x, y) <= 2}
    assert got == want and sum(len(min(p, key=len)) < 32 for p in want) > 50
    found = collected(line_dedup.line_digest(docs(spark, [(1, "Are, is anwh reenen."), (2, "Are. Is anwh reenen.\nx")])))
    assert sorted(found) == [(1, 1, 0, ""), (2, 2, 1, "0")]


def test_line_dedup_of_a_large_family(spark):
    """2,000 lines that differ in two words each, all of which share segments: few of them are near, and few pairs are looked at."""
    rng = random.Random(13)
    base = [f"word{rng.randrange(1_000)}" for _ in range(30)]
    lines = set()
    while len(lines) < 2_000:
        own = list(base)
        for at in rng.sample(range(30), 2):
            own[at] = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
        lines.add(" ".join(own))
    lines = sorted(lines)
    lines += [x[:-1] + "#" for x in lines[:25]]
    near = spark.createDataFrame([(x,) for x in lines], "text string")
    name = {bytes(r[0]): r[1] for r in near.select(line_dedup.line_id(F.col("text")), "text").collect()}
    got = {frozenset((name[bytes(a)], name[bytes(b)])) for a, b in collected(line_dedup.near_links(near))}
    assert got == {frozenset((x, x[:-1] + "#")) for x in lines[:25]}
    code = (0, 1, 3, 2)
    want = [sum(code[x.count(c) % 4] << (2 * i) for i, c in enumerate(line_dedup.SIGNS)) for x in lines]
    assert Counter(r[0] % (1 << 64) for r in near.select(line_dedup.sign_counts(F.col("text"))).collect()) == Counter(want)


def test_dedup_lines_of_repeated_rows(spark):
    one = "the first line of a text that stands twice\n\nand another line of it that stands twice"
    rows = [(1, one), (1, one), (None, one), (None, "only here, in a row without an id"), (2, "only here, in the second document\n" + one), (3, None), (4, "")]
    got = Counter(collected(line_dedup.dedup_lines(docs(spark, rows))))
    # null ids sort first: their copy stays, all others go but for the blank line
    assert got == Counter([(1, ""), (1, ""), (None, one), (None, rows[3][1]), (2, "only here, in the second document\n"), (3, None), (4, "")])
    got = Counter(collected(line_dedup.dedup_lines(docs(spark, [(1, one), (1, one), (5, one)]))))
    assert got == Counter([(1, one), (1, ""), (5, "")])


# ---------- 7


def test_pii(spark):
    card = "4111 1111 1111 1111"
    rows = [
        (1, "é mail a.b@c.de_f@g.hi, x@y"), (2, "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.004"), (3, f"{card}, 4111 1111 1111 1112, 12345"),
        (4, "+49 (30) 123-4567. +1 2"), (5, None), (6, ""), (7, "bank DE89 3704 0044 0532 0130 00 and XX00 1234 1234 1234"), (8, "ssn 123-45-6789 or order 123-45-6789 " + "x" * 50 + " 987-65-4321"), (1, "a@b.c"),
        (9, "7" * 50_000 + "a" * 50_000),
    ]
    got = {}
    for r in collected(pii.pii_digest(docs(spark, rows))):
        got.setdefault(r[0], []).append(r[1:])
    assert [r[1] for r in got[2]] == [3]
    assert got[3][0][2] == 1 and got[3][0][5] == "card:0:19"
    assert got[4][0][3] == 1 and got[4][0][5].startswith("phone:0:17")
    assert got[5] == got[6] == [(0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")]
    assert got[7][0][:4] == (0, 0, 0, 0) and got[7][0][5] == "iban:5:32"
    assert got[8][0][5].startswith("ssn:4:15")
    assert len(got[9]) == 1 and len(got[1]) == 2
    assert collected(pii.pii_digest(docs(spark, []))) == []


def test_pii_words_and_checksums(spark):
    secret, digest = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda", "aee6bd0df9c0ee0ec23eb3c4e9fd1c3c65d50c6b"
    rows = [
        (1, f'x token = "{secret}" y'), (2, f"commit {digest} " + "z " * 30), (3, "password aaaaaaaaaaaaaaaaaaaaaaaaaaaa"),
        (4, "invoice iban DE89370400440532013000"), (5, "invoice iban DE88370400440532013000"),
    ]
    got = {r[0]: r[6] for r in collected(pii.pii_digest(docs(spark, rows)))}
    assert got == {1: "secret:11:51", 2: "", 3: "", 4: "iban:13:35", 5: ""}


def test_redact_cuts_by_position(spark):
    rows = [
        (1, "1.2.3.4 and 1.2.3.45"), (2, "é iban DE89 3704 0044 0532 0130 00, ssn 123-45-6789."), (3, None), (4, ""), (5, "none"),
        (6, "a@b.cc,+49 30 123456,4111 1111 1111 1111"), (7, "x" * 1_000 + " a@b.cc " + "y" * 1_000),
    ]
    got = {r["doc_id"]: r["redacted"] for r in pii.redact(pii.find_spans(docs(spark, rows))).collect()}
    assert got[1] == "[ip] and [ip]" and got[2] == "é iban [iban], ssn [ssn]." and got[3] is None and got[4] == "" and got[5] == "none"
    assert got[6] == "[email],[phone],[card]" and got[7] == "x" * 1_000 + " [email] " + "y" * 1_000


# ---------- 8


def test_class_lm(spark):
    rng = random.Random(8)
    rows = []
    for i in range(200):
        a, b = ("x", "y") if i % 2 else ("p", "q")
        rows.append((i, " ".join(f"{a}{rng.randrange(30)} {b.upper()}{rng.randrange(30)}" for _ in range(20)) + f" rare{i}"))
    rows += [(300, None), (301, ""), (302, "word " * 3_000), (None, "p1 q1"), (7, rows[7][1])]
    out = collected(class_lm.score(docs(spark, rows), classes=4, clustered=80, head=100))
    tokens = lambda t: [*(t or "").encode().lower().split(), 0]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for d, t in rows:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        want[d, held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(base, 6)] += 1
    assert Counter((*r[:5], round(r[5], 6)) for r in out) == want
    test = [r for r in out if r[1]]
    assert sum(r[6] for r in test) > sum(r[5] for r in test) + 0.05 * sum(r[2] for r in test)
    assert collected(class_lm.score(docs(spark, []))) == []


def test_exchange_against_whole_likelihoods():
    rng = np.random.default_rng(9)
    counts = rng.integers(0, 9, size=(30, 30)).astype(float)
    counts[:14, 14:28] *= 5
    counts[rng.random((30, 30)) < 0.3] = 0
    classes, fixed = 3, 2
    f = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())

    def likelihood(own):
        member = np.zeros((30, classes + fixed))
        member[np.arange(30), own] = 1
        pairs = member.T @ counts @ member
        return f(pairs) - f(pairs.sum(1)) - f(pairs.sum(0))

    own = np.concatenate([np.arange(28) % classes, classes + np.arange(fixed)])
    start = likelihood(own)
    for _ in range(6):
        moved = 0
        for w in range(28):
            tries = []
            for c in range(classes):
                other = own.copy()
                other[w] = c
                tries.append(likelihood(other))
            best = int(np.argmax(tries))
            if tries[best] > tries[own[w]] + 1e-9:
                own[w] = best
                moved += 1
        if not moved:
            break
    got = class_lm.exchange(counts, classes, fixed)
    assert (got == own).all() and likelihood(got) > start


def test_class_lm_is_a_distribution():
    texts = ["a b a c", "b a", "c c d e f"]
    words_ = sorted({w for t in texts for w in t.split()})
    every = np.concatenate([t for _, t, _ in class_lm.tokens(pa.array(texts))])
    keys, n = np.unique(every, return_counts=True)
    order = np.lexsort((keys, -n))
    keys, n = keys[order], n[order]
    clustered = np.sort(keys[keys != class_lm.END][:3])
    m = 5
    big = np.zeros((m, m))
    for _, t, bounds in class_lm.tokens(pa.array(texts)):
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            last = m - 1
            for w in t[a:b]:
                s = m - 1 if w == class_lm.END else int(class_lm.lookup(clustered, np.array([w]))[0])
                s = m - 2 if s < 0 else s
                big[last, s] += 1
                last = s
    model = class_lm.Model(keys, n, clustered, big, len(every), len(keys), 2)
    unknown = np.log10(0.5) - model.rare_floor
    for c in range(4):
        total = sum(10 ** (model.step[c, k] + e) for k, e in zip(model.word_class, model.emit, strict=True)) + 10 ** (model.step[c, model.rare_class] + unknown)
        assert abs(total - 1) < 1e-9
    assert len(words_) == 6


def test_class_lm_gives_every_word_a_class(spark):
    rng = random.Random(9)
    # 60 frequent words, 400 others that follow the same pattern: those beyond the clustered and beyond the shared ones
    pick = lambda a: f"{a}{rng.randrange(30)}" if rng.randrange(2) else f"{a}far{rng.randrange(200)}"
    rows = [(i, " ".join(pick("xy"[j % 2]) for j in range(40)) + f" once{i}") for i in range(300)]
    part = docs(spark, rows).where(F.crc32(F.col("doc_id").cast("string")) % 5 != 1).select("text")
    counts = class_lm._tallied(part, lambda t, bounds: t)
    model, others = class_lm.train(part, counts, classes=4, clustered=60, head=100)
    texts = part.toArrow()["text"].combine_chunks()
    seen, name = Counter(), {}
    for r in texts.to_pylist():
        seen.update(r.split())
    for w in seen:
        name[int(next(class_lm.tokens(pa.array([w])))[1][:1].view(np.int64)[0])] = w
    cls = {int(h): int(c) for h, c in zip(model.head.view(np.int64), model.word_class, strict=True)}
    for key, n, c in collected(others):
        assert n == seen[name[key]] and c < model.rare_class
        assert cls.setdefault(key, c) == c
    kinds = {}
    for key, c in cls.items():
        if key in name and seen[name[key]] >= 5:
            kinds.setdefault(c, set()).add(name[key][0])
    assert all(len(k) == 1 for k in kinds.values()) and len(kinds) >= 2
    # the transitions are those of plain Python over all words in their classes
    place = {name[k]: c for k, c in cls.items() if k in name}
    assert place.keys() == seen.keys()
    want, once = np.zeros((6, 6)), np.zeros((6, 6))
    for r in texts.to_pylist():
        line = [5, *(place[w] for w in r.split()), 5]
        new = [5, *(place[w] if seen[w] > 1 else 4 for w in r.split()), 5]
        for a, b, x, y in zip(line[:-1], line[1:], new[:-1], new[1:], strict=True):
            want[a, b] += 1
            once[x, y] += 1
    got = class_lm.transitions(part, model, others)
    assert (got[0] == want).all() and (got[1] == once).all()
    # probabilities after each class: every class, of which unknown words are one
    assert np.allclose((10**model.step).sum(1), 1)
    # and the scores those of plain Python
    size = want.sum(0)
    for d, _, _, _, _, _, score in collected(class_lm.score(docs(spark, rows), classes=4, clustered=60, head=100)):
        line = [(5, 0.0)]
        for w in rows[d][1].split():
            c = place.get(w, 4)
            line.append((c, 0.0 if c == 4 else math.log10(seen[w] / size[c])))
        line.append((5, 0.0))
        assert abs(score - sum(model.step[a[0], b[0]] + b[1] for a, b in zip(line[:-1], line[1:], strict=True))) < 1e-6


# ---------- 9


def brute_components(rows, k, percent):
    """(doc_id, set size, least id reached) of every row, in order."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_components(spark, k, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 12)
    monkeypatch.setattr(jaccard_join, "HOT", 8 if k == 3 else 20_000)
    rng = random.Random(k)
    rows = []
    for i in range(30):
        base = words(rng, rng.choice([1, 2, 4, 40, 90]), 60).split()
        for _ in range(rng.choice([1, 2, 30])):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(["new", "words", copy[0]])
            rows.append((len(rows), " ".join(copy)))
    long = words(rng, 30_000, 5_000)
    rows += [(9_000, None), (9_001, ""), (9_002, " \n"), (None, rows[0][1]), (3, rows[3][1]), (9_003, long), (9_004, long + " more"), (None, "a text that no other row has at all")]
    assert Counter(collected(jaccard_join.ngram_components(docs(spark, rows), k, percent))) == brute_components(rows, k, percent)
    assert collected(jaccard_join.ngram_components(docs(spark, []), k, percent)) == []


def test_jaccard_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(2)
    a, b = words(rng, 60, 5_000), words(rng, 60, 5_000)
    rows = [(5, a), (5, b), (6, a + " z"), (7, b + " z"), (None, b + " z y"), (8, b + " z y x")]
    out = Counter(collected(jaccard_join.ngram_components(docs(spark, rows))))
    assert out == brute_components(rows, 3, 90) and out[(7, 59, 5)] == 1
    kept = jaccard_join.drop_near_copies(docs(spark, rows), 3, 90)
    assert kept.columns == docs(spark, rows).columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(rows[:2])


def test_jaccard_chain_of_chance_likenesses(spark):
    """Each text shares a rare passage with the next one only: one long chain of prefix shingles, and no links but two."""
    rng = random.Random(3)
    parts = [words(rng, 20, 100_000) for _ in range(400)]
    rows = [(i, f"{parts[i]} {parts[i + 1]}") for i in range(399)]
    rows += [(1_000, rows[7][1] + " q"), (1_001, rows[300][1] + " q")]
    assert Counter(collected(jaccard_join.ngram_components(docs(spark, rows), 3, 90))) == brute_components(rows, 3, 90)
    shared = spark.sparkContext.broadcast(np.zeros(1_024, np.uint8))
    data = docs(spark, rows).select(F.lit("").alias("row"), "doc_id", "text", F.xxhash64("text").alias("print"))
    first = jaccard_join._prefixes(data, 3, 90, shared).withColumnRenamed("doc_id", "rep")
    met = collected(jaccard_join._stars(first, 90, shared, 20_000))
    # texts of 40 words share 18 shingles with a neighbour, few of them in both prefixes
    assert {(7, 1_000), (300, 1_001)} <= set(met) and max(Counter(c for c, _ in met).values()) <= 4


def test_meetings_in_any_batches():
    """Pairs and stars of sorted keys do not depend on where batches end."""
    rng = random.Random(4)
    rows = sorted({(rng.randrange(12) ** 2, rng.randrange(40)) for _ in range(200)})
    key, rep = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
    tag = np.array([8 + (r % 2) for r in rep.tolist()], np.int8)
    whole = Counter(zip(*(x.tolist() for x in jaccard_join._meetings(rep, key, tag, 6)), strict=True))
    want = Counter()
    for k in set(key.tolist()):
        own = [(r, t) for (x, r), t in zip(rows, tag.tolist(), strict=True) if x == k]
        if len(own) <= 6:
            want.update((a, b, 1, 4) for i, (a, s) in enumerate(own) for b, t in own[i + 1 :] if not s & t & 1)
        else:
            want.update((own[0][0], b, 4, 1) for b, _ in own[1:])
    assert whole == want


# ---------- 10


def test_mixing(spark):
    rng = random.Random(10)
    rows = [(i, words(rng, rng.randrange(1, 80)), rng.choice(["a", "b", "B", "c", None, "a"])) for i in range(400)]
    rows += [(500, None, "a"), (501, "", "empty"), (502, "x " * 5_000, "long"), (1, rows[1][1], rows[1][2]), (None, "y y", "a")]
    out = collected(mixing.mix_digest(docs(spark, rows)))
    assert Counter((r[0], r[1]) for r in out) == Counter((d, len((t or "").split())) for d, t, _ in rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted((s for s in size if s is not None), key=str.encode) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * size[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    by = {(d, len((t or "").split())): s for d, t, s in rows}
    taken = Counter()
    for d, n, source_size, goal, took, first in out:
        assert (first >= 0) == (took > 0)
        s = by[d, n]
        assert source_size == size[s] and abs(goal - target[s]) < 1e-6 * max(1, goal) and took <= 2 * n
        taken[s] += took
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert collected(mixing.mix_digest(docs(spark, []))) == []
    again = collected(mixing.mix_digest(docs(spark, rows).repartition(5)))
    assert sorted(map(repr, again)) == sorted(map(repr, out))


def test_mix_prefixes_are_balanced(spark):
    rows = [(i, "w " * 50, "abc"[i % 3]) for i in range(300)]
    placed, entries = mixing.mix(docs(spark, rows), block=64)
    order = entries.join(placed.select("row", "source", "target"), "row").select("position", "source", "words", "target").collect()
    total = sum(r["words"] for r in order)
    half = [r for r in order if r["position"] < total / 64 / 2]
    for s in "abc":
        goal = next(r["target"] for r in order if r["source"] == s)
        assert abs(sum(r["words"] for r in half if r["source"] == s) - goal / 2) <= 4 * 64
