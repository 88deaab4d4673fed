"""The pipeline, stage by stage, against brute force on the smallest tables."""

import os
from collections import Counter

import pytest

import corpus_pipeline as P

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into the first stage, and what each stage gives, written and read again."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, f in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [d.toPandas() for d in out]


def test_columns_and_order(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert all(list(s.columns) == P.COLUMNS for s in stages[1:-1])


def test_quality_keeps_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    kept = set(stages[1].doc_id)
    clean = labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id
    bad = labels[(labels.quality == 0) | (labels.toxic == 1)].doc_id
    assert kept <= set(stages[0].doc_id)
    assert sum(i in kept for i in clean) >= 0.95 * len(clean) and sum(i in kept for i in bad) <= 0.5 * len(bad)


def test_near_duplicates(stages):
    rows = list(zip(stages[1].doc_id, stages[1].text, strict=True))
    sets = {}
    for d, t in rows:
        w = t.encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(stages[2].doc_id) == [d for d in ids if find(d) == d]


def test_decontamination(spark, stages):
    items = [t for t in spark.read.parquet(f"{DATA}/benchmark.parquet").toPandas().text]
    leaky = {d for d, t in zip(stages[2].doc_id, stages[2].text, strict=True) if any(i in t for i in items)}
    left = set(stages[3].doc_id)
    assert not leaky & left and len(left) >= len(stages[2]) - len(leaky) - 2


def test_mixing(stages):
    before, after = stages[3], stages[4]
    size, goal = Counter(), {}
    for s, t in zip(before.source, before.text, strict=True):
        size[s] += len(t.split())
    names = sorted(size, key=str.encode)
    full: set = set()
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        goal = {s: 2 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and goal[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    got = Counter()
    texts = dict(zip(before.doc_id, before.text, strict=True))
    for d, s, t in zip(after.doc_id, after.source, after.text, strict=True):
        got[s] += len(t.split())
        assert texts[d].startswith(t)
    assert all(abs(got[s] - goal[s]) <= 1 for s in names) and max(Counter(after.doc_id).values()) <= 2


def test_sharding(stages):
    out, docs = stages[5], stages[4]
    assert sorted(out.doc_id) == sorted(docs.doc_id) and out["size"].sum() == sum(len(t.encode()) + 8 for t in docs.text)
    assert out.groupby("text_crc32").shard.nunique().max() == 1
    for _, slots in out.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    load = out.groupby("shard")["size"].sum()
    # a shard that one group fills can't be made smaller
    parts = load[out.groupby("shard").text_crc32.nunique() > 1]
    assert len(load) - len(parts) <= 2 and parts.max() - parts.min() <= 0.02 * parts.max()


def test_run(spark, stages):
    assert P.run(spark, DATA).count() == len(stages[5])
