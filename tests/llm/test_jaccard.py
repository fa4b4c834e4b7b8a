import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from listloom.llm import jaccard, leaks
from listloom.llm.components import components
from listloom.llm.jaccard import similar_classes
from listloom.llm.queries import QUERIES

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, n=4, percent=85):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[i]:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def _rows(frame):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in frame.collect())


def test_query_equals_brute_force(spark, sample):
    rows = [(d["doc_id"], d["text"]) for d in sample]
    expected = brute(rows)
    assert _rows(QUERIES["op1_divide_skip_join"](spark, "/root/testdata/sf0.001")) == expected
    assert any(c is not None and c != d for d, _, c in expected)


def test_odd_rows(spark, odd_docs):
    assert _rows(similar_classes(odd_docs)) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert similar_classes(odd_docs.limit(0)).count() == 0


def near_copies(seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(900)}" for _ in range(rng.randrange(30, 120))] for _ in range(8)]
    shared = [f"s{i}" for i in range(30)]
    texts = []
    for words in base:
        for _ in range(30):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy + (shared if rng.random() < 0.3 else [])))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [2_000_000, 3000])
def test_near_copies_and_cut_components(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(block)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert _rows(similar_classes(frame)) == brute(rows)


def test_candidates_do_not_percolate(spark, monkeypatch):
    """Passages that many documents share join no candidates: their largest group is near the largest linked one."""
    tables, inner = {}, jaccard.stored

    def stored(df, name):
        tables.setdefault(name, inner(df, name))
        return tables[name]

    monkeypatch.setattr(jaccard, "stored", stored)
    similar_classes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).count()
    largest = [tables[t].groupBy("component").count().agg({"count": "max"}).first()[0] or 0 for t in ("candidates", "linked")]
    # The linked table leaves out the first of each group.
    assert 0 < largest[0] <= 2 * (largest[1] + 1)


def test_search_in_one_large_group():
    """Thousands of near copies, some of them of two texts at once, are searched in little time."""
    rng = random.Random(4)
    base = [rng.sample(range(10**9), 100) for _ in range(3)]
    sets = []
    for i in range(4000):
        words = set(base[0] if i % 10 else base[rng.randrange(1, 3)])
        for _ in range(rng.randrange(9)):
            words.discard(rng.choice(sorted(words)))
            words.add(rng.randrange(10**9))
        sets.append(sorted(words))
    sets.sort(key=len)
    sizes = np.array([len(s) for s in sets])
    began = time.perf_counter()
    label = jaccard.search(np.arange(len(sets)), np.concatenate(sets).astype(np.uint64), sizes, sizes, 85)
    assert time.perf_counter() - began < 20
    of = [max(range(3), key=lambda k: len(set(base[k]) & set(s))) for s in sets]
    groups = [set(label[[i for i, o in enumerate(of) if o == k]].tolist()) for k in range(3)]
    assert not groups[0] & groups[1] and not groups[0] & groups[2] and not groups[1] & groups[2]
    linked = [len(s & set(t)) * 100 >= 85 * len(s | set(t)) for k in range(3) for s in [set(sets[of.index(k)])] for t in sets[:400]]
    assert sum(linked) > 100
    for k in range(3):
        s = set(sets[of.index(k)])
        near = [i for i, t in enumerate(sets) if len(s & set(t)) * 100 >= 85 * len(s | set(t))]
        assert {label[i] for i in near} == {label[of.index(k)]}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(3000, 3300), rng.randrange(3000, 3300)) for _ in range(200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_row_ids_stay_when_files_are_split_anew(spark, monkeypatch, tmp_path):
    """Between two jobs, files are packed into other partitions, as when executors are lost or join."""
    rows = near_copies(7)
    random.Random(3).shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "docs"))
    passages = [(i, t.split(" s0")[0]) for i, t in rows if i in (0, 30, 60, 90)]
    items = spark.createDataFrame(passages, "item_id long, text string")
    leaked = {tuple(w[k : k + 10]) for _, t in passages for w in [t.split()] for k in range(len(w) - 9)}
    clean = {i for i, t in rows if not any(tuple(w[k : k + 10]) in leaked for w in [t.split()] for k in range(len(w) - 9))}
    confs = ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {c: spark.conf.get(c, None) for c in confs}

    def packed(cost, least):
        for c, v in zip(confs, (cost, least)):
            spark.conf.set(c, v)

    for module, label in ((jaccard, "sets"), (leaks, "spans")):

        def stored(df, name, label=label, inner=module.stored):
            out = inner(df, name)
            if name == label:
                packed("0", "1")
            return out

        monkeypatch.setattr(module, "stored", stored)
    try:
        frame = spark.read.parquet(str(tmp_path / "docs"))
        packed("128m", "8")
        assert _rows(similar_classes(frame)) == brute(rows)
        packed("128m", "8")
        least = {c for _, _, c in brute(rows, 5, 80)}
        assert {r["doc_id"] for r in jaccard.keep_one(frame).collect()} == least
        packed("128m", "8")
        got = [r["doc_id"] for r in leaks.drop_leaks(frame, items).collect()]
        assert sorted(got) == sorted(clean) and 0 < len(got) < len(rows)
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
