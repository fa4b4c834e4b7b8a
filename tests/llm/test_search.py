import math
import random
import re
from collections import Counter

import pytest

from listloom.llm.queries import QUERIES
from listloom.llm.search import exact_sums, search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=20):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counts)
    length = sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        scored = []
        for doc, tf in counts:
            n = sum(tf.values())
            score = 0
            for term in terms(text):
                if tf[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    m = 75 + 25 * n * n_docs // length
                    score += w * (1_000_000_000 * tf[term] // (1000 * tf[term] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored, key=lambda r: r[:3])[:k], 1)]
    return Counter(out)


def found(frame):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect())


def test_query_equals_brute_force(spark, sample):
    import pyarrow.parquet as pq

    items = pq.read_table("/root/testdata/sf0.001/benchmark.parquet").to_pylist()
    frame = QUERIES["op12_reversed_search"](spark, "/root/testdata/sf0.001")
    assert dict(frame.dtypes)["rank"] == "int" and dict(frame.dtypes)["score"] == "bigint"
    expected = brute([(d["doc_id"], d["text"]) for d in sample], [(r["item_id"], r["text"]) for r in items])
    assert found(frame) == expected and expected


@pytest.mark.parametrize("postings,block_items,k", [(1 << 20, 10_000, 20), (8, 10_000, 3), (1 << 20, 2, 1)])
def test_odd_rows_and_blocks(spark, odd_docs, postings, block_items, k):
    """Blocks of any size give the same; missing ids last, ties by id, items repeated or without terms."""
    items = [(1, "one a b c"), (2, None), (3, "..."), (4, "ZOë x x x İ"), (None, "text w7 w8 here"), (1, "one a b c"), (5, "zzz")]
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS doc_id", "1 AS rank")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = found(search(odd_docs, frame, k=k, postings=postings, block_items=block_items))
    assert got == brute(rows, items, k)


def test_empty_tables(spark, odd_docs):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert search(odd_docs.limit(0), items).count() == 0
    assert search(odd_docs, items.limit(0)).count() == 0


def test_ties_and_frequent_terms(spark):
    """A term that all documents hold weighs nothing; copies rank by id over many partitions."""
    rng = random.Random(3)
    texts = ["the " + " ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(12)]
    docs = [(i, rng.choice(texts)) for i in rng.sample(range(5000), 900)]
    items = [(i, " ".join(rng.choice(["the", "a", "b", "c", "q"]) for _ in range(6))) for i in range(9)] + [(99, "the")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(13)
    assert found(search(frame, spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_sums_are_exact_beyond_doubles():
    import numpy as np

    values = np.array([(1 << 57) + 1, 3, (1 << 56) + 5], np.int64)
    assert exact_sums(np.array([1, 1, 0]), values, 2).tolist() == [values[2], values[0] + 3]
