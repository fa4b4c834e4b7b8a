import hashlib
import re
from collections import Counter

from listloom.llm.leaks import leak_report
from listloom.llm.queries import QUERIES

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return re.findall(PATTERN, (text or "").translate(UPPER))


def brute(docs, items, window=10):
    found = {}
    for item, text in items:
        words = words_of(text)
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if words else 0):
            found.setdefault(tuple(words[i : i + k]), set()).add(item)
    lengths = {len(w) for w in found}
    out = Counter()
    for doc_id, text in docs:
        words, hit, ids = words_of(text), set(), set()
        for k in lengths:
            for i in range(len(words) - k + 1):
                at = found.get(tuple(words[i : i + k]))
                if at:
                    hit |= set(range(i, i + k))
                    ids |= {str(x) for x in at if x is not None}
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out[(doc_id, len(words), len(hit), len(ids), digest, bool(hit))] += 1
    return out


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_query_equals_brute_force(spark, sample):
    import pyarrow.parquet as pq

    items = [(r["item_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/benchmark.parquet").to_pylist()]
    got = QUERIES["op9_benchmark_leaks"](spark, "/root/testdata/sf0.001").select(COLUMNS).collect()
    expected = brute([(d["doc_id"], d["text"]) for d in sample], items)
    assert Counter(tuple(r) for r in got) == expected
    assert any(k[-1] for k in expected)


def test_odd_rows(spark, odd_docs):
    from pyspark.sql import functions as F

    long_item = " ".join(f"w{i}" for i in range(100, 130))
    items = [(1, None), (2, ""), (3, "One!"), (None, "a b c"), (4, "x x x x x x x x x x x x"), (5, long_item), (5, long_item), (6, "Éa zoë"), (7, "Zoë Said")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    report = leak_report(odd_docs, bench).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert Counter(tuple(r) for r in report.select(COLUMNS).collect()) == brute(docs, items)
    assert leak_report(odd_docs.limit(0), bench).count() == 0
    clean = leak_report(odd_docs, bench.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r["contaminated"] for r in clean)


def test_shuffled_join_gives_the_same(spark, odd_docs, monkeypatch):
    from listloom.llm import leaks

    bench = spark.createDataFrame([(3, "One!"), (5, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15")], "item_id long, text string")
    copied = Counter(str(r) for r in leak_report(odd_docs, bench).collect())
    monkeypatch.setattr(leaks, "fits_broadcast", lambda *a, **k: False)
    assert Counter(str(r) for r in leak_report(odd_docs, bench).collect()) == copied
