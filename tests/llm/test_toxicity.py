import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from listloom.llm.queries import QUERIES
from listloom.llm.toxicity import F32, STRIDE, WINDOW, Network, Tokens, fit, toxicity_scores


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()}
    rows = QUERIES["op6_attention_network"](spark, sf_dir).collect()
    assert len(rows) == pq.read_table(f"{sf_dir}/documents.parquet").num_rows
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    hits, toxic = Counter(), Counter()
    for r in held:
        toxic[lang[r["doc_id"]]] += labels[r["doc_id"]]
        hits[lang[r["doc_id"]]] += labels[r["doc_id"]] and r["predicted"]
    found = sum(hits.values())
    assert found >= 0.85 * sum(toxic.values()) and found >= 0.9 * sum(r["predicted"] for r in held), (hits, toxic)
    assert all(hits[k] >= 0.8 * n for k, n in toxic.items() if n >= 10), (hits, toxic)
    low, high = ([r["score"] for r in held if labels[r["doc_id"]] == k] for k in (0, 1))
    assert np.mean(np.array(high)[:, None] > np.array(low)) > 0.85


def test_gradient_equals_difference():
    texts = pa.array(["a b you are an idiot c d e", "nice words only here"])
    tokens = Tokens(texts)
    network = Network(fit(["x y z"] * 3, [0, 0, 0]).vocabulary, np.array([0, 0.5, 0.1, 0.2], F32))
    for k, v in network.w.items():
        network.w[k] = v.astype(np.float64)
    tokens.word = np.arange(len(tokens.hashes)) % 4
    start, length, owner = tokens.windows()
    target = np.array([1.0, 0.0])
    slopes = network.slopes(tokens, start, length, target)

    def loss():
        logit = network.prepare().logits(tokens, start, length).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(logit)) - target * logit))

    rng = np.random.default_rng(0)
    for key, value in network.w.items():
        flat, slope = value.reshape(-1), slopes[key].reshape(-1)
        for i in rng.permutation(np.flatnonzero(slope))[:2]:
            old, step = flat[i], 1e-2
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - slope[i]) < 2e-3 + 0.05 * abs(slope[i]), key


def test_windows_overlap_and_cover():
    tokens = Tokens(pa.array([" ".join("w" for _ in range(n)) for n in (0, 1, 32, 33, 100)]))
    start, length, text = tokens.windows()
    for i, n in enumerate((0, 1, 32, 33, 100)):
        own = [(int(s - tokens.first[i]), int(k)) for s, k, t in zip(start, length, text) if t == i]
        assert {j for s, k in own for j in range(s, s + k)} == set(range(n))
        assert all(b[0] - a[0] == STRIDE and k == WINDOW for a, b, k in ((a, b, a[1]) for a, b in zip(own, own[1:])))


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 0), (3, 1), (4, 0)], "doc_id long, toxic int")
    rows = toxicity_scores(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity_scores(odd_docs.limit(0), labels.limit(0)).count() == 0
