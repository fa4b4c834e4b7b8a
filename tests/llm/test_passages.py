import hashlib
import random
import re
from collections import Counter

from listloom.llm.passages import COVER, PERIOD, remove_passages
from listloom.llm.queries import QUERIES


def brute(texts, window=35):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    for words in docs:
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        yield len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def _check(frame, rows):
    expected = Counter((i, *r) for (i, _), r in zip(rows, brute([t for _, t in rows])))
    assert Counter(tuple(r) for r in frame.collect()) == expected
    return expected


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_query_equals_brute_force(spark, sample):
    rows = [(d["doc_id"], d["text"]) for d in sample]
    found = _check(QUERIES["op8_cover_anchors"](spark, "/root/testdata/sf0.001"), rows)
    assert any(0 < r[2] for r in found)


def test_odd_rows(spark, odd_docs):
    _check(remove_passages(odd_docs), [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert remove_passages(odd_docs.limit(0)).count() == 0


def test_planted_passages(spark):
    """Passages of 30 to 60 words at any shift, a passage most rows share, and few distinct words."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(40)}"
    passages = [" ".join(word() for _ in range(rng.randrange(30, 60))) for _ in range(12)] + [" ".join("ab" for _ in range(50))]
    rows = []
    for i in range(150):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 30))) for _ in range(3)]
        for _ in range(2):
            parts.insert(rng.randrange(len(parts)), passages[0] if rng.random() < 0.4 else rng.choice(passages))
        rows.append((i, "\n".join(parts)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for slice_bytes in (1 << 22, 3000, 200):
        _check(remove_passages(frame, slice_bytes=slice_bytes), rows)
    texts = {r["doc_id"]: r["kept_text"] for r in remove_passages(frame, with_text=True).collect()}
    assert len(texts) == 150
