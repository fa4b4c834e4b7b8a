import re
from collections import Counter, defaultdict

from listloom.llm.queries import QUERIES
from listloom.llm.repetition import Limits, keep_varied, repetition_report

LIMITS = Limits()


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    triples = defaultdict(list)
    for i in range(n - 2):
        triples[tuple(words[i : i + 3])].append(i)
    thrice, wide, most = set(), set(), 0
    for places in triples.values():
        for i in places if len(places) > 1 else ():
            thrice |= {i, i + 1, i + 2}
            best = 0
            for j in places:
                k = 0
                while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
            most = max(most, best)
            if best >= LIMITS.min_repeat:
                wide |= set(range(i, i + best))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = n < 50 or 100 * len(thrice) > 50 * n
    bad = len(wide) > LIMITS.max_covered * n or (most > LIMITS.max_longest and most > LIMITS.max_longest_share * n)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (n, sum(map(len, words)), symbols, dup, len(thrice), failed, len(wide), most, not failed and not bad)


def _rows(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_query_equals_brute_force(spark, sample):
    expected = Counter((d["doc_id"], *brute(d["text"])) for d in sample)
    assert _rows(QUERIES["op2_suffix_repetition"](spark, "/root/testdata/sf0.001")) == expected


def test_odd_rows(spark, odd_docs):
    rows = odd_docs.collect()
    assert _rows(repetition_report(odd_docs)) == Counter((r["doc_id"], *brute(r["text"])) for r in rows)
    loose = Limits(min_words=1, max_repeat_percent=100)
    kept = keep_varied(odd_docs, limits=loose)
    assert kept.schema == odd_docs.schema and 0 < kept.count() < len(rows)
    assert repetition_report(odd_docs.limit(0)).count() == 0 == keep_varied(odd_docs.limit(0)).count()


def test_each_limit_decides_alone(spark):
    """Texts that pass the base rule: one rejected for what repeats cover, one for a long repeat, the others kept."""
    word = lambda a, n: " ".join(f"w{i}" for i in range(a, a + n))
    looped = " ".join(f"{word(10 * k, 10)} {word(1000 + 25 * k, 10)} {word(10 * k, 10)} {word(1010 + 25 * k, 15)}" for k in range(20))
    texts = {
        "looped": looped,
        "block": f"{word(0, 2900)} {word(5000, 14200)} {word(0, 2900)}",
        "quote": f"{word(0, 60)} {word(5000, 9880)} {word(0, 60)}",
        "half": f"{word(0, 30)} {word(100, 140)} {word(0, 30)}",
        "varied": word(0, 500),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    rows = {r["doc_id"]: r for r in repetition_report(docs).collect()}
    assert not any(r["base_failed"] for r in rows.values())
    looped, block = rows["looped"], rows["block"]
    assert looped["longest_repeat"] == 10 and 0.3 < looped["covered_words"] / looped["n_words"] < 0.5
    assert block["longest_repeat"] == 2900 and block["covered_words"] < 0.3 * block["n_words"]
    assert {k for k, r in rows.items() if r["kept"]} == {"quote", "half", "varied"}
    assert {r["doc_id"] for r in keep_varied(docs).collect()} == {"quote", "half", "varied"}
