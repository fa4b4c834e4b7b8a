import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from listloom.llm import classlm
from listloom.llm.classlm import END_CLASS, TOTAL, Profiles, Tokens, class_scores, exchange, likelihood
from listloom.llm.queries import QUERIES

UPPER = {c: c + 32 for c in range(65, 91)}


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)), None]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def brute(rows):
    counts = Counter(t for i, text in rows if not held(i) for t in tokens_of(text))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        tokens = tokens_of(text)
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens)
        out.append((i, held(i), len(tokens), sum(counts[t] > 0 for t in tokens), total, base))
    return out


def check(frame, rows):
    key = lambda r: (str(r[0]), r[2], r[3], r[5])
    got = sorted((tuple(r)[:6] for r in frame.collect()), key=key)
    expected = sorted(brute(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in expected], rel=1e-9)


def test_query_equals_brute_force(spark, sample, monkeypatch):
    rows = [(d["doc_id"], d["text"]) for d in sample]
    check(QUERIES["op10_class_model"](spark, "/root/testdata/sf0.001"), rows)
    monkeypatch.setattr(classlm, "HEAD", 300)
    frame = QUERIES["op10_class_model"](spark, "/root/testdata/sf0.001")
    check(frame, rows)
    scored = frame.where("held_out").selectExpr("sum(score) / sum(n_tokens) AS s", "sum(base_score) / sum(n_tokens) AS b").first()
    assert scored["s"] < 0 and scored["s"] > scored["b"] - 0.2


def test_odd_rows(spark, odd_docs):
    check(class_scores(odd_docs), [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert class_scores(odd_docs.limit(0)).count() == 0
    none = odd_docs.where("doc_id = 2").limit(1)
    assert class_scores(none).count() == 1


def test_exchange_finds_planted_classes():
    """Words that alternate between two kinds end in classes of one kind each."""
    rng = np.random.default_rng(4)
    pairs = np.zeros((20, 20))
    for a in range(20):
        for b in range(20):
            pairs[a, b] = rng.integers(20, 60) if (a < 10) != (b < 10) else rng.integers(0, 3)
    of = exchange(pairs, classes=2)
    assert len(set(of[:10])) == 1 and len(set(of[10:])) == 1 and of[0] != of[19]


def test_rare_words_are_exchanged_too(spark, monkeypatch):
    """Words beyond the most frequent ones go by their neighbours; all scores equal brute force."""
    monkeypatch.setattr(classlm, "CLUSTERED", 4)
    monkeypatch.setattr(classlm, "WORDS", 40)
    monkeypatch.setattr(classlm, "HEAD", 10)
    got = []
    whole = classlm.word_classes
    monkeypatch.setattr(classlm, "word_classes", lambda *args: got.append(whole(*args)) or got[0])
    rng = np.random.default_rng(7)
    kinds = [[f"{k}{chr(97 + i // 8)}{chr(97 + i % 8)}" for i in range(60)] for k in "xy"]
    rows = [(i, " ".join(kinds[t % 2][rng.integers(60)] for t in range(30))) for i in range(140)]
    rows += [(i, text + " unseen 12 xaa xaa NEW-word") for i, text in rows if held(i)] + [(None, None)]
    scores = class_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()

    classed, pairs = got[0]
    of = {np.uint64(r["word"] % 2**64): (r["class"], r["n"]) for r in classed.collect()}
    hashed = lambda word: Tokens(pa.array([word])).hashes[0] if word else classlm.END
    counts = Counter(t for i, text in rows if not held(i) for t in tokens_of(text))
    assert {hashed(t): n for t, n in counts.items()} == {h: n for h, (_, n) in of.items()}
    kind_of = lambda k: {of[hashed(w)][0] for w in kinds[k]}
    assert len(of) == 121 and not kind_of(0) & kind_of(1)

    def class_of(word):
        if word is None:
            return END_CLASS
        return of[hashed(word)][0] if hashed(word) in of else classlm.CLASSES + Tokens(pa.array([word])).forms[0]

    table, expected = np.zeros((TOTAL, TOTAL)), []
    for i, text in rows:
        classes = [END_CLASS, *map(class_of, tokens_of(text))]
        if not held(i):
            np.add.at(table, (classes[:-1], classes[1:]), 1)
    assert (table == pairs).all()
    sizes = Counter(c for c, _ in of.values())
    for i, text in rows:
        classes = [END_CLASS, *map(class_of, tokens_of(text))]
        steps = sum(math.log10((table[a, b] + 1) / (table[a].sum() + TOTAL)) - math.log10(table[:, b].sum() + sizes[b] + 1) for a, b in zip(classes, classes[1:]))
        expected.append((str(i), steps + sum(math.log10(counts[t] + 1) for t in tokens_of(text))))
    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in scores) == sorted((i, round(x, 6)) for i, x in expected)


def test_value_is_the_rise_of_the_likelihood():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 4, (12, 12)) * rng.integers(0, 2, (12, 12))
    of = rng.integers(0, 3, 12)

    def table(of):
        out = np.zeros((TOTAL, TOTAL))
        np.add.at(out, (of[:, None], of[None, :]), words)
        return out

    def sides():
        for side in (words, words.T):
            by_class = np.zeros((12, TOTAL), np.int64)
            np.add.at(by_class, (np.arange(12)[:, None], of[None, :]), side)
            keys = np.flatnonzero(by_class)
            yield keys, by_class.ravel()[keys]

    profiles = Profiles.read(of, np.diag(words), sides())
    stays = profiles.value(table(of), of)
    for to in range(3):
        rise = profiles.value(table(of), np.full(12, to)) - stays
        for w in range(12):
            moved = of.copy()
            moved[w] = to
            assert rise[w] == pytest.approx(likelihood(table(moved)) - likelihood(table(of)), abs=1e-9)
            one = Profiles.read(of[[w]], np.diag(words)[[w]], [(k[k // TOTAL == w] % TOTAL, n[k // TOTAL == w]) for k, n in sides()])
            changed = table(of)
            one.move(changed, np.array([to]))
            assert (changed == table(moved)).all()
