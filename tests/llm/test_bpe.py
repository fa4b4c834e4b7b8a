import hashlib
import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from listloom.llm.bpe import CHUNK, Decoder, Encoder, RunTransducer, encode, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return Encoder(PATH)


def test_equals_library(library, own):
    rng = random.Random(7)
    alphabets = ["ab", "etaoin shrdlu", "the and ing", "é ü\n\t x  ", "0123456789", "  \n a", "!#$%&'s're 've", "日本 語😀́"]
    texts = ["".join(rng.choice(a) for _ in range(rng.choice([0, 5, 50, 900]))) for a in alphabets for _ in range(25)]
    texts += ["a" * 70000, " " * 70000 + "x", "x" + " " * CHUNK + "y", "the" * 30000, "x" * (CHUNK - 2) + "'re" * 10, "\n \n" * 30000]
    texts += ["<|endoftext|>a<|endoftext|> <|endoft", "it's I'll 'S'", ""]
    texts += ["".join(map(chr, range(low, low + 400))) + " " for low in range(0, 0x3400, 400)]
    for text, got in zip(texts, own.encode(texts)):
        ids = np.frombuffer(got, "<u4").tolist()
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids == expected, text[:80]
        assert "".join(Decoder(own.vocabulary).decode(np.array(ids))) == library.decode(expected, skip_special_tokens=False)


def test_lookahead_is_sufficient(own):
    """Tokens given before a run ends are those of the whole run, and the buffer stays bounded."""
    rng = random.Random(3)
    assert 0 < own.vocabulary.lookahead < 2000
    for letters in ("a", "ab", "tion", "etaoinshrdlu", "-=", "0"):
        run = "".join(rng.choice(letters) for _ in range(6000)).encode()
        machine, got, held = RunTransducer(own.vocabulary), [], 0
        for i in range(0, len(run), 100):
            got += machine.feed(run[i : i + 100])
            held = max(held, len(machine.buffer))
        assert got + machine.finish() == own.vocabulary.merge(run)
        assert held < 3 * own.vocabulary.lookahead


def test_long_runs(library, own, monkeypatch):
    """Runs of a million letters take seconds, the buffer stays small, and ids are the library's."""
    rng = random.Random(9)
    held, feed = [], RunTransducer.feed

    def watched(self, piece):
        out = feed(self, piece)
        held.append(len(self.buffer))
        return out

    monkeypatch.setattr(RunTransducer, "feed", watched)
    began = time.perf_counter()
    for letters, n in (("ACGT", 600_000), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 400_000), ("=-", 100_000)):
        text = "a word " + "".join(rng.choices(letters, k=n)) + " 12"
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(held) < 3 * own.vocabulary.lookahead
    assert time.perf_counter() - began < 60


def test_decoding_of_broken_bytes(library, own):
    rng = random.Random(5)
    for _ in range(200):
        ids = [rng.randrange(256) for _ in range(20)]
        assert "".join(Decoder(own.vocabulary).decode(np.array(ids))) == library.decode(ids, skip_special_tokens=False)


def test_rows(spark, sample, odd_docs, library):
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(d["doc_id"], d["text"]) for d in sample], "doc_id long, text string"))
    expected = Counter()
    for row in docs.collect():
        text = row["text"] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected[(row["doc_id"], len(ids), sha, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in round_trip(docs, PATH).collect()) == expected
    assert all(len(r["ids"]) == r["n_tokens"] for r in encode(odd_docs, PATH).collect())
    assert round_trip(odd_docs.limit(0), PATH).count() == 0
