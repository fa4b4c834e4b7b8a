from collections import Counter

import corpus_pipeline
import public_tokenizers
import pyarrow.parquet as pq
from test_jaccard import brute as brute_groups
from test_leaks import words_of
from test_repetition import brute as brute_quality
from tokenizers import Tokenizer

from listloom.llm.tables import stored


def test_stages_take_effect(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [words_of(r["text"]) for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()]
    leaked = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9))}
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stored(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns
        if name == "quality":
            rows = [r for r in rows if brute_quality(r["text"])[-1]]
        elif name == "near_copies":
            least = {c for _, _, c in brute_groups([(r["doc_id"], r["text"]) for r in rows], 5, 80)}
            rows = [r for r in rows if r["doc_id"] in least]
        else:
            rows = [r for r in rows if not any(tuple(w[i : i + 10]) in leaked for w in [words_of(r["text"])] for i in range(len(w) - 9))]
        assert Counter(map(tuple, out.collect())) == Counter(map(tuple, rows)), name
        docs = out
    hidden = stored(corpus_pipeline.secrets(spark, docs, sf_dir), "secrets")
    assert hidden.columns == docs.columns and hidden.count() == len(rows)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter((r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in hidden.collect())
    got = corpus_pipeline.tokens(spark, hidden, sf_dir).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == expected
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(r["doc_id"] for r in got)


def test_odd_and_empty_tables(spark, odd_docs):
    """Of the odd rows only one has words enough that do not repeat; it goes through whole. Nothing stays nothing."""
    varied = {r["doc_id"]: r["text"] for r in odd_docs.collect() if len(set((r["text"] or "").split())) > 50}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for frame, left in ((odd_docs, varied), (odd_docs.limit(0), {})):
        docs = stored(frame, "odd")
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), name)
            if name != "tokens":
                assert docs.columns == frame.columns, name
        got = {r["doc_id"]: r["ids"] for r in docs.collect()}
        assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in left.items()} and len(got) == len(left)
