import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from listloom.llm.merkle import fold, leaf_digest, manifest_report, proofs
from listloom.llm.queries import QUERIES


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    if values[3] is not None:
        values[3] += more
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves, width):
    """Top of a tree and, of each leaf, its runs and places from below."""
    paths = [[] for _ in leaves]
    at = list(range(len(leaves)))
    while len(leaves) > 1:
        runs = [leaves[i : i + width] for i in range(0, len(leaves), width)]
        for path, i in zip(paths, at):
            path.append((runs[i // width], i % width))
        at, leaves = [i // width for i in at], [H(*run) for run in runs]
    return (leaves[0] if leaves else None), paths


def brute(rows, width=2):
    groups = defaultdict(list)
    for row in rows:
        groups[row["lang"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    lower = {g: tree([m[2] for m in sorted(groups[g], key=lambda m: m[:3])], width) for g in order}
    root, upper = tree([lower[g][0] for g in order], width)
    out = []
    for g, above in zip(order, upper):
        for (_, _, leaf, row), path in zip(sorted(groups[g], key=lambda m: m[:3]), lower[g][1]):
            path = path + above
            siblings = [s for run, i in path for s in run[:i] + run[i + 1 :]]
            shown = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            folded = leaf_of(row, 1) if shown else leaf
            for run, i in path:
                folded = H(*run[:i], folded, *run[i + 1 :])
            out.append((row["doc_id"], leaf, lower[g][0], root, H(*siblings), folded, folded == root))
    return Counter(out)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def report(docs):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest_report(docs, tampered, leaf_digest(*[F.expr(e) for e in ("doc_id", "source", "lang", "n_chars + 1", "text")]))


def found(frame):
    return Counter(tuple(r[c] for c in COLUMNS) for r in frame.collect())


def test_query_equals_brute_force(spark, sample):
    got = found(QUERIES["op11_pointer_jumping"](spark, "/root/testdata/sf0.001"))
    assert got == brute(sample)
    assert {r[-1] for r in got} == {True, False}


def test_odd_rows(spark, odd_docs):
    docs = odd_docs.selectExpr("*", "if(doc_id % 3 = 0, NULL, concat('é', doc_id % 2)) AS lang", "word AS source",
                               "if(doc_id % 4 = 0, NULL, length(text)) AS n_chars", "1 AS tree", "2 AS idx", "3 AS leaf")
    docs = docs.withColumn("n_chars", F.col("n_chars").cast("long"))
    assert found(report(docs)) == brute([r.asDict() for r in docs.collect()])
    empty = report(docs.limit(0))
    assert empty.count() == 0 and set(empty.columns) == set(COLUMNS)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [3, 1, 2], [2500], [1030, 1, 7, 64, 5], [1] * 40])
def test_tree_shapes(spark, sizes):
    """Lone leaves, one group, groups of many heights, many groups; more leaves than a block."""
    rows = [
        {"doc_id": 7 * i + g, "source": None, "lang": f"g{g:02}" if g else None, "n_chars": i, "text": f"t{i}"}
        for g, n in enumerate(sizes) for i in range(n)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert found(report(docs)) == brute(rows)


def test_wider_runs(spark):
    """The operator takes runs of any width; its proofs fold to the root."""
    rows = [{"doc_id": i, "source": "s", "lang": "a" if i % 5 else "b", "n_chars": 1, "text": str(i)} for i in range(300)]
    frame = spark.createDataFrame([(r["doc_id"], r["lang"], leaf_of(r)) for r in rows], "doc_id long, lang string, leaf string")
    got = proofs(frame, "lang", "doc_id", width=3).withColumn("folded", fold(F.col("leaf"), F.col("proof"))).collect()
    want = {r[0]: r for r in brute(rows, 3)}
    assert len(got) == 300
    for r in got:
        assert (r["subroot"], r["root"], r["folded"]) == (want[r["doc_id"]][2], want[r["doc_id"]][3], r["root"])
        assert H(*[s["others"].hex() for s in r["proof"]]) == want[r["doc_id"]][4]
