import re
from collections import Counter

from listloom.llm.licenses import PHRASES, TEMPLATES, license_report
from listloom.llm.queries import QUERIES

UPPER = {c: c + 32 for c in range(65, 91)}


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    at = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return (len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))


def test_base_equals_brute_force(spark, sample):
    rows = QUERIES["op7_license_index"](spark, "/root/testdata/sf0.001").collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows)
    assert got == Counter((d["doc_id"], *base(d["text"])) for d in sample)
    for row in rows:
        assert set(row["base_labels"].split(",")) - {""} <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1


def test_templates_and_odd_rows(spark, odd_docs):
    filler = "nothing of the kind here "
    texts = {
        100: filler + "Released under the MIT License. " + filler,
        101: filler + "This work is licensed under the GNU General Public License, version 3.",
        102: "mit and license, far apart and released " + filler,
        103: "Licensed under CC BY-NC 4.0. All rights reserved.",
        104: "Licensed under the Apache License, Version 2.0",
        105: "general public—license",
    }
    extra = spark.createDataFrame([(k, v, None, None) for k, v in texts.items()], odd_docs.schema)
    docs = odd_docs.unionByName(extra)
    rows = license_report(docs).collect()
    labels = {r["doc_id"]: r["labels"] for r in rows if r["doc_id"] and r["doc_id"] >= 100}
    assert labels == {100: "mit", 101: "gpl,gpl-3.0", 102: "", 103: "cc-by,cc-by-nc-4.0,reserved", 104: "apache-2.0", 105: ""}
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows)
    assert got == Counter((r["doc_id"], *base(r["text"])) for r in docs.collect())
    assert license_report(docs.limit(0)).count() == 0


def test_all_notices_of_a_file(spark):
    """Any number of notices in one text, whatever other licence words it holds."""
    notice = lambda *labels: ". And then\n".join(TEMPLATES[label][0] for label in labels)
    rare = " affero mozilla unencumbered lesser attribution copy redistribution noncommercial"
    texts = [notice(*TEMPLATES), notice("apache-2.0", "bsd", "mit"), notice("mit") + rare, rare, notice("isc", "mit", "isc") + rare]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = {r["doc_id"]: r["labels"] for r in license_report(docs).collect()}
    assert labels == {0: ",".join(sorted({*TEMPLATES, "cc-by", "gpl"})), 1: "apache-2.0,bsd,mit", 2: "mit", 3: "", 4: "isc,mit"}
