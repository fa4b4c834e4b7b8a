import hashlib
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest

from listloom.llm.queries import QUERIES
from listloom.llm.secrets import KINDS, Field, fit, mask_secrets, scan, secret_report, train
from listloom.llm.words import texts_of

VALUE = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


@pytest.fixture(scope="module")
def larger():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()


def brute(text):
    text, spans = text or "", []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest()), joined


def test_query_equals_brute_force(spark, larger):
    rows = QUERIES["op5_crf_secrets"](spark, "/root/testdata/sf0.01").collect()
    assert Counter((r[0], *r[1:5]) for r in rows) == Counter((d["doc_id"], *brute(d["text"])[0]) for d in larger)
    joined = {d["doc_id"]: brute(d["text"])[1] for d in larger}
    for row in rows:
        assert set(joined[row["doc_id"]].split(",")) - {""} <= set(row["spans"].split(","))
    assert any(r["n_assign"] for r in rows)


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(1)
    import pyarrow as pa

    texts = texts_of(pa.array(["a bb token = x9 c", "password", "q w e r"]))
    from listloom.llm.secrets import CLASSES, token_classes

    data = texts.data.tobytes()
    words, classes, file = token_classes(texts, data, data)
    for scale in (0.5, 4):
        field = Field(*(rng.normal(0, scale, s) for s in ((CLASSES, 3), (CLASSES, 3), (CLASSES, 3), (3, 3))), rng.normal(0, 1, (3, 3)))
        scores, got = field.scores(words, classes, file), field.tags(words, classes, file)
        for i in range(3):
            at = range(words.first[i], words.first[i + 1])
            total = lambda p: sum(scores[j, t] for j, t in zip(at, p)) + sum(field.move[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
            assert tuple(got[list(at)]) == max(product(range(3), repeat=len(at)), key=total)


def test_field_adds_what_patterns_miss(spark, larger, odd_docs):
    docs = spark.createDataFrame([(d["doc_id"], d["text"]) for d in larger], "doc_id long, text string")
    field = train(docs)
    import pyarrow as pa

    texts = [f"so the token is \"{VALUE[:20].upper()}x9\" and so on", "the token was lost and the secret is out of the bag today", f"a token = \"{VALUE}\" b", None]
    found = scan(texts_of(pa.array(texts)), field)
    assert [k for _, _, k in found[0]] == [3] and not found[1] and not found[3]
    rows = odd_docs.unionByName(spark.createDataFrame([(50, f"é token = \"{VALUE}\" z", None, None)], odd_docs.schema))
    got = Counter((r[0], *r[1:5]) for r in secret_report(rows, field=field).collect())
    assert got == Counter((r["doc_id"], *brute(r["text"])[0]) for r in rows.collect())
    hidden = {r["doc_id"]: r["text"] for r in mask_secrets(rows, field=field).collect()}
    assert hidden[50] == 'é [secret]" z' and hidden[3] == "one" and mask_secrets(rows, field=field).schema == rows.schema
    assert secret_report(odd_docs.limit(0)).count() == 0
    assert fit([]).tags(*_empty()).tolist() == []


def _tagging_all():
    from listloom.llm.secrets import CLASSES

    own = np.zeros((CLASSES, 3))
    own[:, 2] = 1.0
    return Field(own, *(np.zeros((CLASSES, 3)) for _ in range(2)), np.zeros((3, 3)), np.zeros((3, 3)))


def test_neighbouring_texts_do_not_matter():
    """Runs and names that begin in the text before neither hide nor make anything."""
    import pyarrow as pa

    texts = []
    for key in (VALUE, VALUE[:24], VALUE[:32], "AKIA" + "Q7" * 8):
        texts += [x for end in (*(VALUE[:n] for n in range(1, 24)), "see the", "AKI", "api AK") for x in (end, key, key + " x")]
    texts += ["to", "ken: abcdefgh", "pass", "word = abcdefgh", "", None, VALUE]
    outside = fit([])
    found = scan(texts_of(pa.array(texts)), outside)
    joined = [",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans) for spans in found]
    assert joined == [brute(t)[1] for t in texts]

    from listloom.llm.secrets import token_classes

    cut = texts_of(pa.array(["a to", "ken x", "my token x"]))
    data = cut.data.tobytes()
    assert (token_classes(cut, data, data)[1] % 2).tolist() == [0, 0, 0, 0, 0, 1, 0]


def test_field_spans_that_touch_patterns():
    """What a pattern leaves of a span of the field stays; closing quotes alone do not."""
    import pyarrow as pa

    texts = ["password: Tr0ub4dor&3xyz", "é password: Tr0ub4dor&3xyz", f'token = "{VALUE}"', "(secret=abcdef!!)", f"é{VALUE}é", f'token = "{VALUE}"&x z', "token: abcdef&g hi"]
    found = scan(texts_of(pa.array(texts)), _tagging_all())
    assert found[0] == [(0, 19, 0), (19, 24, 3)]
    assert found[1] == [(0, 1, 3), (2, 21, 0), (21, 26, 3)]
    assert found[2] == [(0, 49, 0), (9, 49, 2)]
    assert found[3] == [(1, 14, 0), (14, 17, 3)]
    assert found[4] == [(0, 1, 3), (1, 41, 2), (41, 42, 3)]
    assert found[5] == [(0, 49, 0), (9, 49, 2), (49, 52, 3)]
    assert found[6] == [(0, 13, 0), (13, 18, 3)]
    odd = [f'token = "{VALUE}"###', f"token = '{VALUE}'!! x", "### !!"]
    found = scan(texts_of(pa.array(odd)), _tagging_all())
    assert found[0] == [(0, 49, 0), (9, 49, 2)] and (49, 52, 3) not in found[1] and not found[2]


def _empty():
    import pyarrow as pa

    from listloom.llm.secrets import token_classes

    return token_classes(texts_of(pa.array([""])), b"", b"")
