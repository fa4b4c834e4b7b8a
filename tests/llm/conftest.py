import pytest

TEXTS = [
    None,
    "",
    " \n\t",
    "one",
    "a b c",
    "Zoë said: x\x85y É é K İ",
    "a b c a b c a b c a b c",
    "x " * 400,
    "long" * 5000,
    ("w%d " * 3000) % tuple(range(3000)),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, repeated rows and ids, columns with clashing names."""
    rows = [(i, t, "row", "x") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id here", "at", None), (None, None, None, None), (3, "one", "row", "x"), (4, "other text", "n", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, row string").repartition(3)


@pytest.fixture(scope="session")
def sample():
    """Documents of the smallest given table."""
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
