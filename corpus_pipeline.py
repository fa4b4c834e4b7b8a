"""From raw documents to tokens: quality, near copies, benchmark leaks, secrets, BPE.

Every stage works on all rows its predecessor kept and takes effect on them.  All but
the last return the columns they were given, other columns included.

Missing, empty and short texts fail the quality rules and go there; a text of any length
is judged whole.  Of similar documents the one of the least id stays, a missing id last,
and of equal ids the row written first; repeated rows count as copies.  Rows with missing
ids are masked and encoded like others.  An empty table goes through as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from listloom.llm.bpe import encode
from listloom.llm.jaccard import keep_one
from listloom.llm.leaks import drop_leaks
from listloom.llm.queries import prepare, table, tokenizer_path
from listloom.llm.repetition import keep_varied
from listloom.llm.secrets import mask_secrets
from listloom.llm.tables import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    prepare(spark)
    return keep_varied(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    prepare(spark)
    return keep_one(docs, n=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    prepare(spark)
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets masked."""
    prepare(spark)
    return mask_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    prepare(spark)
    return encode(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("leaks", leaks),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: SQL cannot express suffix arrays, the random field or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
