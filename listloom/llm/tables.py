"""Intermediate tables in the folder all executors share, and broadcasts of checked size."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listloom.session import work_dir

#: Bytes a side may have to be copied to every executor, and what a row adds.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64


def stored(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write a table once below ``spark.checkpoint.dir`` and read it back.

    What follows reads the files, so a lost executor costs no more than its tasks,
    and row ids given while writing stay as they are.
    """
    spark: SparkSession = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """(row, kept): ids given to rows and written with all their columns, once.

    Ids given while reading depend on how files are split, which follows the cores that
    are there; those read back are the same in every later job.
    """
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("kept")), label, "zstd")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs within leave no shuffle files behind when they are done."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fits_broadcast(df: DataFrame, *strings: str, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table, with the text of the named columns, is small enough to copy everywhere."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in strings), F.lit(ROW_BYTES))
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit
