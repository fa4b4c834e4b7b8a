"""Ordered positions and running totals that no single task has to see whole.

A plain ``row_number()`` over everything, or over one hot group, sorts it in one
task.  Here rows are cut into ranges of the order itself: Spark samples the order
and deals rows by quantiles, so dense, sparse and crowded values spread alike.
Ranges are written once, each sorted, with their number and the place of each row in
them.  A position is then a place plus what earlier ranges hold of the same key.

Those totals have two levels: a range adds to a block of about as many ranges as
there are blocks, so a task sums the blocks of a key or the ranges of a block, never
all ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listloom.session import work_dir

#: Bits of a generated row id that count rows within a partition.
PLACE_BITS = 33


def range_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int) -> DataFrame:
    """Rows with ``_key``, their range ``_range`` and their place ``_place`` (from 0) in it, written once.

    Ties are ordered as they are read and cut like any other rows, so one crowded
    value fills as many ranges as it needs.
    """
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    marked = df.withColumn("_key", key).withColumn("_tie", F.monotonically_increasing_id())
    by = ["_key", *order, "_tie"]
    ordered = marked.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    numbered = ordered.withColumn("_id", F.monotonically_increasing_id())
    places = numbered.withColumn("_range", F.shiftright("_id", PLACE_BITS).cast("int")).withColumn(
        "_place", F.col("_id").bitwiseAND((1 << PLACE_BITS) - 1)
    )
    path = work_dir(df.sparkSession, "ranges")
    places.drop("_tie", "_id").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _earlier(sums: DataFrame, totals: Sequence[str], ranges: int) -> DataFrame:
    """Of each key and range, the totals of the key in earlier ranges, by two levels."""
    width = max(1, isqrt(ranges))
    blocked = sums.withColumn("_block", F.expr(f"_range div {width}"))
    before_block = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy("_key", "_block").agg(*[F.sum(t).alias(t) for t in totals]).select(
        "_key", "_block", *[F.coalesce(F.sum(t).over(before_block), F.lit(0)).alias(f"_b{t}") for t in totals]
    )
    before_range = Window.partitionBy("_key", "_block").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    within = blocked.select(
        "*", *[F.coalesce(F.sum(t).over(before_range), F.lit(0)).alias(f"_r{t}") for t in totals]
    )
    kept = [c for c in sums.columns if c not in totals]
    return within.join(blocks, ["_key", "_block"]).select(
        *kept, *[(F.col(f"_b{t}") + F.col(f"_r{t}")).alias(t) for t in totals]
    )


def with_running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, str], ranges: int | None = None
) -> DataFrame:
    """Add running totals of the rows before each row, within ``keys`` by ``order``.

    ``totals`` maps new columns to integer expressions.  Rows without a key form a
    key of their own; among equal ``order`` values the order is any.
    """
    ranges = ranges or range_count(df.sparkSession)
    placed = in_ranges(df, keys, order, ranges)
    own = [f"_sum_{n}" for n in totals]
    sums = placed.groupBy("_key", "_range").agg(*[F.sum(F.expr(v)).alias(s) for s, v in zip(own, totals.values())])
    inside = Window.partitionBy("_key", "_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(_earlier(sums, own, ranges), ["_key", "_range"]).select(
        *df.columns,
        *[
            (F.col(s) + F.coalesce(F.sum(F.expr(v)).over(inside), F.lit(0))).alias(n)
            for s, (n, v) in zip(own, totals.items())
        ],
    )


def with_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank", ranges: int | None = None
) -> DataFrame:
    """Add the 1-based position within ``keys`` by ``order``; rows are shuffled once, for their ranges."""
    ranges = ranges or range_count(df.sparkSession)
    placed = in_ranges(df, keys, order, ranges)
    sums = placed.groupBy("_key", "_range").agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    return placed.join(_earlier(sums, ["_rows"], ranges), ["_key", "_range"]).select(
        *df.columns, (F.col("_rows") + F.col("_place") - F.col("_first") + 1).alias(name)
    )
