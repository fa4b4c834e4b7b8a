"""Joins with tables that are small until proven otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes a side may have to be copied to every executor.
MAX_BROADCAST = 100_000
MAX_BYTES = 32 << 20


def fits(df: DataFrame, max_rows: int = MAX_BROADCAST, max_bytes: int = MAX_BYTES) -> bool:
    """True when a table has at most so many rows and bytes (of its rows as JSON); reads no more rows than that."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, size = df.select(width.alias("width")).limit(max_rows + 1).agg(F.count("*"), F.sum("width")).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST) -> DataFrame:
    """Mark a join side for broadcast if its counted rows and bytes allow it.

    A larger one is returned as it is: Spark then joins by shuffle, and adaptive
    execution splits keys that hold very many rows.
    """
    return F.broadcast(df) if fits(df, max_rows) else df
