"""Request attempts and their outcome."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: attempts per URL; the last one goes without the proxy.
MAX_ATTEMPTS = 4


def first_success(attempts: DataFrame, key: str, order: Sequence[str], ok: str) -> DataFrame:
    """Outcome per key: the first successful attempt among the first four.

    Returns ``(key, tries, success, attempt, direct)``: attempts made until the
    end, whether one succeeded, which one, and whether it went without the proxy.
    A missing status is a failure.  Spark limits each key to four rows before the
    shuffle, so a key with very many attempts does no harm.
    """
    ranked = attempts.withColumn(
        "attempt", F.row_number().over(Window.partitionBy(key).orderBy(*order))
    ).where(F.col("attempt") <= MAX_ATTEMPTS)
    good = F.when(F.expr(f"coalesce({ok}, false)"), F.col("attempt"))
    outcome = ranked.groupBy(key).agg(F.min(good).alias("attempt"), F.count("*").alias("_made"))
    return outcome.select(
        key,
        F.coalesce(F.col("attempt").cast("bigint"), F.col("_made")).alias("tries"),
        F.col("attempt").isNotNull().alias("success"),
        "attempt",
        F.coalesce(F.col("attempt") == MAX_ATTEMPTS, F.lit(False)).alias("direct"),
    )
