"""Filters that say which keys may be in a table, for scans whose rows are too wide to shuffle.

A filter is a Bloom filter as an array of Spark's bitmaps: a few bytes a key, made by one
small aggregation and handed to every task as an uncorrelated scalar.  Scans test it
before their rows are shuffled; what passes by chance goes on to the join itself, so
results never depend on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap, as Spark builds them.
BITMAP = 32_768
BITS_PER_KEY, HASHES = 16, 4
#: Bits of the largest filter (32 MB); with more keys it lets more pass by chance.
MAX_BITS = 1 << 28


def _places(columns: Sequence[str], bits: int) -> str:
    """The bits of a key, by double hashing that cannot overflow."""
    listed = ", ".join(columns)
    one, two = f"pmod(xxhash64({listed}), {bits})", f"pmod(xxhash64({listed}, 1), {bits})"
    return f"array({', '.join(f'pmod({one} + {i} * {two}, {bits})' for i in range(HASHES))})"


class KeyFilter:
    """Which rows may have a key that ``keys`` holds in the columns of the same names."""

    def __init__(self, keys: DataFrame, *columns: str):
        self._columns = columns
        wanted = -(-keys.count() * BITS_PER_KEY // BITMAP) * BITMAP
        self.bits = min(max(wanted, BITMAP), MAX_BITS)
        places = keys.select(F.explode(F.expr(_places(columns, self.bits))).alias("place"))
        maps = places.groupBy(F.expr(f"place div {BITMAP}").alias("at")).agg(
            F.expr(f"bitmap_construct_agg(place % {BITMAP})").alias("map")
        )
        every = keys.sparkSession.range(self.bits // BITMAP).join(maps, F.col("id") == F.col("at"), "left")
        ordered = F.array_sort(F.collect_list(F.struct("id", "map")))
        self._bitmaps: Column = every.agg(F.transform(ordered, lambda m: m["map"]).alias("maps")).scalar()

    def passing(self, df: DataFrame) -> DataFrame:
        """Rows that may have one of the keys; all that do have one, and few others."""
        byte = f"conv(hex(substring(get(_maps, cast(p div {BITMAP} AS int)), cast(p % {BITMAP} div 8 AS int) + 1, 1)), 16, 10)"
        held = f"forall({_places(self._columns, self.bits)}, p -> coalesce(bit_get(cast({byte} AS int), cast(p % 8 AS int)), 0) = 1)"
        return df.withColumn("_maps", self._bitmaps).where(held).select(*df.columns)
