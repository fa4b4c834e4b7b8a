"""Saved pages: lookup, misses, append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listloom.functions.urls import snapshot_key

# Fixed value: a saved page shorter than this counts as missing.
MIN_HTML_CHARS = 100


def with_snapshot_key(pages: DataFrame, extension: str = "html", n_hex: int = 64) -> DataFrame:
    """Add ``key`` from ``site`` and ``url``: the whole digest, so that no two pages share a key."""
    return pages.withColumn("key", F.expr(snapshot_key("site", "url", extension, n_hex)))


def usable(snapshots: DataFrame) -> DataFrame:
    """Saved pages long enough; a store with the column ``chars`` is judged without reading its pages."""
    return snapshots.where((F.col("chars") if "chars" in snapshots.columns else F.length("html")) >= MIN_HTML_CHARS)


def snapshot_lookup(wanted: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows of ``wanted(…, key)`` with the saved ``html``."""
    return wanted.join(usable(snapshots).select("key", "html"), "key")


def cache_misses(wanted: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows without a usable saved page; of a written store only key and length are read."""
    return wanted.join(usable(snapshots).select("key"), "key", "left_anti")


def write_snapshots(pages: DataFrame, path: str, saved: DataFrame | None = None) -> None:
    """Append pages ``(site, url, html, key)`` with their length ``chars`` once per key, in one folder per site.

    Keys already saved are left out.  Of several pages under one key the first by
    URL stays, then the longest, then the least digest.  The choice is made on these
    narrow columns; only chosen bodies move.  Sites are written by evened partitions.
    """
    marks = ["key", "url", "chars", "digest"]
    marked = pages.select("site", "url", "html", "key").withColumns(
        {"chars": F.length("html"), "digest": F.xxhash64("html")}
    )
    least = F.min(F.struct(F.col("url").isNull().alias("none"), "url", (-F.col("chars")).alias("less"), "digest"))
    first = marked.groupBy("key").agg(least.alias("first")).select(
        "key", "first.url", (-F.col("first.less")).alias("chars"), "first.digest"
    )
    if saved is not None:
        first = cache_misses(first, saved)
    chosen = [marked[c].eqNullSafe(first[c]) for c in marks]
    fresh = marked.join(first, chosen, "left_semi").dropDuplicates(marks).drop("digest")
    fresh.hint("rebalance", "site").write.mode("append").partitionBy("site").parquet(path)
