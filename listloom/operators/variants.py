"""Work lists: batches of URLs, colour variants, row positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listloom.functions.urls import is_url
from listloom.operators.ranking import with_running_total


def read_url_batch(urls: DataFrame, start: int, size: int) -> DataFrame:
    """Rows ``start`` … ``start + size - 1`` of ``urls(pos, url)`` that hold a URL."""
    return urls.where(f"pos BETWEEN {start} AND {start + size - 1} AND coalesce(url, '') <> '' AND {is_url('url')}")


def with_batch(urls: DataFrame, start: int, size: int) -> DataFrame:
    """Usable rows of ``urls(pos, url)`` from ``start`` on with the number of their batch.

    ``batch`` counts from 0 and ``start_row`` is the first row of the batch, as
    stepping through the list batch by batch would see it.
    """
    usable = urls.where(f"pos >= {start} AND coalesce(url, '') <> '' AND {is_url('url')}")
    return usable.selectExpr("*", f"(pos - {start}) div {size} AS batch").selectExpr(
        "*", f"{start} + batch * {size} AS start_row"
    )


def next_start(start: int, size: int) -> int:
    """First row of the following batch."""
    return start + size


def next_target_row(target: int, written: int, size: int, appended: int, gap_mode: str = "dense") -> int:
    """Where the following block goes.

    ``dense`` goes on right below the rows written; ``reference`` counts the batch
    size, so skipped cells leave blank rows.
    """
    if gap_mode == "dense":
        return target + written
    if gap_mode == "reference":
        return target + size + appended
    raise ValueError(f"unknown gap mode {gap_mode!r}")


def expand_variants(products: DataFrame, *keys: str) -> DataFrame:
    """One row per URL to list: the page itself, then its colour links in order.

    ``sub_pos`` is 0 for the page.  Variants are not expanded again and not
    deduplicated.  Narrow: one explode of the row's own list.
    """
    return products.select(
        *keys, F.posexplode(F.expr("concat(array(url), color_urls)")).alias("sub_pos", "url")
    ).withColumn("is_variant", F.col("sub_pos") > 0)


def listing_positions(products: DataFrame, target_row: int, start_row: int = 1) -> DataFrame:
    """Expanded work list with its place in the sheet and a progress label.

    ``products(pos, url, color_urls)``.  Ranks come from running totals over the
    originals, before the expansion.  ``progress`` reads ``i/n (S{cell})`` as seen
    when the row is worked on: ``n`` and the cell count the variants known by then,
    and a page's own variants are known from its first variant on.
    """
    sized = products.withColumn("_variants", F.size("color_urls").cast("bigint"))
    placed = with_running_total(sized, [], ["pos"], {"_originals_before": "1", "_variants_before": "_variants"})
    count = products.agg(F.count("*")).scalar()
    rows = expand_variants(placed, "pos", "_variants", "_originals_before", "_variants_before")
    index = F.expr("_originals_before + _variants_before + sub_pos")
    known = F.expr("_variants_before + if(is_variant, _variants, 0)")
    return rows.select(
        "pos", "sub_pos", "url", "is_variant",
        (index + target_row).alias("row_no"),
        F.concat(
            (index + 1).cast("string"), F.lit("/"), (count + known).cast("string"), F.lit(" (S"),
            (F.lit(start_row) + index - known).cast("string"), F.lit(")"),
        ).alias("progress"),
    )


def batch_counts(products: DataFrame) -> DataFrame:
    """Rows uploaded with and without colour rows."""
    return products.agg(
        F.count("*").alias("pages"),
        F.coalesce(F.sum(F.size("color_urls")), F.lit(0)).alias("color_rows"),
        (F.count("*") + F.coalesce(F.sum(F.size("color_urls")), F.lit(0))).alias("rows"),
    )


def not_listed(products: DataFrame, listed: DataFrame, code: str = "code") -> DataFrame:
    """Products whose code is not in the sink yet."""
    return products.join(listed.select(code), code, "left_anti")
