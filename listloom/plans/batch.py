"""Batches from start to end: work list in, sheet with new rows out."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listloom.functions.sizes import AUTO
from listloom.operators.listing import listing_row, with_html, with_static_images
from listloom.operators.ranking import range_count
from listloom.operators.rules import Rule
from listloom.operators.variants import (
    batch_counts,
    listing_positions,
    next_start,
    next_target_row,
    read_url_batch,
)
from listloom.plans.listings import make_products
from listloom.plans.products import Translator, keep_text
from listloom.plans.sites import SITES, Site
from listloom.session import work_dir
from listloom.sources.pages import choose_document
from listloom.sources.sheets import Sheet, insert_rows


@dataclass(frozen=True)
class Sources:
    """Tables a batch reads: saved pages ``(url, body)`` of each kind, abilities, images."""

    capabilities: DataFrame
    json_pages: DataFrame
    rendered_pages: DataFrame
    raw_pages: DataFrame
    site_images: DataFrame


@dataclass(frozen=True)
class Laid:
    """Rows a batch lists, by their number in the sheet, and where the next batch goes on."""

    rows: DataFrame
    next_start: int
    next_target_row: int

    def block(self, target_row: int) -> DataFrame:
        return self.rows.withColumn("rank", F.col("row_no") - (target_row - 1)).drop("row_no")


@dataclass(frozen=True)
class Batch:
    """Result of a batch and where the next one goes on."""

    sheet: DataFrame
    rows: DataFrame
    next_start: int
    next_target_row: int


def _stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so pages are parsed once."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def lay_out(
    urls: DataFrame,
    sources: Sources,
    start: int,
    size: int,
    target_row: int,
    *,
    size_type: int = AUTO,
    expand_colors: bool = True,
    rules: Iterable[Rule] = (),
    sites: Iterable[Site] = SITES,
    translator: Translator = keep_text,
    gap_mode: str = "dense",
) -> Laid:
    """Rows for positions ``start`` … of ``urls(pos, site, url)``, numbered from ``target_row`` on.

    Pages and the colour variants they link to are looked up, extracted and laid
    out in order; variants are not expanded again.  A URL without a saved page
    gives a row of defaults.  Products are written once before they are used
    several times.
    """
    rules, sites = tuple(rules), tuple(sites)

    # A work list is narrow and may be one split; its pages are read by all cores, also if they come by broadcast.
    spark = urls.sparkSession
    tasks = max(range_count(spark), spark.sparkContext.defaultParallelism)

    def products_of(work: DataFrame) -> DataFrame:
        documents = choose_document(
            work.repartition(tasks), sources.capabilities, sources.json_pages, sources.rendered_pages, sources.raw_pages
        )
        return make_products(documents, size_type, rules, translator, sites)

    own = _stored(products_of(read_url_batch(urls, start, size)), "products")
    found = own.select("pos", "site", "url", "color_urls")
    if not expand_colors:
        found = found.withColumn("color_urls", F.slice("color_urls", 1, 0))
    counts = batch_counts(found).first()
    places = _stored(
        listing_positions(found.drop("site"), target_row, start).join(found.select("pos", "site"), "pos"), "places"
    )
    placed = own.join(places.where(~F.col("is_variant")).select("pos", "row_no"), "pos")
    variants = products_of(places.where("is_variant").select("pos", "row_no", "site", "url"))
    listed = placed.unionByName(variants)
    complete = with_html(with_static_images(listed, sources.site_images), translator)
    rows = _stored(listing_row(complete, "row_no"), "rows")
    return Laid(
        rows,
        next_start(start, size),
        next_target_row(target_row, counts["rows"], size, counts["color_rows"], gap_mode),
    )


def run_batch(
    urls: DataFrame, sheet: DataFrame, sources: Sources, start: int, size: int, target_row: int, **options
) -> Batch:
    """One batch (see :func:`lay_out`) put into a table ``sheet(row_no, A … V)``."""
    laid = lay_out(urls, sources, start, size, target_row, **options)
    rows = insert_rows(sheet, laid.block(target_row), target_row)
    return Batch(rows, laid.rows, laid.next_start, laid.next_target_row)


def run_batches(
    urls: DataFrame,
    sheet: Sheet,
    sources: Sources,
    start: int,
    size: int,
    target_row: int,
    batches: int | None = None,
    **options,
) -> int:
    """Batch after batch into a sheet until the work list ends; how many were done now.

    ``start``, ``size`` and ``target_row`` say how the first batch begins.  Each one
    leaves in the sheet where the next goes on, so a stopped run that is called again
    continues after its last committed batch and lists nothing twice.
    """
    last = urls.agg(F.max("pos")).first()[0]
    done = number = 0
    noted = [line[4] for line in sheet.offsets()[1] if line[4]]
    if noted:
        latest = max(noted, key=lambda n: n["batch"])
        number, start, target_row = latest["batch"] + 1, latest["next_start"], latest["next_target_row"]
    while last is not None and start <= last and (batches is None or done < batches):
        laid = lay_out(urls, sources, start, size, target_row, **options)
        after = {"batch": number, "next_start": laid.next_start, "next_target_row": laid.next_target_row}
        sheet.insert(laid.block(target_row), target_row, f"batch-{number:06}", after)
        start, target_row, number, done = laid.next_start, laid.next_target_row, number + 1, done + 1
    return done
