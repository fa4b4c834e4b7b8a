"""The same flows as streaming jobs over page files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listloom.queries.listings import ARTICLE_SQL, article_listings
from listloom.queries.registry import query, table
from listloom.session import work_dir
from listloom.sources.dims import site_images
from listloom.streaming import listings as S


def _arriving(spark: SparkSession, sf_dir: str, copies: int) -> DataFrame:
    """A stream over page files that arrive one by one."""
    pages, folder = table(spark, sf_dir, "pages"), work_dir(spark, "arriving")
    for _ in range(copies):
        pages.write.mode("append").parquet(folder)
    return S.page_stream(spark, folder, pages.schema, files_per_batch=1)


@query(ARTICLE_SQL)
def stream_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink = work_dir(spark, "listings")
    flow = lambda pages: article_listings(pages, site_images(spark))
    S.stream_listings(_arriving(spark, sf_dir, 1), flow, sink, work_dir(spark, "offsets"))
    return spark.read.parquet(sink)


@query("SELECT page_id AS code, url FROM pages")
def stream_skip_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arriving(spark, sf_dir, 2).selectExpr("page_id AS code", "url", "length(html) AS chars")
    sink = work_dir(spark, "listed")
    S.stream_skip_listed(rows, "code", "url", sink, work_dir(spark, "offsets"))
    return spark.read.parquet(sink).select("code", "url")
