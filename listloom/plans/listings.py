"""The whole flow: documents in, listing rows out.

Apart from the brand join, which Spark broadcasts while the dimension is small,
every step is narrow, so a job scales with the number of input splits.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listloom.functions.sizes import AUTO
from listloom.operators.listing import listing_row, with_html, with_static_images
from listloom.operators.rules import Rule
from listloom.plans.products import Translator, extract_fields, finish_products, keep_text
from listloom.plans.sites import SITES, Site


def make_products(
    documents: DataFrame,
    size_type: int = AUTO,
    rules: Iterable[Rule] = (),
    translator: Translator = keep_text,
    sites: Iterable[Site] = SITES,
) -> DataFrame:
    """Products of ``documents(…keys, site, kind, url, body)``.

    Name only the shops that occur: the plan, and what the parser emits, follow.
    """
    rules, sites = list(rules), list(sites)
    raw = extract_fields(documents, rules=rules, sites=sites)
    if "size_type_asked" not in raw.columns:
        raw = raw.withColumn("size_type_asked", F.lit(size_type))
    return finish_products(raw, translator, sites, rules)


def make_listings(
    documents: DataFrame,
    site_images: DataFrame,
    *keys: str,
    size_type: int = AUTO,
    rules: Iterable[Rule] = (),
    translator: Translator = keep_text,
    layout: str = "common",
    sites: Iterable[Site] = SITES,
) -> DataFrame:
    """Listing rows of the documents, with the given key columns in front."""
    products = make_products(documents, size_type, rules, translator, sites)
    complete = with_html(with_static_images(products, site_images), translator)
    return listing_row(complete, *keys, layout=layout)
