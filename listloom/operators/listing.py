"""Products to listing rows and their body."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listloom.functions.listing_html import listing_html
from listloom.functions.sql import NO_TEXTS, each
from listloom.operators.joins import small_side
from listloom.schemas import LISTING_COLUMNS
from listloom.sources.dims import default_images


def with_static_images(products: DataFrame, site_images: DataFrame, brand: str = "brand_name") -> DataFrame:
    """Add ``top``, ``middle``, ``end`` image lists of the brand.

    A brand that is not in the dimension takes the default lists; a brand that is
    there with empty lists takes nothing.  The dimension is broadcast if its
    counted size allows it, so products are not shuffled by brand.
    """
    lists = default_images()
    known = site_images.selectExpr("brand AS _brand", "true AS _known", *[f"`{n}` AS _{n}" for n in lists])
    joined = products.join(small_side(known), products[brand] == known["_brand"], "left")
    picked = [f"if(_known, coalesce(_{n}, {NO_TEXTS}), {default}) AS `{n}`" for n, default in lists.items()]
    return joined.selectExpr(*products.columns, *picked)


def with_html(products: DataFrame, translator: Callable[[str], str]) -> DataFrame:
    """Add the listing body; needs the static images."""
    body = listing_html(
        "brand_name_ko",
        "images",
        each("descriptions.titles", translator),
        each("descriptions.bullets", translator),
        "description_images",
        "top",
        "middle",
        "`end`",
    )
    return products.withColumn("html", F.expr(body))


def joined(values: str) -> str:
    """List cell of the sheet."""
    return f"coalesce(array_join({values}, ','), '')"


def listing_row(products: DataFrame, *keys: str, layout: str = "common") -> DataFrame:
    """Project the 22 sheet columns ``A`` … ``V``; empty cells are ''.

    ``layout='kids'`` fills only title, price, title image and body and ends at T.
    """
    cells = {"C": "full_title", "E": "price", "R": "title_image", "T": "html"}
    names = LISTING_COLUMNS
    if layout == "kids":
        names = LISTING_COLUMNS[:20]
    elif layout == "common":
        cells |= {
            "J": joined("size_options"),
            "L": joined("size_quantity_options"),
            "S": "url",
            "U": "brand_name_ko",
            "V": "brand_name_ko",
        }
    else:
        raise ValueError(f"unknown layout {layout!r}")
    row = [f"coalesce({cells[n]}, '') AS {n}" if n in cells else f"'' AS {n}" for n in names]
    return products.selectExpr(*keys, *row)
