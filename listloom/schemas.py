"""Schemas of the tables that operators hand to each other."""

from __future__ import annotations

from pyspark.sql import types as T

#: One element of a page, in document order.  ``path`` holds the array positions
#: of its kept ancestors (root first), ``parent`` the position of its direct
#: parent or -1.  Text is not repeated per element: ``piece_from``/``piece_to``
#: point into the page's list of text pieces.
NODE = T.StructType(
    [
        T.StructField("node_id", T.IntegerType(), False),
        T.StructField("parent", T.IntegerType(), False),
        T.StructField("path", T.ArrayType(T.IntegerType(), False), False),
        T.StructField("tag", T.StringType(), False),
        T.StructField("id", T.StringType(), True),
        T.StructField("classes", T.ArrayType(T.StringType(), False), False),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType(), False), False),
        T.StructField("nth_of_type", T.IntegerType(), False),
        T.StructField("nth_last_of_type", T.IntegerType(), False),
        T.StructField("piece_from", T.IntegerType(), False),
        T.StructField("piece_to", T.IntegerType(), False),
        T.StructField("single", T.BooleanType(), False),
    ]
)

# Kinds of text pieces.
TEXT, RAW, COMMENT = 0, 1, 2

PIECE = T.StructType(
    [
        T.StructField("kind", T.IntegerType(), False),
        T.StructField("text", T.StringType(), False),
    ]
)

#: What :func:`listloom.sources.pages.parse_pages` adds to a page.
DOM_FIELDS = [
    T.StructField("nodes", T.ArrayType(NODE, False), False),
    T.StructField("pieces", T.ArrayType(PIECE, False), False),
    T.StructField("parse_error", T.StringType(), True),
]

#: Extracted product fields with the type of each; the default is '' or [].
PRODUCT_FIELDS = {
    "product_name": "string",
    "product_name_ko": "string",
    "brand_name": "string",
    "price": "string",
    "size_options": "array<string>",
    "size_type": "string",
    "images": "array<string>",
    "descriptions": "struct<titles:array<string>,bullets:array<string>>",
    "description_images": "array<string>",
    "color_name": "string",
    "color_urls": "array<string>",
}

#: Sheet columns of a listing row.
LISTING_COLUMNS = list("ABCDEFGHIJKLMNOPQRSTUV")
