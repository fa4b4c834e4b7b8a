"""Size conversion and labels on the stocked sizes of every part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listloom.functions.sizes import convert_sizes, quantity_labels
from listloom.functions.sql import each
from listloom.queries.shop_pages import size_text, stocked_sizes
from listloom.queries.base_sql import SIZE_MAP, STOCK, US
from listloom.queries.registry import query

#: Part keys divisible by this offer one size that is no number.
BAD_EVERY = 10


def _label(marked: str, x: str) -> str:
    """Size text, with a K before or after the younger sizes."""
    young = f"{x} BETWEEN 14 AND 27"
    text = size_text(x)
    return {"none": text, "after": f"concat({text}, if({young}, 'K', ''))", "before": f"concat(if({young}, 'K', ''), {text})"}[marked]


def _converted(spark: SparkSession, sf_dir: str, group: str, marked: str = "none") -> DataFrame:
    labels = each("quantities", lambda x: _label(marked, x))
    offered = stocked_sizes(spark, sf_dir).selectExpr(
        "l_partkey",
        f"if(l_partkey % {BAD_EVERY} = 0, concat({labels}, array('9D')), {labels}) AS sizes",
    )
    found = offered.selectExpr("l_partkey", f"{convert_sizes('sizes', group)} AS found")
    return found.selectExpr("l_partkey", "array_join(found, ',') AS sizes")


def _oracle(group: str, numeric: bool, label: str = US) -> str:
    match = "m.us_num = q / 2" if numeric else "m.us_key = label"
    bad = f"l_partkey % {BAD_EVERY} = 0" if numeric else "false"
    return f"""
    WITH {STOCK}, {SIZE_MAP}, offered AS (SELECT l_partkey, q, {label} AS label FROM sz)
    SELECT l_partkey, CASE WHEN {bad} THEN string_agg(label, ',' ORDER BY q) || ',9D'
        ELSE coalesce(string_agg(CAST(m.mm AS VARCHAR), ',' ORDER BY q), '') END AS sizes
    FROM offered LEFT JOIN size_map m ON m.grp = '{group}' AND {match}
    GROUP BY l_partkey
    """


AFTER = f"({US}) || CASE WHEN q BETWEEN 14 AND 27 THEN 'K' ELSE '' END"
BEFORE = f"CASE WHEN q BETWEEN 14 AND 27 THEN 'K' ELSE '' END || ({US})"


@query(_oracle("mens", True))
def size_convert_men(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(spark, sf_dir, "mens")


@query(_oracle("womens", True))
def size_convert_women(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(spark, sf_dir, "womens")


@query(_oracle("kids", True))
def size_convert_kids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(spark, sf_dir, "kids")


@query(_oracle("kids_with_k", False, AFTER))
def size_convert_kids_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(spark, sf_dir, "kids_with_k", "after")


@query(_oracle("kids_with_front_k", False, BEFORE))
def size_convert_k_kids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(spark, sf_dir, "kids_with_front_k", "before")


@query(
    f"""
    WITH {STOCK}, n AS (SELECT l_partkey, count(*) AS n FROM sz GROUP BY 1)
    SELECT l_partkey, array_to_string(list_transform(range(1, n + 1),
        lambda i: CASE WHEN i <= 9 THEN i * 11 ELSE i END), ',') AS labels, '' AS none
    FROM n
    """
)
def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = "slice(quantities, 1, 0)"
    return stocked_sizes(spark, sf_dir).select(
        "l_partkey",
        F.expr(f"array_join({quantity_labels('quantities')}, ',')").alias("labels"),
        F.expr(f"array_join({quantity_labels(nothing)}, ',')").alias("none"),
    )
