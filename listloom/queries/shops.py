"""Round trips: render every part as a shop page, extract it, compare with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listloom.functions.sql import each
from listloom.functions.urls import file_extension, file_stem
from listloom.operators.dom import Page
from listloom.plans.products import extract_fields, finish_products
from listloom.queries.shop_pages import catalogue, option_json, shop_documents, sku_json
from listloom.plans.sites import OPTION_JSON, SKU_JSON, in_stock_labels, sku_quantities
from listloom.queries.base_sql import STOCK, expecting
from listloom.queries.registry import query
from listloom.sources.pages import parse_pages


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shop_documents(catalogue(spark, sf_dir))


def raw_fields(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    return extract_fields(documents(spark, sf_dir), fields)


@query(expecting("SELECT p_partkey, raw_sizes FROM expected"))
def in_stock_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_fields(spark, sf_dir, "size_options").selectExpr(
        "p_partkey", "array_join(size_options, ',') AS raw_sizes"
    )


@query(expecting("SELECT p_partkey, audience, size_type FROM expected"))
def size_type_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listloom.functions.sizes import AUTO, resolve_size_type

    return raw_fields(spark, sf_dir, "size_type").selectExpr(
        "p_partkey", "size_type AS audience", f"{resolve_size_type(str(AUTO), 'size_type')} AS size_type"
    )


@query(expecting("SELECT p_partkey, sizes, CAST(n_sizes AS BIGINT) AS n_sizes FROM expected"))
def converted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listloom.plans.products import converted_sizes as convert

    return raw_fields(spark, sf_dir, "size_options", "size_type").selectExpr(
        "p_partkey", f"{convert('size_options', '5', 'size_type')} AS found"
    ).selectExpr("p_partkey", "array_join(found, ',') AS sizes", "cast(size(found) AS bigint) AS n_sizes")


@query(
    f"""
    WITH {STOCK}, sku AS (
        SELECT p_partkey, q, iq, ok, (p_partkey // 8) AS c, min(q) OVER (PARTITION BY p_partkey) AS low
        FROM part JOIN sz ON l_partkey = p_partkey
    ), labelled AS (
        SELECT p_partkey, q, CASE WHEN c % 4 = 3 THEN '0' || iq || '(W' || iq || ')' ELSE iq * 5 || 'MM' END AS label,
            CASE WHEN c % 3 = 0 AND q = low THEN 3 WHEN ok THEN iq ELSE 0 END AS quantity
        FROM sku
    )
    SELECT p_partkey, coalesce(string_agg(label || '=' || quantity, ',' ORDER BY q), '') AS quantities,
        coalesce(string_agg(replace(label, 'MM', ''), ',' ORDER BY q) FILTER (WHERE quantity <> 0), '') AS in_stock
    FROM part LEFT JOIN labelled USING (p_partkey) GROUP BY p_partkey
    """
)
def sku_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = catalogue(spark, sf_dir).selectExpr(
        "p_partkey", f"from_json({sku_json()}, '{SKU_JSON}') AS skus", f"from_json({option_json()}, '{OPTION_JSON}') AS options"
    )
    stock = parsed.selectExpr("p_partkey", f"{sku_quantities('skus', 'options')} AS stock")
    shown = each("stock", lambda s: f"concat({s}.label, '=', {s}.quantity)")
    return stock.selectExpr(
        "p_partkey", f"coalesce(array_join({shown}, ','), '') AS quantities",
        f"coalesce(array_join({in_stock_labels('stock')}, ','), '') AS in_stock",
    )


@query(expecting("SELECT p_partkey, price FROM expected"))
def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_fields(spark, sf_dir, "price").selectExpr("p_partkey", "replace(price, '$', '') AS price")


@query(
    expecting(
        "SELECT p_partkey, brand, replace(brand, ' ', '') AS brand_ko, name_ko, "
        "replace(brand, ' ', '') || ' ' || name_ko || ' ' || p_name AS full_title FROM expected"
    )
)
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_fields(
        spark, sf_dir, "product_name", "product_name_ko", "brand_name", "price", "size_options", "size_type", "images"
    )
    return finish_products(raw.withColumn("size_type_asked", F.lit(4))).selectExpr(
        "p_partkey", "brand_name AS brand", "brand_name_ko AS brand_ko", "product_name_ko AS name_ko", "full_title"
    )


@query(
    expecting(
        "SELECT p_partkey, array_to_string(titles, '|') AS titles, array_to_string(bullets, '|') AS bullets, "
        "array_to_string(details, '|') AS details FROM expected"
    )
)
def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_fields(spark, sf_dir, "descriptions", "description_images").selectExpr(
        "p_partkey", "array_join(descriptions.titles, '|') AS titles",
        "array_join(descriptions.bullets, '|') AS bullets", "array_join(description_images, '|') AS details",
    )


@query(
    expecting(
        "SELECT p_partkey, array_to_string(images, '|') AS images, images[1] AS title_image, "
        "CASE k WHEN 0 THEN p || '-1._AC_SR800,1500_' ELSE p || '-1' END AS stem, '.jpg' AS extension FROM expected"
    )
)
def image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = "coalesce(get(images, 0), '')"
    return raw_fields(spark, sf_dir, "images").selectExpr(
        "p_partkey", "array_join(images, '|') AS images", f"{first} AS title_image",
        f"{file_stem(first)} AS stem", f"{file_extension(first)} AS extension",
    )


@query(expecting("SELECT p_partkey, color_name, array_to_string(color_urls, '|') AS color_urls FROM expected"))
def color_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_fields(spark, sf_dir, "color_name", "color_urls").selectExpr(
        "p_partkey", "color_name", "array_join(color_urls, '|') AS color_urls"
    )


@query(
    expecting(
        "SELECT p_partkey, concat_ws(',', CASE WHEN k = 7 AND c % 6 = 5 THEN 'brand_name' END, "
        "CASE WHEN NOT described AND k <> 1 THEN 'descriptions' END, "
        "CASE WHEN p_partkey % 10 = 9 AND k IN (4, 7) THEN 'color_urls' END) AS missing FROM expected"
    )
)
def product_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_fields(documents(spark, sf_dir)).selectExpr("p_partkey", "array_join(errors, ',') AS missing")


#: One selector per form of the grammar, with the SQL count of its matches.
SELECTOR_COUNTS = [
    ("title", "sum(CASE WHEN k <> 2 THEN 1 ELSE 0 END)"),
    ("#stage img", "sum(CASE WHEN k = 0 THEN n_img + 1 ELSE 0 END)"),
    ("img[srcset]", "sum(CASE WHEN k = 0 THEN n_img ELSE 0 END)"),
    (".btn-prod-size", "sum(CASE WHEN k = 7 THEN n_all ELSE 0 END)"),
    ("button.btn-prod-size.sold-out", "sum(CASE WHEN k = 7 THEN n_all - n_ok ELSE 0 END)"),
    ("button.btn-prod-size:not(.sold-out)", "sum(CASE WHEN k = 7 THEN n_ok ELSE 0 END)"),
    ('button:not([class*="unavailable"])[class*="size___"]', "sum(CASE WHEN k = 3 THEN n_ok ELSE 0 END)"),
    ('li.variants__item--color:not([aria-checked="true"])', "sum(CASE WHEN k = 4 THEN len(links) ELSE 0 END)"),
    ("li.variants__item--color > a", "sum(CASE WHEN k = 4 THEN len(links) + 1 ELSE 0 END)"),
    ("div#product-detail-description-wrapper > div > *", "sum(CASE WHEN k = 7 THEN 1 + CASE WHEN described THEN 3 ELSE 0 END ELSE 0 END)"),
    ("div.product-tags:first-of-type img", "sum(CASE WHEN k IN (5, 6) THEN 1 ELSE 0 END)"),
    ("div.product-tags:last-of-type img", "sum(CASE WHEN k IN (5, 6) THEN 1 ELSE 0 END)"),
    ('script:-soup-contains("utag_data")', "sum(CASE WHEN k = 4 THEN 1 ELSE 0 END)"),
    ("h1, div.prod-name-en, h1.product-name", "sum(CASE WHEN k IN (1, 3, 5, 6, 7) THEN 1 ELSE 0 END)"),
    ('a[href^="/p/"]', "sum(CASE WHEN k IN (5, 6) THEN len(links) ELSE 0 END)"),
    ('img[src$=".png"]', "sum(CASE WHEN k = 0 THEN 1 WHEN k IN (5, 6) THEN 3 WHEN k = 7 THEN 1 ELSE 0 END)"),
]


@query(
    f"""
    WITH {STOCK}, n AS (
        SELECT p_partkey, count(q) AS n_all, count(q) FILTER (WHERE ok) AS n_ok FROM part LEFT JOIN sz ON l_partkey = p_partkey GROUP BY 1
    ), item AS (
        SELECT p_partkey % 8 AS k, p_partkey // 8 AS c, (p_partkey // 8) % 5 <> 4 AS described, p_size % 5 + 1 AS n_img,
            n_all, n_ok, range(0, least(3, 9 - p_partkey % 10)) AS links
        FROM part JOIN n USING (p_partkey)
    )
    {" UNION ALL ".join(f"SELECT '{s}' AS selector, CAST({c} AS BIGINT) AS matches FROM item" for s, c in SELECTOR_COUNTS)}
    """
)
def css_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = Page()
    counts = [f"named_struct('selector', '{s}', 'found', {page.all(s).count()})" for s, _ in SELECTOR_COUNTS]
    html = documents(spark, sf_dir).selectExpr("if(kind = 'json', NULL, body) AS html")
    parsed = parse_pages(html, wanted=page.wanted())
    return (
        parsed.selectExpr(f"inline(array({', '.join(counts)}))")
        .groupBy("selector")
        .agg(F.sum("found").cast("bigint").alias("matches"))
    )
