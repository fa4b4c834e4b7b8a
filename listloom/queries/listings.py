"""The whole flow and its last steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listloom.functions.listing_html import listing_html
from listloom.functions.sql import texts
from listloom.functions.urls import to_json_url
from listloom.operators.listing import with_static_images
from listloom.operators.ranking import with_rank
from listloom.operators.rules import Rule, rules_from_table
from listloom.plans.batch import Sources, run_batch, run_batches
from listloom.plans.listings import make_listings, make_products
from listloom.plans.sites import LACOSTE
from listloom.queries.base_sql import body_sql, expecting
from listloom.queries.pages import UNESCAPE
from listloom.queries.registry import query, table
from listloom.sources.pages import spread
from listloom.queries.shops import documents
from listloom.schemas import LISTING_COLUMNS
from listloom.session import work_dir
from listloom.sources.sheets import Sheet, write_sheet
from listloom.sources.dims import DEFAULT_END, DEFAULT_MIDDLE, DEFAULT_TOP, site_images

#: Ten brands with images, two of them with empty lists.
BRAND_IMAGES = [
    (f"Brand#{n}", [] if n in (3, 4) else [f"https://i.test/{n}/top.jpg"], [], [] if n in (3, 4) else [f"/{n}/a", f"/{n}/b"])
    for n in range(1, 11)
]
DEFAULTS = (f"['{DEFAULT_TOP[0]}']", f"['{DEFAULT_MIDDLE[0]}']", f"['{DEFAULT_END[0]}']")


def brand_images(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BRAND_IMAGES, "brand string, top array<string>, middle array<string>, `end` array<string>")


IMAGES_SQL = "VALUES " + ", ".join(f"('{b}', {t}::VARCHAR[], {m}::VARCHAR[], {e}::VARCHAR[])" for b, t, m, e in BRAND_IMAGES)


@query(
    f"""
    WITH dim(brand, t, m, e) AS ({IMAGES_SQL})
    SELECT p_partkey, array_to_string(CASE WHEN brand IS NULL THEN {DEFAULTS[0]} ELSE t END, '|') AS top,
        array_to_string(CASE WHEN brand IS NULL THEN {DEFAULTS[1]} ELSE m END, '|') AS middle,
        array_to_string(CASE WHEN brand IS NULL THEN {DEFAULTS[2]} ELSE e END, '|') AS bottom
    FROM part LEFT JOIN dim ON brand = p_brand
    """
)
def static_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return with_static_images(part, brand_images(spark), "p_brand").selectExpr(
        "p_partkey", "array_join(top, '|') AS top", "array_join(middle, '|') AS middle", "array_join(`end`, '|') AS bottom"
    )


@query(
    f"""
    SELECT p_partkey, {body_sql("p_brand", "['/t1', '/t2']", "['/m']", "[]")} AS html
    FROM (SELECT *, ['/i' || p_partkey, '/j'] AS images, [p_type] AS titles, [p_name, 'size ' || p_size] AS bullets,
              ['/d'] AS details FROM part) t
    """
)
def listing_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = listing_html(
        "p_brand", "array(concat('/i', p_partkey), '/j')", "array(p_type)", "array(p_name, concat('size ', p_size))",
        texts(["/d"]), texts(["/t1", "/t2"]), texts(["/m"]), texts([]),
    )
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{body} AS html")


BRAND_KO = "replace(brand, ' ', '')"
#: Shops have empty lists; brands named on mall pages take the defaults.
LISTED_HTML = (
    f"CASE WHEN k IN (0, 7) THEN {body_sql(BRAND_KO, *DEFAULTS)} ELSE {body_sql(BRAND_KO, '[]', '[]', '[]')} END"
)


@query(
    expecting(
        f"""
    SELECT p_partkey, '' AS A, '' AS B, {BRAND_KO} || ' ' || name_ko || ' ' || p_name AS C, '' AS D, price AS E,
        '' AS F, '' AS G, '' AS H, '' AS I, sizes AS J, '' AS K,
        array_to_string(list_transform(range(1, n_sizes + 1), lambda i: CASE WHEN i <= 9 THEN i * 11 ELSE i END), ',') AS L,
        '' AS M, '' AS N, '' AS O, '' AS P, '' AS Q, images[1] AS R, url AS S, {LISTED_HTML} AS T,
        {BRAND_KO} AS U, {BRAND_KO} AS V
    FROM expected
    """
    )
)
def listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make_listings(documents(spark, sf_dir), site_images(spark), "p_partkey")


@query(
    expecting(
        f"""
    SELECT p_partkey, '' AS A, '' AS B, {BRAND_KO} || ' ' || name_ko || ' ' || p_name AS C, '' AS D, price AS E,
        '' AS F, '' AS G, '' AS H, '' AS I, '' AS J, '' AS K, '' AS L,
        '' AS M, '' AS N, '' AS O, '' AS P, '' AS Q, images[1] AS R, '' AS S, {LISTED_HTML} AS T
    FROM expected
    """
    )
)
def kids_listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make_listings(documents(spark, sf_dir), site_images(spark), "p_partkey", layout="kids")


ARTICLE_RULES = [
    Rule("article", "product_name", "article > h1"),
    Rule("article", "price", "html", read="need", arg="lang"),
    Rule("article", "images", "a", "all", "need", "href", within="nav"),
]


def article_listings(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Listing rows of the article pages by three user rules; used for tables and streams."""
    docs = pages.selectExpr("page_id", "'article' AS site", "'raw' AS kind", "url", "html AS body")
    return make_listings(docs, images, "page_id", rules=ARTICLE_RULES, sites=()).select("page_id", "C", "E", "R", "S")


H1 = UNESCAPE.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")
ARTICLE_SQL = f"""
    SELECT page_id, 'article ' || {H1} || ' ' || {H1} AS C, regexp_extract(html, '<html lang="([^"]*)"', 1) AS E,
        {UNESCAPE.format("regexp_extract(html, '<a href=\"([^\"]*)\"', 1)")} AS R, url AS S
    FROM pages
"""


@query(ARTICLE_SQL)
def article_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article_listings(spread(table(spark, sf_dir, "pages")), site_images(spark))



MINI_RULES = [
    Rule("mini", "product_name", "h1", post=("strip",)),
    Rule("mini", "price", "b.price"),
    Rule("mini", "color_urls", "a.color", "all", "need", "href"),
]
LINKS_SQL = "list_transform(range(1, least(3, 9 - p_partkey % 10) + 1), lambda i: p_partkey + i)"


@query(
    f"""
    WITH own AS (
        SELECT p_partkey AS pos, len({LINKS_SQL}) AS v, {LINKS_SQL} AS links,
            sum(1 + len({LINKS_SQL})) OVER (ORDER BY p_partkey) - 1 - len({LINKS_SQL}) AS before
        FROM part WHERE p_partkey % 7 <> 0
    ), placed AS (
        SELECT before + 20 AS row_no, pos AS key FROM own
        UNION ALL SELECT before + 20 + unnest(range(1, v + 1)), unnest(links) FROM own
    ), listed AS (
        SELECT CAST(row_no AS BIGINT) AS row_no, 'mini ' || p_name || ' ' || p_name AS C,
            CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS E, 'https://shop.test/' || key AS S
        FROM placed JOIN part ON p_partkey = key
    )
    SELECT * FROM listed
    UNION ALL SELECT s_suppkey + 1 + CASE WHEN s_suppkey + 1 >= 20 THEN (SELECT count(*) FROM listed) ELSE 0 END, s_name, '', ''
    FROM supplier
    """
)
def batch_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    links = "transform(filter(array(1, 2, 3), i -> i <= 9 - p_partkey % 10), i -> p_partkey + i)"
    anchors = f"array_join(transform({links}, l -> concat('<a class=\"color\" href=\"https://shop.test/', l, '\">c</a>')), '')"
    pages = part.selectExpr(
        "concat('https://shop.test/', p_partkey) AS url",
        "concat('<h1> ', p_name, ' </h1><b class=\"price\">$', cast(cast(p_retailprice AS decimal(12,2)) AS string), '</b>', "
        f"{anchors}) AS body",
    )
    urls = part.selectExpr(
        "p_partkey AS pos", "'mini' AS site", "if(p_partkey % 7 = 0, '', concat('https://shop.test/', p_partkey)) AS url"
    )
    cells = ["s_name AS C" if c == "C" else f"'' AS {c}" for c in LISTING_COLUMNS]
    sheet = table(spark, sf_dir, "supplier").selectExpr("s_suppkey + 1 AS row_no", *cells)
    abilities = spark.createDataFrame([("mini", False, False)], "site string, json boolean, rendered boolean")
    sources = Sources(abilities, pages.limit(0), pages.limit(0), pages, site_images(spark))
    last = part.agg({"p_partkey": "max"}).first()[0]
    done = run_batch(urls, sheet, sources, 0, last + 1, 20, rules=MINI_RULES, sites=())
    return done.sheet.select("row_no", "C", "E", "S")


SHOWN_RULES = [
    Rule("shown", "product_name", "h1", post=("strip",)),
    Rule("shown", "price", "b.price"),
    Rule("shown", "color_urls", "a.color", "all", "need", "href"),
]
#: Shops of the batch loop: saved as JSON under their endpoint, as rendered pages, as raw pages.
LOOP_SITE = "CASE p_partkey % 3 WHEN 0 THEN 'Lacoste' WHEN 1 THEN 'shown' ELSE 'mini' END"
LOOP_URL = "concat('https://shop.test/', CAST(p_partkey AS VARCHAR(20)), '.html')"


def loop_sql(gap: str) -> str:
    """Two batches: where each row goes, and what the insertions push down; {gap} is what the first leaves blank."""
    return f"""
    WITH own AS (
        SELECT p_partkey AS pos, {LOOP_SITE} AS site, p_partkey % 3 = 0 AS json, p_name,
            CASE WHEN p_partkey % 3 = 0 THEN [] ELSE {LINKS_SQL} END AS links,
            CASE WHEN p_partkey <= (SELECT (max(p_partkey) + 1) // 2 FROM part) THEN 0 ELSE 1 END AS batch
        FROM part WHERE p_partkey % 7 <> 0
    ), ordered AS (
        SELECT *, coalesce(sum(1 + len(links)) OVER (PARTITION BY batch ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS before FROM own
    ), sizes AS (
        SELECT sum(1 + len(links)) FILTER (WHERE batch = 0) AS n0, sum(1 + len(links)) FILTER (WHERE batch = 1) AS n1,
            sum(len(links)) FILTER (WHERE batch = 0) AS colors, (SELECT (max(p_partkey) + 1) // 2 FROM part) AS size FROM own
    ), places_ AS (SELECT 20 AS t0, 20 + {gap} AS t1, n0, n1 FROM sizes),
    spread_ AS (
        SELECT batch, before AS i, pos AS key, site FROM ordered
        UNION ALL SELECT batch, before + unnest(range(1, len(links) + 1)), unnest(links), site FROM ordered
    ), listed AS (
        SELECT CASE batch WHEN 0 THEN t0 ELSE t1 END + i AS row_no, site, key,
            -- A colour link is looked up as its own page is stored, by kind.
            CASE WHEN key % 3 = 0 THEN site = 'Lacoste' WHEN key % 3 = 1 THEN site = 'shown' ELSE site = 'mini' END AS saved
        FROM spread_, places_
    ), cells AS (
        SELECT row_no, CASE WHEN saved THEN site || ' ' || p_name || ' ' || p_name ELSE site || '  ' END AS C,
            CASE WHEN saved THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) ELSE '' END AS E,
            'https://shop.test/' || key || '.html' AS S
        FROM listed JOIN part ON p_partkey = key
    ), pushed AS (
        SELECT CASE WHEN s_suppkey + 1 >= t0 THEN s_suppkey + 1 + n0 ELSE s_suppkey + 1 END AS r, s_name, t1, n1 FROM supplier, places_
    ), every AS (
        SELECT CAST(row_no AS BIGINT) AS row_no, C, E, S FROM cells
        UNION ALL SELECT CAST(CASE WHEN r >= t1 THEN r + n1 ELSE r END AS BIGINT), s_name, '', '' FROM pushed
    )
    SELECT row_number() OVER (ORDER BY row_no) AS nth, row_no, C, E, S FROM every
    """


def _batch_loop(spark: SparkSession, sf_dir: str, gap_mode: str) -> DataFrame:
    """Two batches over three shops into a sheet of blocks, written in order and read back in file order."""
    part = table(spark, sf_dir, "part").withColumn("url", F.expr(LOOP_URL)).withColumn("site", F.expr(LOOP_SITE))
    price = "cast(cast(p_retailprice AS decimal(12,2)) AS string)"
    links = "transform(filter(array(1, 2, 3), i -> i <= 9 - p_partkey % 10), i -> p_partkey + i)"
    anchors = f"array_join(transform({links}, l -> concat('<a class=\"color\" href=\"https://shop.test/', l, '.html\">c</a>')), '')"
    html = f"concat('<h1> ', p_name, ' </h1><b class=\"price\">$', {price}, '</b>', {anchors})"
    product = f"named_struct('name', p_name, 'pricing', named_struct('salesPrice', named_struct('format', concat('$', {price}))))"
    json_pages = part.where("site = 'Lacoste'").selectExpr(
        f"{to_json_url('url')} AS url", f"to_json(named_struct('product', {product})) AS body"
    )
    rendered = part.where("site = 'shown'").selectExpr("url", f"{html} AS body")
    raw = part.where("site = 'mini'").selectExpr("url", f"{html} AS body")
    urls = part.selectExpr("p_partkey AS pos", "site", "if(p_partkey % 7 = 0, '', url) AS url")
    abilities = spark.createDataFrame(
        [("mini", False, False), ("shown", False, True), ("Lacoste", True, False)], "site string, json boolean, rendered boolean"
    )
    cells = ["s_name AS C" if c == "C" else f"'' AS {c}" for c in LISTING_COLUMNS]
    first = table(spark, sf_dir, "supplier").selectExpr("s_suppkey + 1 AS row_no", *cells)
    sheet = Sheet.create(first, work_dir(spark, "sheet"))
    size = (part.agg({"p_partkey": "max"}).first()[0] + 1) // 2
    sources = Sources(abilities, json_pages, rendered, raw, site_images(spark))
    run_batches(
        urls, sheet, sources, 1, size, 20, batches=2, gap_mode=gap_mode, rules=[*MINI_RULES, *SHOWN_RULES], sites=[LACOSTE]
    )
    path = work_dir(spark, "export")
    write_sheet(sheet.rows(), path)
    back = spark.read.parquet(path).selectExpr("row_no", "C", "E", "S", "_metadata.file_path AS file", "_metadata.row_index AS line")
    return with_rank(back, [], ["file", "line"], "nth").select("nth", "row_no", "C", "E", "S")


@query(loop_sql("n0"))
def batch_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch_loop(spark, sf_dir, "dense")


@query(loop_sql("size + colors"))
def batch_loop_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch_loop(spark, sf_dir, "reference")


#: A shop that exists only as rule rows: mall brand, Korean name, converted sizes, images.
ADDED_RULES = [
    ("added", "product_name", "h1", "one", "text", None),
    ("added", "brand_name", "i.brand", "one", "text", None),
    ("added", "product_name_ko", "b.ko", "one", "text", None),
    ("added", "price", "u", "one", "text", None),
    ("added", "size_options", "li", "all", "text", None),
    ("added", "images", "img", "all", "need", "src"),
    ("added", "size_groups", "kids", "one", "text", None),
]


@query(
    """
    SELECT p_partkey, p_brand AS brand, '상품 ' || p_name AS name_ko, '/' || p_partkey || '.jpg' AS image,
        CASE p_partkey % 3 WHEN 0 THEN '215,250,330' WHEN 1 THEN '240,320' ELSE '130' END AS sizes
    FROM part
    """
)
def added_shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Men's, women's and kids' sizes by size type, all from the table of rules."""
    rules = rules_from_table(
        spark.createDataFrame(ADDED_RULES, "site string, field string, selector string, pick string, read string, arg string")
    )
    docs = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "'added' AS site", "'raw' AS kind", "'' AS url", "cast(p_partkey % 3 + 1 AS int) AS size_type_asked",
        "concat('<h1>', p_name, '</h1><i class=\"brand\">', p_brand, '</i><b class=\"ko\">상품 ', p_name, '</b><u>$1</u>', "
        "CASE p_partkey % 3 WHEN 0 THEN '<li>3.5</li><li>7</li><li>15</li><li>99</li>' WHEN 1 THEN '<li>7</li><li>15</li><li>4.5</li>' "
        "ELSE '<li>7</li><li>6.5</li>' END, '<img src=\"/', p_partkey, '.jpg\">') AS body",
    )
    return make_products(docs, rules=rules, sites=()).selectExpr(
        "p_partkey", "brand_name AS brand", "product_name_ko AS name_ko", "title_image AS image",
        "array_join(size_options, ',') AS sizes",
    )
