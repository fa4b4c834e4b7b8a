"""Queries on raw article pages: parsing, selection, snapshots, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listloom.functions.sql import head, tail
from listloom.operators.dom import Page, one
from listloom.operators.rules import Rule
from listloom.operators.variants import with_batch
from listloom.plans.products import extract_fields
from listloom.queries.registry import query, table
from listloom.session import work_dir
from listloom.sources.pages import Wanted, choose_document, explode_nodes, parse_pages, spread
from listloom.sources.snapshots import cache_misses as misses
from listloom.sources.snapshots import snapshot_lookup as lookup
from listloom.sources.snapshots import with_snapshot_key
from listloom.sources.snapshots import write_snapshots as save

#: Entities of the page table, the ampersand last.  Like a browser, a reader of
#: HTML also takes them without the semicolon, as at the end of a cut heading.
UNESCAPE = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    "{0}, '&quot;?', '\"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g')"
)
BLANKS = "chr(9) || chr(10) || chr(13) || ' '"


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html"))


@query(
    """
    SELECT page_id AS pos, url, (page_id - 11) // 40 AS batch, 11 + (page_id - 11) // 40 * 40 AS start_row
    FROM (
        SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 1 THEN 'file:' || page_id ELSE url END AS url
        FROM pages) t
    WHERE page_id >= 11 AND url <> '' AND contains(url, 'http')
    """
)
def url_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "pages").selectExpr(
        "page_id AS pos",
        "CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 1 THEN concat('file:', page_id) ELSE url END AS url",
    )
    return with_batch(cells, 11, 40)


@query(
    """
    SELECT page_id, kind, CASE kind
        WHEN 'json' THEN '{"id":' || page_id || '}' WHEN 'rendered' THEN '<r>' || url ELSE html END AS body
    FROM (SELECT *, CASE page_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'rendered' WHEN 2 THEN 'json' WHEN 4 THEN 'json' ELSE 'raw' END AS kind
          FROM pages) t
    """
)
def choose_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lacoste = "page_id % 5 = 4"
    pages = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "html", f"if({lacoste}, concat('https://www.lacoste.com/us/men/P', page_id, '-1.html?color=C'), url) AS url",
        f"if({lacoste}, concat('https://www.lacoste.com/on/demandware.store/Sites-FlagShip-Site/en_US/Product-PartialsData?pid=P', "
        "page_id, '-1&color=C&full=true'), url) AS json_url",
    )
    urls = pages.selectExpr("page_id", "url", f"if({lacoste}, 'Lacoste', concat('site', page_id % 5)) AS site")
    # Abilities of four of the five sites; one has no row.  Every raw page is stored three times.
    abilities = spark.createDataFrame(
        [("site0", True, False), ("site1", False, True), ("site2", True, True), ("Lacoste", True, False)],
        "site string, json boolean, rendered boolean",
    )
    return choose_document(
        urls, abilities,
        pages.selectExpr("json_url AS url", "concat('{\"id\":', page_id, '}') AS body"),
        pages.selectExpr("url", "concat('<r>', url) AS body"),
        pages.selectExpr("url", "explode(array(substr(html, 1, 50), html, html)) AS body"),
    ).select("page_id", "kind", "body")


@query(
    """
    SELECT tag, count(*) AS n FROM (
        SELECT unnest(regexp_extract_all(
            regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', '<\\1>', 'g'), '(?s)<!--.*?-->', '', 'g'),
            '<([a-z][a-z0-9]*)', 1)) AS tag
        FROM pages) t
    GROUP BY tag
    """
)
def dom_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags_only = Wanted(texts=frozenset(), attrs=frozenset())
    nodes = explode_nodes(parse_pages(raw_pages(spark, sf_dir), wanted=tags_only), "page_id")
    return nodes.groupBy("tag").agg(F.count("*").alias("n"))


@query(
    f"""
    SELECT page_id, {UNESCAPE.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title,
        {UNESCAPE.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS h1,
        regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
        regexp_extract(html, '(?s)<script>(.*?)</script>', 1) AS script
    FROM pages
    """
)
def page_title_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = Page()
    fields = [
        f"{one(page.first('head > title').text())} AS title",
        f"{one(page.first('article h1').text())} AS h1",
        f"{one(page.first('html[lang]').need('lang'))} AS lang",
        f"{one(page.first('script:-soup-contains(\"track\")').string())} AS script",
    ]
    return parse_pages(raw_pages(spark, sf_dir), wanted=page.wanted()).selectExpr("page_id", *fields)


@query(
    f"""
    SELECT page_id,
        {UNESCAPE.format('array_to_string(regexp_extract_all(nav, \'<a href="([^"]*)"\', 1), \'|\')')} AS links,
        {UNESCAPE.format("array_to_string(regexp_extract_all(nav, '<a [^>]*>([^<]*)</a>', 1), '|')")} AS labels,
        len(regexp_extract_all(nav, '<a ')) AS n
    FROM (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages) t
    """
)
def nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = Page()
    links = page.all("nav a")
    fields = [
        f"array_join({links.need('href')}, '|') AS links",
        f"array_join({links.text()}, '|') AS labels",
        f"cast({links.count()} AS bigint) AS n",
    ]
    return parse_pages(raw_pages(spark, sf_dir), wanted=page.wanted()).selectExpr("page_id", *fields)


@query(
    f"""
    SELECT page_id, len(items) AS items, {UNESCAPE.format("items[1]")} AS first_item,
        {UNESCAPE.format("items[-1]")} AS last_item,
        CAST(len(items) AS BIGINT) AS children, 1::BIGINT AS lists
    FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a [^>]*>([^<]*)</a></li>', 1) AS items
          FROM pages) t
    """
)
def direct_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = Page()
    scope = page.first("nav")
    items = scope.inside("ul > li").text()
    fields = [
        f"cast(size({items}) AS bigint) AS items",
        f"{one(head(items))} AS first_item",
        f"try_element_at({items}, -1) AS last_item",
        f"cast({page.first('nav > ul').children('li').count()} AS bigint) AS children",
        f"cast({scope.children().count()} AS bigint) AS lists",
    ]
    return parse_pages(raw_pages(spark, sf_dir), wanted=page.wanted()).selectExpr("page_id", *fields)


@query(
    f"""
    SELECT page_id, CAST(len(lines) AS BIGINT) AS n, coalesce(lines[1], '') AS title,
        array_to_string(lines[2:], '|') AS bullets, array_to_string(lines, '') AS compact
    FROM (
        SELECT page_id, list_filter(list_transform(
            string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]+>'),
            lambda t: trim({UNESCAPE.format("t")}, {BLANKS})), lambda t: t <> '') AS lines
        FROM pages) x
    """
)
def paragraph_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = Page()
    lines = one(page.first("article").lines())
    parsed = parse_pages(raw_pages(spark, sf_dir), wanted=page.wanted()).selectExpr("page_id", f"{lines} AS lines")
    return parsed.selectExpr(
        "page_id", "cast(size(lines) AS bigint) AS n", f"coalesce({one(head('lines'))}, '') AS title",
        f"array_join({tail('lines')}, '|') AS bullets", "array_join(lines, '') AS compact",
    )


@query(
    """
    SELECT page_id, 'res_AbcGrandStage_' || substr(h, 1, 6) || '.html' AS key,
        'res_AbcGrandStage_' || substr(h, 1, 16) || '.pickle' AS long_key
    FROM (SELECT page_id, sha256('AbcGrandStage_' || array_to_string(string_split(url, '/')[4:], '/')) AS h FROM pages) t
    """
)
def snapshot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").selectExpr("page_id", "url", "'Abc Grand Stage' AS site")
    long_keys = with_snapshot_key(pages, "pickle", 16).withColumnRenamed("key", "long_key")
    return with_snapshot_key(long_keys, n_hex=6).select("page_id", "key", "long_key")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All pages as wanted; saved are two of three, some of them cut short, in a written store."""
    pages = with_snapshot_key(table(spark, sf_dir, "pages").selectExpr(
        "page_id", "url AS page_url", "concat(url, '?page=', page_id) AS url", "html", "concat('Site ', page_id % 3) AS site"
    ))
    path = work_dir(spark, "snapshots")
    save(pages.where("page_id % 3 <> 0").withColumn("html", F.expr("if(page_id % 7 = 0, substr(html, 1, 50), html)")), path)
    return pages.selectExpr("page_id", "page_url AS url", "key"), spark.read.parquet(path)


@query("SELECT page_id, url FROM pages WHERE page_id % 3 = 0 OR page_id % 7 = 0")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return misses(*_snapshots(spark, sf_dir)).select("page_id", "url")


@query("SELECT page_id, length(html) AS chars FROM pages WHERE page_id % 3 <> 0 AND page_id % 7 <> 0")
def snapshot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(*_snapshots(spark, sf_dir)).selectExpr("page_id", "cast(length(html) AS bigint) AS chars")


@query(
    """
    SELECT site, count(*) AS pages, CAST(sum(chars) AS BIGINT) AS chars
    FROM (SELECT 'Site ' || page_id % 3 AS site, array_to_string(string_split(url, '/')[4:], '/') AS path,
              arg_min(length(html), url) AS chars FROM pages GROUP BY 1, 2) t
    GROUP BY site
    """
)
def write_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_snapshot_key(
        table(spark, sf_dir, "pages").selectExpr("url", "html", "concat('Site ', page_id % 3) AS site")
    )
    path = work_dir(spark, "snapshots")
    # Every page twice, then all of them again: each key, site and path, is saved once.
    save(pages.unionAll(pages), path)
    save(pages, path, spark.read.parquet(path))
    saved = spark.read.parquet(path)
    return saved.groupBy("site").agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"))


@query(
    f"""
    SELECT page_id, {UNESCAPE.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS product_name,
        CASE WHEN page_id % 2 = 0 THEN upper(regexp_extract(html, '<html lang="([^"]*)"', 1)) || '-page' ELSE '' END AS shelf,
        CASE WHEN page_id % 2 = 0 THEN array_to_string(list_transform(
            regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), 'href="([^"]*)"', 1),
            lambda u: 'https://x.test' || {UNESCAPE.format("u")}), '|') ELSE '' END AS color_urls
    FROM pages
    """
)
def rules_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        # The first source never matches, so the second one counts.
        Rule("even", "product_name", "h1.product-title", priority=1),
        Rule("even", "product_name", "h1", priority=2),
        Rule("odd", "product_name", "article h1"),
        Rule("even", "shelf", "html", read="need", arg="lang"),
        Rule("even", "color_urls", "a", "all", "need", "href", post=("prefix:https://x.test",), within="nav"),
    ]
    pages = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "if(page_id % 2 = 0, 'even', 'odd') AS site", "'raw' AS kind", "html AS body"
    )
    found = extract_fields(spread(pages), ["product_name", "shelf", "color_urls"], rules)
    return found.selectExpr(
        "page_id", "product_name", "if(shelf = '', '', concat(upper(shelf), '-page')) AS shelf",
        "array_join(color_urls, '|') AS color_urls",
    )
