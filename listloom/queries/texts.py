"""String, URL, JSON and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listloom.functions import sizes as S
from listloom.functions import text as X
from listloom.functions import urls as U
from listloom.functions.sql import each, let
from listloom.operators.glossary import glossary_translate
from listloom.queries.base_sql import values
from listloom.queries.registry import query, table
from listloom.sources.pages import spread


@query(
    """
    SELECT event_id, id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_name, event_type AS kind, 'f' || event_id AS first_key,
        value_text
    FROM (SELECT *, event_id AS id, 'u' || user_id AS user_name, CAST(CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS VARCHAR) AS value_text FROM events) t
    """
)
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = "cast(cast(value AS decimal(12,2)) AS string)"
    script = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "concat('\\n\\tvar data = {\"id\":', event_id, ',\"props\":[', props, '],\"user\":{\"name\":\"u', user_id, "
        f"'\"}},\"type\":\"', event_type, '\",\"map\":{{\"f', event_id, '\":1,\"z\":2}},\"price\":', {price}, '}};\\n\\t') AS script",
    )
    json = X.strip_chars(X.piece("script", " = ", 1), ";\n\t")
    schema = (
        "id bigint, props array<struct<k: bigint>>, user struct<name: string>, type string, "
        "map map<string, int>, price string"
    )
    return script.selectExpr("event_id", f"from_json({json}, '{schema}') AS d").selectExpr(
        "event_id", "d.id AS id", "get(d.props, 0).k AS k", "d.user.name AS user_name", "d.type AS kind",
        "get(map_keys(d.map), 0) AS first_key", "d.price AS value_text",
    )


@query(
    """
    WITH u AS (
        SELECT p_partkey, 'https://shop.test/a/' || replace(p_name, ' ', '-') || '/P' || p_partkey || '.html'
            || CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '?color=C' || p_size END AS url,
            'P' || p_partkey AS pid, 'C' || p_size AS cid, p_partkey % 6 = 0 AS bad, p_name
        FROM part
    ), j AS (
        SELECT *, 'https://www.lacoste.com/on/demandware.store/Sites-FlagShip-Site/en_US/Product-PartialsData?pid='
            || pid || '&color=' || cid || '&full=true' AS json_url FROM u
    )
    SELECT p_partkey, substr(url, length('https://shop.test/') + 1) AS path,
        CASE WHEN bad THEN url ELSE json_url END AS json_url,
        CASE WHEN bad THEN url || '|https://x.test/q.html?color=R' ELSE json_url
            || '|https://www.lacoste.com/on/demandware.store/Sites-FlagShip-Site/en_US/Product-PartialsData?pid=q&color=R&full=true' END AS json_urls,
        'https://www.vans.com/en-us/' || lower(pid) AS color_url,
        'https://www.vans.com/en-us/' || replace(lower(p_name), ' ', '-') || '-p' || lower(pid) AS named_color_url,
        pid || '.html' AS last_part, p_partkey % 2 = 0 AS is_url
    FROM j
    """
)
def url_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_name", "concat('P', p_partkey) AS pid",
        "concat('https://shop.test/a/', replace(p_name, ' ', '-'), '/P', p_partkey, '.html', "
        "if(p_partkey % 6 = 0, '', concat('?color=C', p_size))) AS url",
    )
    pair = "array(url, 'https://x.test/q.html?color=R')"
    return rows.selectExpr(
        "p_partkey",
        f"{U.path_after_host('url')} AS path",
        f"{U.to_json_url('url')} AS json_url",
        f"array_join({U.to_json_urls(pair)}, '|') AS json_urls",
        f"{U.color_url('pid')} AS color_url",
        f"{U.named_color_url('p_name', 'pid')} AS named_color_url",
        f"{U.before(U.last_segment('url'), '?')} AS last_part",
        f"{U.is_url("if(p_partkey % 2 = 0, url, pid)")} AS is_url",
    )


@query(
    """
    SELECT p_partkey, p_name AS stripped, replace(p_name, 'bolt', '') AS removed, p_name AS unchanged,
        split_part(p_name, ' ', 2) AS second, split_part(p_name, ' ', 1) AS first_from_end,
        upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || '-'
            || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)
            || '''S' || p_size || 'X' AS titled,
        CAST(p_size AS VARCHAR) AS pair_size, '여성' || p_size AS bracket_size, CAST(p_size * 5 AS VARCHAR) AS mm_size,
        CASE WHEN p_partkey % 2 = 0 THEN p_size / 2 END AS number, p_partkey % 3 <> 2 AS parses
    FROM part
    """
)
def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    padded = "concat('\\u00a0\\t ', p_name, '\\u3000\\n')"
    titled = "concat(upper(replace(p_name, ' ', '-')), '\\'s', p_size, 'x')"
    odd = "CASE p_partkey % 3 WHEN 0 THEN concat(' ', p_size, '.5 ') WHEN 1 THEN 'NaN' ELSE concat(p_size, 'D') END"
    return rows.selectExpr(
        "p_partkey",
        f"{X.strip(padded)} AS stripped",
        f"{X.remove('p_name', "'bolt'")} AS removed",
        f"{X.remove('p_name', "''")} AS unchanged",
        f"{X.piece('p_name', ' ', 1)} AS second",
        f"{X.piece('p_name', ' ', -2)} AS first_from_end",
        f"{X.title_case(titled)} AS titled",
        f"{let("concat('M ', p_size, ' / W ', p_size + 1)", S.first_of_pair)} AS pair_size",
        f"{S.bracketed_size("concat('085(W', p_size, ')')")} AS bracket_size",
        f"{S.without_mm("concat(p_size * 5, 'MM')")} AS mm_size",
        f"{X.to_number("if(p_partkey % 2 = 0, cast(p_size / 2 AS string), concat(p_size, 'f'))")} AS number",
        f"{X.parses_as_number(odd)} AS parses",
    )


@query(
    """
    SELECT doc_id, i AS chunk, substr(text, CAST(i * 5000 + 1 AS BIGINT), 5000) AS text
    FROM (SELECT doc_id, text, unnest(range(0, greatest((length(text) + 4999) // 5000, 1))) AS i FROM documents) t
    """
)
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.expr(X.chunks("text"))).alias("chunk", "text")
    ).withColumn("chunk", F.col("chunk").cast("bigint"))


@query("SELECT doc_id, replace(text, 'e', '[E]') AS text FROM documents")
def text_chunks_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{X.map_chunks('text', lambda t: f"replace({t}, 'e', '[E]')")} AS text"
    )


# A small glossary; the last entry is a whole product type.
GLOSSARY = [
    ("the", "그"), ("of", "의"), ("and", "및"), ("to", "에게"), ("in", "안에"), ("is", "이다"), ("for", "위해"),
    ("on", "위에"), ("with", "함께"), ("that", "그것"), ("de", "드"), ("la", "라"), ("le", "르"), ("et", "와"),
    ("der", "데어"), ("die", "디"), ("und", "운트"), ("el", "엘"), ("que", "케"), ("los", "로스"),
]


def _glossary_sql(table_name: str, key: str, column: str) -> str:
    return f"""
    WITH g(term, translation) AS ({values(GLOSSARY)}), words AS (
        SELECT {key}, unnest(string_split({column}, ' ')) AS w, unnest(range(1, len(string_split({column}, ' ')) + 1)) AS i
        FROM {table_name})
    SELECT {key}, string_agg(coalesce(translation, w), ' ' ORDER BY i) AS {column}
    FROM words LEFT JOIN g ON term = w GROUP BY {key}
    """


@query(_glossary_sql("documents", "doc_id", "text"))
def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame(GLOSSARY, "term string, translation string")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return glossary_translate(documents, terms, "text", "doc_id")


@query(_glossary_sql("documents", "doc_id", "text"))
def glossary_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the dictionary that larger glossaries take, with heavy words looked up apart."""
    terms = spark.createDataFrame(GLOSSARY, "term string, translation string")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return glossary_translate(spread(documents), terms, "text", "doc_id", max_broadcast=0, heavy=8)


@query(_glossary_sql("documents", "doc_id", "text"))
def glossary_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listloom.operators.glossary import constant_glossary

    translate = constant_glossary(GLOSSARY)
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{each('array(text)', translate)}[0] AS text")
