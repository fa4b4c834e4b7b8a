"""Work lists, row positions, inserted rows, file names, colour families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listloom.operators import variants as V
from listloom.operators.closure import variants_closure as closure
from listloom.operators.filenames import unique_file_names as name_files
from listloom.queries.registry import query, table
from listloom.sources.sheets import insert_rows as insert

TARGET, START = 101, 11

#: Colour links of a part: the next up to three parts of its block of ten.
LINKS = "transform(filter(array(1, 2, 3), i -> i <= 9 - p_partkey % 10), i -> p_partkey + i)"
LINKS_SQL = "list_transform(range(1, least(3, 9 - p_partkey % 10) + 1), lambda i: p_partkey + i)"


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS pos", "concat('https://shop.test/', p_partkey) AS url",
        f"transform({LINKS}, l -> concat('https://shop.test/', l)) AS color_urls",
    )


@query(
    f"""
    WITH own AS (
        SELECT p_partkey AS pos, {LINKS_SQL} AS links, len({LINKS_SQL}) AS v,
            row_number() OVER (ORDER BY p_partkey) - 1 AS r,
            coalesce(sum(len({LINKS_SQL})) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
            count(*) OVER () AS n
        FROM part
    ), rows_ AS (
        SELECT pos, r, a, n, v, 0 AS sub_pos, pos AS key FROM own
        UNION ALL SELECT pos, r, a, n, v, unnest(range(1, v + 1)), unnest(links) FROM own
    )
    SELECT pos, CAST(sub_pos AS BIGINT) AS sub_pos, 'https://shop.test/' || key AS url, sub_pos > 0 AS is_variant,
        CAST(r + a + sub_pos + {TARGET} AS BIGINT) AS row_no,
        CAST(r + a + sub_pos + 1 AS BIGINT) || '/' || CAST(n + a + CASE WHEN sub_pos > 0 THEN v ELSE 0 END AS BIGINT) || ' (S'
            || CAST({START} + r + a + sub_pos - a - CASE WHEN sub_pos > 0 THEN v ELSE 0 END AS BIGINT) || ')' AS progress
    FROM rows_
    """
)
def expand_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = V.listing_positions(products(spark, sf_dir), TARGET, START)
    return placed.withColumn("sub_pos", F.col("sub_pos").cast("bigint"))


@query(
    f"""
    SELECT count(*) AS pages, CAST(sum(len({LINKS_SQL})) AS BIGINT) AS color_rows,
        CAST(count(*) + sum(len({LINKS_SQL})) AS BIGINT) AS rows FROM part
    """
)
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.batch_counts(products(spark, sf_dir))


@query(
    """
    SELECT CASE WHEN s_suppkey + 1 >= 20 THEN s_suppkey + 1 + (SELECT count(*) FROM nation) ELSE s_suppkey + 1 END AS row_no,
        s_name AS cell FROM supplier
    UNION ALL SELECT 20 + n_nationkey, n_name FROM nation
    """
)
def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = table(spark, sf_dir, "supplier").selectExpr("s_suppkey + 1 AS row_no", "s_name AS cell")
    block = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey + 1 AS bigint) AS rank", "n_name AS cell")
    return insert(sheet, block, 20)


@query(
    """
    WITH kinds AS (SELECT DISTINCT p_type FROM part), new AS (
        SELECT p_partkey AS pos, p_type AS dir, replace(p_name, ' ', '_') AS stem,
            row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_partkey) AS r FROM part
    ), existing AS (
        SELECT DISTINCT p_type AS dir, 'red_bolt' AS stem, n_nationkey % 7 * 2 + 2 AS k FROM nation, kinds
    ), free AS (
        SELECT dir, stem, k, row_number() OVER (PARTITION BY dir, stem ORDER BY k) AS r
        FROM (SELECT DISTINCT dir, stem, unnest(range(1, (SELECT max(r) FROM new) + 40)) AS k FROM new) c
        WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.dir = c.dir AND e.stem = c.stem AND e.k = c.k)
    )
    SELECT pos, n.dir AS dir, n.stem || ' (' || k || ').jpg' AS file_name FROM new n JOIN free f
        ON n.dir = f.dir AND n.stem = f.stem AND n.r = f.r
    """
)
def unique_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    images = part.selectExpr(
        "p_type AS dir", "p_partkey AS pos",
        "concat('https://img.test/x/', replace(p_name, ' ', '_'), '.jpg?wid=', p_size) AS url",
    )
    numbers = table(spark, sf_dir, "nation").selectExpr("concat('red_bolt (', n_nationkey % 7 * 2 + 2, ').jpg') AS name")
    names = numbers.agg(F.collect_set("name").alias("names"))
    folders = part.selectExpr("p_type AS dir").distinct()
    existing = folders.select("dir", F.explode(names.scalar()).alias("file_name"))
    return name_files(images, existing).select("pos", "dir", "file_name")


@query("SELECT p_partkey AS code, CAST(ceil((p_partkey % 10) / 3) AS INTEGER) AS hops FROM part")
def variants_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    seeds = part.where("p_partkey % 10 = 0").selectExpr("p_partkey AS code")
    links = part.selectExpr("p_partkey AS code", f"explode({LINKS}) AS linked")
    return closure(seeds, links)


@query(
    """
    SELECT p_partkey AS code, p_name FROM part
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45 AND l_linestatus = 'F')
    """
)
def already_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").selectExpr("p_partkey AS code", "p_name")
    listed = table(spark, sf_dir, "lineitem").where("l_quantity > 45 AND l_linestatus = 'F'")
    return V.not_listed(found, listed.selectExpr("l_partkey AS code"))
