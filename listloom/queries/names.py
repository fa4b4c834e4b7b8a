"""Shop names and hosts, on names typed in many ways for every part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listloom.functions.sql import case, q
from listloom.operators.names import with_site_host, with_site_name
from listloom.queries.base_sql import ALIASES, HOSTS, values
from listloom.queries.expected import EXPECTED_ALIASES
from listloom.queries.registry import query, table
from listloom.sources.dims import alias_array

N = len(EXPECTED_ALIASES)

#: Ways to type a shop name: Spark expression over ko, official, p_name; SQL the same.
FORMS = [
    ("ko", "ko"),
    ("lower(official)", "lower(official)"),
    ("upper(replace(official, ' ', ''))", "upper(replace(official, ' ', ''))"),
    ("split(official, ' ')[0]", "split_part(official, ' ', 1)"),
    ("concat('the ', lower(official), ' ', p_name)", "'the ' || lower(official) || ' ' || p_name"),
    ("reverse(ko)", "reverse(ko)"),
    ("substr(ko, 1, 2)", "substr(ko, 1, 2)"),
    ("substr(ko, 1, 1)", "substr(ko, 1, 1)"),
    ("p_name", "p_name"),
    ("concat(substr(ko, 1, 1), ' ', substr(ko, 3, 1))", "substr(ko, 1, 1) || ' ' || substr(ko, 3, 1)"),
    ("p_brand", "p_brand"),
]


def _typed(dialect: int) -> str:
    step = f"p_partkey div {N}" if dialect == 0 else f"p_partkey // {N}"
    return case([(f"({step}) % {len(FORMS)} = {i}", form[dialect]) for i, form in enumerate(FORMS)])


NUMBERED = values([(i, ko, official) for i, (ko, official) in enumerate(EXPECTED_ALIASES)])


NAMES_SQL = f"""
    WITH {ALIASES}, numbered(i, ko, official) AS ({NUMBERED}), typed AS (
        SELECT p_partkey, {_typed(1)} AS typed FROM part JOIN numbered ON i = p_partkey % {N}
    ), clean AS (
        SELECT *, replace(lower(typed), ' ', '') AS n, string_split(lower(typed), ' ') AS words FROM typed
    ), matched AS (
        SELECT p_partkey, typed, site_official
        FROM clean LEFT JOIN alias a ON CASE
            WHEN EXISTS (SELECT 1 FROM alias e WHERE e.ko_name = typed) THEN a.ko_name = typed
            WHEN NOT regexp_matches(n, '[a-z]') THEN length(n) >= 2
                AND len(list_filter(string_split(n, ''), lambda ch: NOT contains(a.ko_name, ch))) = 0
            ELSE contains(replace(lower(a.site_official), ' ', ''), n)
                OR list_has_any(words, string_split(lower(a.site_official), ' ')) END
    )
    SELECT p_partkey, typed, CASE WHEN count(site_official) = 1 THEN max(site_official) ELSE '' END AS site_official,
        count(site_official) AS match_count
    FROM matched GROUP BY p_partkey, typed
    """


@query(NAMES_SQL)
def site_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliased = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_name", "p_brand", f"get({alias_array()}, cast(p_partkey % {N} AS int)) AS a"
    )
    typed = aliased.selectExpr("p_partkey", "p_name", "p_brand", "a.ko_name AS ko", "a.site_official AS official")
    named = with_site_name(typed.selectExpr("p_partkey", f"{_typed(0)} AS typed"), "typed")
    return named.selectExpr("p_partkey", "typed", "site_official", "cast(match_count AS bigint) AS match_count")


#: A shop of its own for every part, and names typed by customers of these shops.
SHOPS = ("concat('상품', p_partkey) AS ko_name", "concat(p_name, ' ', p_partkey) AS site_official")
TYPED = (
    "CASE p_partkey % 5 WHEN 0 THEN concat('상품', p_partkey) WHEN 1 THEN upper(replace(concat(p_name, p_partkey), ' ', '')) "
    "WHEN 2 THEN concat('Shop ', p_partkey, ' x') WHEN 3 THEN concat(p_partkey, '품', p_size) ELSE p_type END"
)


@query(
    f"""
    WITH alias AS (SELECT {', '.join(SHOPS)}, p_partkey AS id FROM part), typed AS (SELECT DISTINCT {TYPED} AS typed FROM part),
    clean AS (
        SELECT *, replace(lower(typed), ' ', '') AS n, string_split(lower(typed), ' ') AS words,
            regexp_matches(replace(lower(typed), ' ', ''), '[a-z]') AS latin FROM typed
    ), words AS (SELECT DISTINCT unnest(string_split(lower(site_official), ' ')) AS word, id FROM alias),
    hits AS (
        SELECT typed, site_official, id, true AS exact FROM clean JOIN alias ON ko_name = typed
        UNION SELECT typed, site_official, id, false FROM clean JOIN alias
            ON latin AND contains(replace(lower(site_official), ' ', ''), n)
        UNION SELECT typed, site_official, a.id, false FROM (SELECT typed, unnest(words) AS word FROM clean WHERE latin) c
            JOIN words w ON c.word = w.word JOIN alias a ON a.id = w.id
        UNION SELECT typed, site_official, id, false FROM clean JOIN alias ON NOT latin AND length(n) >= 2
            AND len(list_filter(string_split(n, ''), lambda ch: NOT contains(ko_name, ch))) = 0
    ), best AS (
        SELECT * FROM hits h WHERE exact OR NOT EXISTS (SELECT 1 FROM hits e WHERE e.typed = h.typed AND e.exact)
    ), found AS (SELECT typed, count(DISTINCT id) AS n, max(site_official) AS official FROM best GROUP BY typed)
    SELECT p_partkey, {TYPED} AS typed, CASE WHEN n = 1 THEN official ELSE '' END AS site_official, coalesce(n, 0) AS match_count
    FROM part LEFT JOIN found ON typed = {TYPED}
    """
)
def site_names_by_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against a table of as many aliases as there are parts."""
    part = table(spark, sf_dir, "part")
    typed = part.selectExpr("p_partkey", f"{TYPED} AS typed")
    named = with_site_name(typed, "typed", part.selectExpr(*SHOPS))
    return named.selectExpr("p_partkey", "typed", "site_official", "cast(match_count AS bigint) AS match_count")


@query(
    f"""
    WITH {HOSTS}, numbered(i, ko, official) AS ({NUMBERED}), asked AS (
        SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE official END AS name
        FROM part JOIN numbered ON i = p_partkey % {N})
    SELECT p_partkey, name, host, coalesce(host, name) AS host_or_name
    FROM asked LEFT JOIN host_of ON site_official = name
    """
)
def site_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    official = f"get({alias_array()}, cast(p_partkey % {N} AS int)).site_official"
    asked = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", f"if(p_partkey % 5 = 0, p_brand, {official}) AS name"
    )
    return with_site_host(asked, "name")


@query(
    f"""
    SELECT DISTINCT site_official, replace(site_official, ' ', '') AS pascal, replace(site_official, ' ', '_') AS snake
    FROM ({NAMES_SQL}) WHERE site_official <> ''
    """
)
def distinct_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shops that the typed names of all parts stand for, each with the forms its name takes in files and classes."""
    sites = site_names(spark, sf_dir).where("site_official <> ''").select("site_official").distinct()
    return sites.selectExpr(
        "site_official", f"replace(site_official, ' ', {q('')}) AS pascal", "replace(site_official, ' ', '_') AS snake"
    )
