"""URL decisions that follow redirects and canonical links.

Rules name a host, with its subdomains, and the beginning of a path; of those that
fit, the longest decides.  Pages without a rule take the decision of their aliases.
Two URLs are aliases if a page redirects (meta refresh) or points by canonical link
from one to the other (every such tag counts; links are resolved against the page's URL
or its base tag), or if both have the same canonical form, which is without
scheme, ``www.`` or ``m.``, query, fragment, index file, ``.html`` and final slash.
Aliases are the connected components of these edges, found by Spark over URLs, with
the canonical form as the centre of a star, so no group is ever paired with itself.
In a component an explicit allow takes precedence over any block; a component
without decisions is allowed.

A missing URL, or one without ``://``, has an empty host and path, no rule and no
alias, and is allowed.  Missing or empty HTML gives no edges; equal ids and repeated
rows keep their own row; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listloom.llm.components import components
from listloom.llm.leaks import lower_ascii
from listloom.llm.tables import stored

# The rules of the contract.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?(?<![\w-])href\s*=\s*["']?\s*([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?(?<![\w-])url\s*=\s*["']?\s*([^"'\s>]+)"""
BASE = r"""(?is)<base\b[^>]*?(?<![\w-])href\s*=\s*["']?\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    rest = F.when(url.contains("://"), F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return lower_ascii(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    rest = F.when(url.contains("://"), F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def canonical_form(host: Column, path: Column) -> Column:
    name = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.concat(name, F.regexp_replace(path, r"(/index)?(\.html?)?/*$", ""))


def with_rules(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add the longest rule that fits ``host`` and ``path``, and its decision."""
    rule = decision = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, decision = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(decision)
    return pages.withColumn("rule", rule).withColumn("decision", decision)


def without_dots(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    walked = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
    end = F.when(path.rlike(r"/\.\.?$") & (F.size(walked) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(walked, "/"), end)).otherwise(path)


def resolved(links: DataFrame, link: str) -> DataFrame:
    """Put the host and path a link leads to in the place of ``host`` and ``path`` of its page.

    Links of other schemes than those of hosts (``mailto:`` and such) get null.
    """
    to = F.col(link)
    links = links.withColumn("url", F.when(to.startswith("//"), F.concat(F.lit("x:"), to)).otherwise(to))
    url = F.col("url")
    whole, other = url.rlike(r"^([A-Za-z][A-Za-z0-9+.\-]*)?://"), url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    own = F.regexp_extract(url, r"(?s)^([^?#]*)", 1)
    folder = F.regexp_extract("path", r"(?s)^(.*/)", 1)
    rooted = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
    path = F.when(whole, path_of(url)).when(other, None).when(own == "", F.col("path")).otherwise(without_dots(rooted))
    host = F.when(whole, host_of(url)).when(other, None).otherwise(F.col("host"))
    return links.withColumns({"host": host, "path": path})


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Host, path, rule and verdict of every page."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    links = F.array_distinct(F.concat(*(F.regexp_extract_all(html, F.lit(tag), F.lit(1)) for tag in (CANONICAL, REFRESH))))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
        links.alias("links"), F.regexp_extract(html, BASE, 1).alias("base"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = with_rules(rows, rules).withColumn("form", F.when(F.col("host") != "", canonical_form(F.col("host"), F.col("path"))))
    rows = stored(rows, "pages")

    targets = rows.where(F.col("form").isNotNull() & (F.size("links") > 0)).select("form", "host", "path", "base", F.explode("links").alias("link"))
    # A base without a host changes nothing.
    based = resolved(targets.withColumns({"page_host": F.col("host"), "page_path": F.col("path")}), "base")
    usable = F.coalesce(F.col("host"), F.lit("")) != ""
    based = based.withColumns({"host": F.when(usable, F.col("host")).otherwise(F.col("page_host")), "path": F.when(usable, F.col("path")).otherwise(F.col("page_path"))})
    targets = resolved(based, "link")
    # Pages of one form are one node: only links between forms are left to follow.
    edges = targets.where(F.col("host") != "").select("form", canonical_form(F.col("host"), F.col("path")).alias("target")).distinct()
    joined = components(edges, "form", "target").select(F.col("node").alias("form"), "component")
    forms = rows.where(F.col("form").isNotNull()).groupBy("form").agg(
        F.max(F.col("decision") == "allow").alias("allowed"), F.max(F.col("decision") == "block").alias("blocked")
    )
    forms = forms.join(joined, "form", "left").withColumn("component", F.coalesce("component", "form"))
    decided = forms.groupBy("component").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    by_form = forms.select("form", "component").join(decided, "component").select(
        "form", F.when(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False)), "block").otherwise("allow").alias("inherited")
    )
    verdict = F.coalesce("decision", "inherited", F.lit("allow"))
    return rows.join(by_form, "form", "left").select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
