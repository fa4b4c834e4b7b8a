"""Extraction rules as rows: where a field of a site comes from.

A user adds rows, not code::

    Rule("Zappos", "product_name", "meta[itemprop='name']", read="need", arg="content")

Rows of one (site, field) form a fallback chain by ``priority``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from listloom.functions import text, urls
from listloom.functions.sql import each, either, q
from listloom.operators.dom import Page, one

#: Field of a rule that names the kids' size table (``selector``) of a shop whose sizes are converted.
SIZE_GROUPS = "size_groups"


@dataclass(frozen=True)
class Rule:
    """One source of one field.

    ``pick``: ``one``, ``all`` or a number (negative from the end).
    ``read``: ``text``, ``string``, ``attr`` (null if absent), ``need`` (fails if
    absent), ``lines``; for ``source='json'`` the selector is a JSON path.
    ``within``: only inside the first match of this selector.
    A rule for ``brand_name`` or ``product_name_ko`` is that ability of the shop; one for
    ``size_groups`` says that its sizes are converted.
    ``post``: names from :data:`POST`, with an argument after a colon.
    """

    site: str
    field: str
    selector: str
    pick: str | int = "one"
    read: str = "text"
    arg: str | None = None
    post: tuple[str, ...] = ()
    priority: int = 1
    source: str = "html"
    within: str | None = None


#: Post-processing of one text value.
POST = {
    "strip": lambda v, a: text.strip(v) if a is None else text.strip_chars(v, a),
    "lower": lambda v, a: f"lower({v})",
    "title": lambda v, a: text.title_case(v),
    "remove": lambda v, a: text.remove(v, q(a)),
    "prefix": lambda v, a: f"concat({q(a)}, {v})",
    "before": lambda v, a: urls.before(v, a),
    "large_image": lambda v, a: urls.large_image(v),
    "wide_image": lambda v, a: urls.wide_image(v),
    "full_thumbnail": lambda v, a: urls.full_thumbnail(v),
    "korean_price": lambda v, a: text.korean_price(v),
}


def apply_post(value: str, post: Iterable[str]) -> str:
    for step in post:
        name, _, arg = step.partition(":")
        value = POST[name](value, arg or None)
    return value


def is_list(rule: Rule) -> bool:
    return rule.pick == "all" or rule.read == "lines"


def rule_sql(rule: Rule, page: Page, json: str) -> str:
    """STRING for a single pick, ARRAY<STRING> for a list; null when it fails."""
    if rule.source == "json":
        value = f"get_json_object({json}, {q(rule.selector)})"
        if rule.pick == "all":
            return each(f"from_json({value}, 'array<string>')", lambda v: apply_post(v, rule.post))
        return apply_post(value, rule.post)
    found = page.all(rule.selector) if rule.within is None else page.first(rule.within).inside(rule.selector)
    if rule.pick == "one":
        found = found.first()
    elif rule.pick != "all":
        found = found.nth(int(rule.pick))
    values = {
        "text": found.text,
        "string": found.string,
        "lines": lambda: f"flatten({found.lines()})",
        "attr": lambda: found.attr(rule.arg),
        "need": lambda: found.need(rule.arg),
    }[rule.read]()
    if rule.post:
        values = each(values, lambda v: apply_post(v, rule.post))
    return values if is_list(rule) else one(values)


def fallback_chain(rules: Iterable[Rule], page: Page, json: str) -> str:
    """First rule by priority that yields something.

    A list that found nothing gives way to the next rule, like a missing value.
    """
    candidates = []
    for rule in sorted(rules, key=lambda r: r.priority):
        value = rule_sql(rule, page, json)
        candidates.append(f"get(filter(array({value}), x -> size(x) > 0), 0)" if is_list(rule) else value)
    return either(*candidates) if len(candidates) > 1 else candidates[0]


def rules_from_table(table: DataFrame) -> list[Rule]:
    """Rules kept as a table, read once to build the plan, whose text they are."""
    rows = table.collect()
    out = []
    for row in rows:
        given = {k: v for k, v in row.asDict().items() if v is not None}
        out.append(Rule(**{**given, "post": tuple(given.get("post", ()))}))
    return out
