"""Documents to products: one pass over the pages, no shuffle."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from listloom.functions import sizes as S
from listloom.functions import text as X
from listloom.functions.sql import NO_TEXTS, case, either, q
from listloom.operators.dom import Page
from listloom.operators.rules import SIZE_GROUPS, Rule, fallback_chain, is_list
from listloom.plans.sites import IS_JSON, SITES, Site
from listloom.schemas import PRODUCT_FIELDS
from listloom.sources.pages import parse_pages

#: A text service as an expression over text; the default leaves texts as they are.
Translator = Callable[[str], str]


def keep_text(text: str) -> str:
    return text


def default_of(kind: str) -> str:
    """The "nothing found" value of a field type."""
    if kind == "string":
        return "''"
    if kind.startswith("array"):
        return f"cast(array() AS {kind})"
    return f"named_struct('titles', {NO_TEXTS}, 'bullets', {NO_TEXTS})"


def is_site(*names: str) -> str:
    return f"site IN ({', '.join(q(n) for n in names)})" if names else "false"


def extract_fields(
    documents: DataFrame,
    fields: Iterable[str] | None = None,
    rules: Iterable[Rule] = (),
    sites: Iterable[Site] = SITES,
    with_spare: bool = False,
) -> DataFrame:
    """Raw fields of every document ``(…keys, site, kind, body)``.

    Built-in shops and the given rule rows are combined; a rule row of a field
    replaces the built-in source of that field and may name fields of its own.
    ``errors`` lists the fields a site has a source for but which were not found.
    ``with_spare`` adds fields a shop shows but does not list.  The result keeps
    the key columns, ``site`` and ``kind``.
    """
    body, pages = "json_body", defaultdict(Page)
    sites, rules = list(sites), [r for r in rules if r.field != SIZE_GROUPS]
    kinds = dict(PRODUCT_FIELDS)
    for rule in rules:
        kinds.setdefault(rule.field, "array<string>" if is_list(rule) else "string")
    fields = list(kinds) if fields is None else list(fields)

    metadata: dict[str, str] = {}
    sources: dict[str, list[tuple[str, str]]] = {f: [] for f in fields}
    for number, site in enumerate(sites):
        meta, page = f"_meta_{number}", pages[site.name]
        computed = site.computed(page, meta)
        if with_spare:
            computed = site.spare(page, meta) | computed
        for field in fields:
            replaced = [r for r in rules if (r.site, r.field) == (site.name, field)]
            chain = replaced or [r for r in site.rules if r.field == field]
            if field in computed and not replaced:
                value = computed[field]()
            elif chain:
                value = fallback_chain(chain, page, body)
            else:
                continue
            sources[field].append((site.name, value))
            if meta in value and meta not in metadata:
                metadata[meta] = case([(is_site(site.name), site.metadata(page))])
    known = {s.name for s in sites}
    for field in fields:
        for name in dict.fromkeys(r.site for r in rules if r.field == field and r.site not in known):
            chain = [r for r in rules if (r.site, r.field) == (name, field)]
            sources[field].append((name, fallback_chain(chain, pages[name], body)))

    keys = [c for c in documents.columns if c != "body"]
    split = documents.selectExpr(
        *keys, f"if({IS_JSON}, body, NULL) AS json_body", f"if({IS_JSON}, NULL, body) AS html"
    )
    looked_at = {name: page.wanted() for name, page in pages.items()}
    parsed = parse_pages(split, wanted={name: w for name, w in looked_at.items() if w.elements})
    if metadata:
        parsed = parsed.selectExpr("*", *[f"{value} AS {name}" for name, value in metadata.items()])
    present = [f for f in fields if sources[f]]
    chosen = [
        f"{case([(is_site(name), value) for name, value in sources[f]])} AS _{f}" for f in present
    ]
    raw = parsed.selectExpr(*keys, "parse_error", *chosen)
    missing = [f"if({is_site(*[name for name, _ in sources[f]])} AND _{f} IS NULL, '{f}', NULL)" for f in present]
    values = [
        f"{either(f'_{f}', default_of(kinds[f])) if f in present else default_of(kinds[f])} AS {f}" for f in fields
    ]
    broken = "if(parse_error IS NULL, NULL, 'page')"
    return raw.selectExpr(*keys, *values, f"array_compact(array({', '.join([broken, *missing])})) AS errors")


def site_names(test: Callable[[Site], bool], sites: Iterable[Site] = SITES) -> list[str]:
    return [s.name for s in sites if test(s)]


def able(test: Callable[[Site], bool], field: str, sites: Iterable[Site], rules: Iterable[Rule]) -> list[str]:
    """Shops that declare an ability or have a rule row for its field."""
    return list(dict.fromkeys([*site_names(test, sites), *[r.site for r in rules if r.field == field]]))


def brand_of(extracted: str, sites: Iterable[Site] = SITES, rules: Iterable[Rule] = ()) -> str:
    """Malls name the brand on the page, other shops are the brand.

    A mall page without a brand gives an empty brand, not the name of the mall.
    """
    malls = able(lambda s: s.has_brand, "brand_name", sites, rules)
    return f"if({is_site(*malls)}, {X.title_case(f"coalesce({extracted}, '')")}, site)"


def converted_sizes(
    sizes: str, size_type: str, audience: str, shops: Iterable[Site] = SITES, rules: Iterable[Rule] = ()
) -> str:
    """Sizes by size type; shops without a converter keep theirs."""
    kind = S.resolve_size_type(size_type, audience)
    groups = {s.name: s.kids_group for s in shops if s.converts_sizes}
    groups |= {r.site: r.selector for r in rules if r.field == SIZE_GROUPS}
    converting = is_site(*groups)
    branches = [
        (f"NOT {converting}", sizes),
        (f"{kind} = {S.MEN}", S.convert_sizes(sizes, "mens")),
        (f"{kind} = {S.WOMEN}", S.convert_sizes(sizes, "womens")),
    ]
    for group in dict.fromkeys(groups.values()):
        names = [name for name, own in groups.items() if own == group]
        branches.append((f"{kind} = {S.KIDS} AND {is_site(*names)}", S.convert_sizes(sizes, group)))
    return case(branches, sizes)


def replacing(df: DataFrame, **values: str) -> DataFrame:
    """Add or replace columns by expressions."""
    kept = [c for c in df.columns if c not in values]
    return df.selectExpr(*kept, *[f"{value} AS {name}" for name, value in values.items()])


def finish_products(
    raw: DataFrame, translator: Translator = keep_text, sites: Iterable[Site] = SITES, rules: Iterable[Rule] = ()
) -> DataFrame:
    """Raw fields to products: brand, titles, converted sizes, labels, title image.

    The abilities of a shop come from ``sites`` and from the rule rows alike.

    ``raw`` carries ``size_type_asked`` (1 men, 2 women, 3 kids, 4 unchanged,
    5 from the page) beside the extracted fields.
    """
    sites, rules = list(sites), list(rules)
    korean = is_site(*able(lambda s: s.has_korean_name, "product_name_ko", sites, rules))
    branded = replacing(
        raw,
        brand_name=brand_of("brand_name", sites, rules),
        product_name_ko=f"if({korean}, product_name_ko, {translator('product_name')})",
        price=X.without_currency("price"),
        size_options=converted_sizes("size_options", "size_type_asked", "size_type", sites, rules),
        title_image="coalesce(get(images, 0), '')",
    )
    named = replacing(branded, brand_name_ko=X.squash(translator("brand_name")))
    return replacing(
        named,
        full_title=X.full_title("brand_name_ko", "product_name_ko", "product_name"),
        price_num="try_cast(price AS decimal(12,2))",
        size_quantity_options=S.quantity_labels("size_options"),
    )
