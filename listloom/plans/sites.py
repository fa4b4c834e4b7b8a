"""Where each supported shop keeps its product fields.

Simple fields are :class:`Rule` rows; fields that combine several elements or a
JSON document of the page are SQL expressions.  A null means "not found" and
becomes the default of the field.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from listloom.functions import sizes as S
from listloom.functions import text as X
from listloom.functions import urls as U
from listloom.functions.sql import NO_TEXTS, complete, each, either, head, keep, let, q, some, tail
from listloom.operators.dom import Elements, Page, one
from listloom.operators.rules import Rule

IS_JSON = "kind = 'json'"


def no_fields(page: Page, meta: str) -> dict[str, Callable[[], str]]:
    return {}


@dataclass(frozen=True)
class Site:
    """Rules and abilities of one shop.

    ``metadata`` yields the JSON data of a page as a struct; it is evaluated once
    per page and handed to ``computed``, which maps fields to expressions.
    ``spare`` fields are known too, but listed only when asked for.
    """

    name: str
    rules: tuple[Rule, ...] = ()
    metadata: Callable[[Page], str] | None = None
    computed: Callable[[Page, str], dict[str, Callable[[], str]]] = no_fields
    spare: Callable[[Page, str], dict[str, Callable[[], str]]] = no_fields
    has_json: bool = False
    needs_rendering: bool = False
    has_brand: bool = False
    has_korean_name: bool = False
    converts_sizes: bool = False
    kids_group: str = "kids"


def description(titles: str, bullets: str) -> str:
    return f"named_struct('titles', {titles}, 'bullets', {bullets})"


def first_and_rest(items: str) -> str:
    """First item is the title, the rest are bullets; null when there is none."""
    return f"if(size({items}) > 0, {description(head(items), tail(items))}, NULL)"


def drop_sku_lines(items: str) -> str:
    return keep(items, lambda t: f"NOT contains(lower({t}), 'sku')")


def with_prefix(prefix: str, items: str) -> str:
    return each(items, lambda v: f"concat({q(prefix)}, {v})")


def script_json(page: Page, marker: str, before: str, end: str, schema: str) -> str:
    """JSON assigned in the first script that holds a marker."""
    script = one(page.first(f'script:-soup-contains("{marker}")').string())
    return f"from_json({X.strip_chars(X.piece(script, before, 1), end)}, {q(schema)})"


# --- Zappos -------------------------------------------------------------------


def _zappos(page: Page, meta: str):
    def product_name() -> str:
        brand = X.strip(one(page.first('span[itemprop="brand"] span[itemprop="name"]').text()))
        name = one(page.first("meta[itemprop='name']").need("content"))
        return X.strip(X.remove(name, f"coalesce({brand}, '')"))

    def size_options() -> str:
        def in_stock(inputs: Elements) -> str:
            free = inputs.where(lambda e: f"NOT contains(lower({e.attr('aria-label')}), 'out of stock')")
            return f"if({inputs.need('aria-label')} IS NULL, NULL, {free.need('data-label')})"

        return page.all('input[data-track-label="size"]').bind(in_stock)

    def descriptions() -> str:
        items = page.first('div[itemprop="description"] ul').children("li").text()
        return let(each(drop_sku_lines(items), X.strip), first_and_rest)

    def size_type() -> str:
        return let(one(page.first("legend#sizingChooser").text()), lambda t: f"if({t} IS NULL, NULL, {S.audience_of(t)})")

    return {
        "product_name": product_name,
        "size_options": size_options,
        "descriptions": descriptions,
        "size_type": size_type,
    }


ZAPPOS = Site(
    "Zappos",
    rules=(
        Rule("Zappos", "brand_name", 'span[itemprop="brand"] span[itemprop="name"]', post=("strip",)),
        Rule("Zappos", "price", 'span[itemprop="price"][content]', read="need", arg="aria-label"),
        Rule("Zappos", "images", "div#stage img[srcset]", "all", "need", "src", post=("large_image",)),
    ),
    computed=_zappos,
    has_brand=True,
    converts_sizes=True,
)

# --- Vans ---------------------------------------------------------------------


def _vans(page: Page, meta: str):
    def price() -> str:
        sale = X.strip(one(page.first("ins.vf-price--sale").text()))
        usual = X.strip(one(page.first("div.vf-product-price").text()))
        return either(f"{meta}.offers.price", sale, usual)

    def descriptions() -> str:
        box = page.first("div.vf-product-details__description")
        whole = box.read(lambda e: X.strip(e.text()))

        def split(parts: Elements) -> str:
            filled = parts.where(lambda e: f"coalesce({X.strip(e.string())} <> '', false)")
            paragraphs = filled.where(lambda e: f"{e.tag()} = 'p'").read(lambda e: X.strip(e.text()))
            others = filled.where(lambda e: f"{e.tag()} <> 'p'").read(lambda e: X.strip(e.text()))
            return f"if({parts.count()} = 0, {description(NO_TEXTS, whole)}, {description(paragraphs, others)})"

        return box.children().bind(split)

    def color_name() -> str:
        label = one(page.first('h3[data-id="colors-selector-on-static-pdp"]').text())
        return let(
            label, lambda t: f"if(contains(lower({t}), 'color:'), {X.strip(X.piece(t, ':', 1))}, {t})"
        )

    def color_urls() -> str:
        labels = page.first("div.color-swatch__wrapper[aria-label='Color']").inside("button").need("aria-label")
        return each(labels, lambda v: U.color_url(X.piece(v, " - ", 0)))

    return {"price": price, "descriptions": descriptions, "color_name": color_name, "color_urls": color_urls}


VANS = Site(
    "Vans",
    rules=(
        Rule("Vans", "product_name", "h1.vf-heading__title"),
        Rule("Vans", "images", "div.image-grid button[data-image-hr-src]", "all", "need", "data-image-hr-src"),
    ),
    metadata=lambda page: (
        f"from_json({one(page.first('script[data-json-ld=\"product\"]').string())}, 'offers struct<price: string>')"
    ),
    computed=_vans,
)

# --- Lacoste ------------------------------------------------------------------

LACOSTE_JSON = (
    "product struct<name: string, pricing: struct<salesPrice: struct<format: string>>, "
    "gallery: struct<images: array<struct<desktopUrl: string>>>, "
    "description: struct<descriptions: array<struct<texts: array<string>, list: array<string>>>>, "
    "variations: struct<size: struct<list: array<struct<label: string, unavailable: boolean>>>>>"
)


def _lacoste(page: Page, meta: str):
    product = f"{meta}.product"

    def product_name() -> str:
        script = one(page.first('script[type="application/ld+json"]').string())
        crumbs = f"from_json({script}, 'itemListElement array<struct<item: struct<name: string>>>').itemListElement"
        return f"if({IS_JSON}, {product}.name, try_element_at({crumbs}, -1).item.name)"

    def price() -> str:
        shown = X.strip(one(page.first("div.js-pdp-price.js-update-price-with-installments p").text()))
        return f"if({IS_JSON}, {product}.pricing.salesPrice.format, {shown})"

    def images() -> str:
        links = complete(each(f"{product}.gallery.images", lambda i: f"{i}.desktopUrl"))
        zoomed = page.all("div.js-zoomable-group img").need("data-zoom-url")
        return with_prefix("https:", f"if({IS_JSON}, {links}, {zoomed})")

    def descriptions() -> str:
        given = f"get({product}.description.descriptions, 0)"
        in_json = (
            f"if({given}.texts IS NULL OR {given}.list IS NULL, NULL, {description(f'{given}.texts', f'{given}.list')})"
        )
        title = page.first("div.js-pdp-description-reload > div > div:last-of-type").read(lambda e: X.strip(e.text()))
        bullets = page.all("div.js-pdp-description-reload li").read(lambda e: X.strip(e.text()))
        on_page = let(title, lambda t: f"if(size({t}) > 0, {description(t, bullets)}, NULL)")
        return f"if({IS_JSON}, {in_json}, {on_page})"

    def size_options() -> str:
        options = f"{product}.variations.size.list"
        broken = some(options, lambda o: f"{o}.unavailable IS NULL")
        free = each(keep(options, lambda o: f"NOT {o}.unavailable"), lambda o: f"{o}.label")
        return f"if({IS_JSON} AND NOT {broken}, {complete(free)}, NULL)"

    return {
        "product_name": product_name,
        "price": price,
        "images": images,
        "descriptions": descriptions,
        "size_options": size_options,
    }


LACOSTE = Site(
    "Lacoste",
    metadata=lambda page: f"from_json(json_body, {q(LACOSTE_JSON)})",
    computed=_lacoste,
    has_json=True,
    converts_sizes=True,
)

# --- Adidas -------------------------------------------------------------------

ADIDAS_JSON = (
    "queries array<struct<state: struct<data: struct<"
    "view_list: array<struct<image_url: string>>, "
    "product_description: struct<subtitle: string, text: string, usps: array<string>>>>>>"
)


def _adidas(page: Page, meta: str):
    data = f"get({meta}.queries, 0).state.data"

    def descriptions() -> str:
        def assemble(d: str) -> str:
            bullets = f"concat(array({d}.text), {d}.usps)"
            lacking = f"{d}.subtitle IS NULL OR {d}.text IS NULL OR {d}.usps IS NULL"
            return f"if({lacking}, NULL, {description(f'array({d}.subtitle)', bullets)})"

        return let(f"{data}.product_description", assemble)

    return {
        "images": lambda: each(complete(each(f"{data}.view_list", lambda v: f"{v}.image_url")), U.wide_image),
        "descriptions": descriptions,
        "size_options": lambda: page.all('button.size___2lbev:not([class*="unavailable"])').read(
            lambda e: let(X.strip(e.text()), S.first_of_pair)
        ),
    }


ADIDAS = Site(
    "Adidas",
    rules=(
        Rule("Adidas", "product_name", 'h1[data-auto-id="product-title"]'),
        Rule("Adidas", "price", "div.gl-price-item--sale", priority=1),
        Rule("Adidas", "price", 'div[data-auto-id="gl-price-item"]', priority=2),
    ),
    metadata=lambda page: script_json(page, "window.REACT_QUERY_DATA", "REACT_QUERY_DATA = ", ");\n", ADIDAS_JSON),
    computed=_adidas,
    needs_rendering=True,
    converts_sizes=True,
    kids_group="kids_with_k",
)

# --- Asics --------------------------------------------------------------------

ASICS_JSON = (
    "product_name array<string>, product_unit_price array<string>, product_sizes array<string>, "
    "product_no_stock_sizes string, product_gender array<string>, product_variant array<string>"
)


def _asics(page: Page, meta: str):
    name, price = f"get({meta}.product_name, 0)", f"get({meta}.product_unit_price, 0)"

    def usable(value: str) -> str:
        # The page counts as unreadable unless all four are there.
        needed = (name, price, f"{meta}.product_sizes", f"{meta}.product_no_stock_sizes")
        return f"if({' OR '.join(f'{n} IS NULL' for n in needed)}, NULL, {value})"

    def size_options() -> str:
        return let(
            X.pieces(f"{meta}.product_no_stock_sizes", "|"), lambda gone: S.without(f"{meta}.product_sizes", gone)
        )

    def descriptions() -> str:
        details = page.all("div.product-info-section-inner p").read(lambda e: X.strip(e.text()))
        techs = page.all("div.product-features-section li").read(lambda e: f"array_join({e.lines()}, '')")
        return let(details, lambda d: f"if(size({d}) > 0, {let(f'concat({d}, {techs})', first_and_rest)}, NULL)")

    return {
        "product_name": lambda: usable(name),
        "price": lambda: usable(price),
        "size_options": lambda: usable(size_options()),
        "size_type": lambda: usable(f"lower(get({meta}.product_gender, 0))"),
        "descriptions": descriptions,
    }


ASICS = Site(
    "Asics",
    rules=(
        Rule("Asics", "images", "ul.product-primary-image li span", "all", "need", "data-zoom-image"),
        Rule("Asics", "color_urls", 'li.variants__item--color:not([aria-checked="true"]) a', "all", "need", "href"),
    ),
    metadata=lambda page: script_json(page, "utag_data", " = ", ";\n\t", ASICS_JSON),
    computed=_asics,
    spare=lambda page, meta: {"color_name": lambda: f"get({meta}.product_variant, 0)"},
    converts_sizes=True,
    kids_group="kids_with_front_k",
)

# --- North Face Korea, North Face Youngone --------------------------------------

SKU_JSON = "array<struct<price: string, quantity: bigint, selectedOptions: array<string>>>"
OPTION_JSON = (
    "array<struct<values: map<string, string>, allowedValues: array<struct<id: string, friendlyName: string>>>>"
)


def sku_quantities(skus: str, options: str) -> str:
    """ARRAY<(label, quantity)>: labels in first-seen order, the last sku of a label wins.

    Null when a sku points to no known label.  Lookups go through array positions;
    lists are reversed because of several equal entries the last one counts.
    """

    def label_of(allowed: str) -> str:
        ids, names = (f"reverse({each(allowed, lambda a: f'{a}.{n}')})" for n in ("id", "friendlyName"))
        return let(
            f"named_struct('ids', {ids}, 'names', {names}, 'asked', {each(skus, lambda s: f'get({s}.selectedOptions, 1)')})",
            lambda o: each(f"{o}.asked", lambda a: f"get({o}.names, cast(array_position({o}.ids, {a}) AS int) - 1)"),
        )

    def latest(found: str) -> str:
        at = lambda l: f"cast(array_position({found}.last_labels, {l}) AS int) - 1"
        return each(
            f"array_distinct({found}.labels)",
            lambda l: f"named_struct('label', {l}, 'quantity', get({found}.last_quantities, {at(l)}))",
        )

    def checked(found: str) -> str:
        unknown = some(f"{found}.labels", lambda l: f"{l} IS NULL")
        uncounted = some(f"{found}.last_quantities", lambda n: f"{n} IS NULL")
        return f"if({unknown} OR {uncounted}, NULL, {latest(found)})"

    quantities = each(skus, lambda s: f"{s}.quantity")
    gathered = let(
        let(f"get({options}, 1).allowedValues", label_of),
        lambda labels: f"named_struct('labels', {labels}, 'last_labels', reverse({labels}), "
        f"'last_quantities', reverse({quantities}))",
    )
    return let(gathered, checked)


def in_stock_labels(quantities: str) -> str:
    return each(keep(quantities, lambda s: f"{s}.quantity <> 0"), lambda s: S.without_mm(f"{s}.label"))


def _north_face_site(name: str, base: str) -> Site:
    def metadata(page: Page) -> str:
        box = page.first("div.product-information.fixit-container")
        skus, options = one(box.attr("data-sku-data")), one(box.attr("data-product-options"))
        parsed = (
            f"named_struct('product_id', {one(box.attr('data-product-id'))}, "
            f"'skus', from_json({skus}, {q(SKU_JSON)}), 'options', from_json({options}, {q(OPTION_JSON)}))"
        )
        # The page counts as unreadable unless all of these are there.
        return let(
            parsed,
            lambda m: f"named_struct('product_id', {m}.product_id, 'price', get({m}.skus, 0).price, "
            f"'color', get(map_values(get({m}.options, 0).values), 0), "
            f"'stock', {sku_quantities(f'{m}.skus', f'{m}.options')})",
        )

    def computed(page: Page, meta: str):
        def usable(value: str) -> str:
            needed = (f"{meta}.{n}" for n in ("product_id", "price", "color", "stock"))
            return f"if({' OR '.join(f'{n} IS NULL' for n in needed)}, NULL, {value})"

        def description_images() -> str:
            size_charts = page.all("div#product-size div.display-small-only img").attr("src")

            def guarded(section: Elements) -> str:
                heading = one(section.inside("h3.section-title").first().text())
                tech = section.inside("img").attr("src")
                return let(
                    heading,
                    lambda h: f"if({h} IS NULL, NULL, concat(if({h} = '테크놀러지', {tech}, {NO_TEXTS}), {size_charts}))",
                )

            return page.first("div#product-info div.pdp-details-content div.product-tags").bind(guarded)

        def descriptions() -> str:
            lines = page.first("div#product-info div.display-small-up p").lines()
            joined = one(each(lines, lambda l: f"array_join({l}, '<br/>')"))
            return let(X.pieces(joined, "<br/>"), first_and_rest)

        def color_urls() -> str:
            def links(box: Elements) -> str:
                found = box.inside("div.variation-color.selectable:not(.selected) a").need("href")
                return f"if({box.count()} = 0, NULL, {with_prefix(base, found)})"

            return page.first("div.product-option_radio.selector-color").bind(links)

        return {
            "price": lambda: usable(X.korean_price(f"{meta}.price")),
            "size_options": lambda: usable(each(in_stock_labels(f"{meta}.stock"), S.bracketed_size)),
            "description_images": description_images,
            "descriptions": descriptions,
            "color_urls": color_urls,
        }

    return Site(
        name,
        rules=(
            Rule(name, "product_name_ko", "span[data-kor-name]", read="need", arg="data-kor-name"),
            Rule(name, "product_name", "h1.product-name"),
            Rule(name, "images", "li.thumb-list img", "all", "need", "src", post=("full_thumbnail",)),
        ),
        metadata=metadata,
        computed=computed,
        spare=lambda page, meta: {"color_name": lambda: X.swap(f"{meta}.color", "_", " ")},
        has_korean_name=True,
    )


NORTH_FACE_KOREA = _north_face_site("North Face Korea", "https://www.thenorthfacekorea.co.kr")
NORTH_FACE_YOUNGONE = _north_face_site("North Face Youngone", "https://www.youngonestore.co.kr")

# --- Abc Grand Stage ------------------------------------------------------------


def _grand_stage(page: Page, meta: str):
    def brand_name() -> str:
        korean = one(page.first("div.detail-box-header input#brandName").attr("value"))
        english = one(page.first("#dialogQnaApply span.prod-brand").text())
        return f"if({korean} IS NULL, NULL, {X.strip(english)})"

    def product_name_ko() -> str:
        name = one(page.first("div.detail-box-header div.prod-name").text())
        material = one(page.first("tbody#product-detail-notice td").text())
        return f"concat({X.strip(name)}, ' ', {X.strip(material)})"

    def descriptions() -> str:
        texts = f"flatten({page.first('div#product-detail-description-wrapper').all_texts()})"
        return let(keep(texts, lambda t: f"{X.strip(t)} <> ''"), first_and_rest)

    return {"brand_name": brand_name, "product_name_ko": product_name_ko, "descriptions": descriptions}


ABC_GRAND_STAGE = Site(
    "Abc Grand Stage",
    rules=(
        Rule("Abc Grand Stage", "product_name", "div.detail-box-header div.prod-name-en"),
        Rule("Abc Grand Stage", "price", 'div.detail-box-header span[data-product="normal-price-amount"]'),
        Rule(
            "Abc Grand Stage", "images", "div.product-detail-box ul.detail-thumbs-list img", "all", "need", "src",
            post=("before:?",),
        ),
        Rule("Abc Grand Stage", "size_options", "div.product-detail-box button.btn-prod-size:not(.sold-out)", "all"),
        Rule(
            "Abc Grand Stage", "description_images", "div#product-detail-description-wrapper img", "all", "attr", "src"
        ),
        Rule(
            "Abc Grand Stage", "color_urls", "ul.style-color-list a", "all", "need", "href",
            post=("prefix:https://grandstage.a-rt.com",),
        ),
    ),
    computed=_grand_stage,
    needs_rendering=True,
    has_brand=True,
    has_korean_name=True,
)

#: The shops with rules, in the order their pages are numbered in tests.
SITES = (ZAPPOS, VANS, LACOSTE, ADIDAS, ASICS, NORTH_FACE_KOREA, NORTH_FACE_YOUNGONE, ABC_GRAND_STAGE)


def capabilities(spark: SparkSession, sites: Iterable[Site] = SITES) -> DataFrame:
    """(site, json, rendered, size_type_known): which document a shop is read from."""
    rows = [
        (s.name, s.has_json, s.needs_rendering, "size_type" in s.computed(Page(), "meta")) for s in sites
    ]
    return spark.createDataFrame(rows, "site string, json boolean, rendered boolean, size_type_known boolean")
