"""Render catalogue tables as shop pages.

The inverse of extraction, as SQL expressions: one page per part in the markup of
shop ``p_partkey % 8``.  Extracting the pages again and comparing with plain SQL
on the catalogue checks parser, selectors, rules and assembly end to end.  Nothing
is stored; pages exist only inside a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listloom.functions.sql import case, each, fill, keep, q, texts
from listloom.plans.sites import SITES
from listloom.sources.dims import host_map
from listloom.sources.pages import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stocked_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_partkey, quantities, in_stock): distinct values per part, ascending.

    Both sets are combined before the shuffle and hold at most the distinct
    quantities, so a part with very many lines stays small.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_linestatus")
    open_lines = F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))
    return lines.groupBy("l_partkey").agg(
        F.array_sort(F.collect_set("l_quantity")).alias("quantities"),
        F.array_sort(F.collect_set(open_lines)).alias("in_stock"),
    )


def size_text(quantity: str) -> str:
    """Half the quantity as US size text: ``7``, ``7.5``."""
    return f"regexp_replace(cast({quantity} / 2 AS string), {q(r'\.0$')}, '')"


def price_text(price: str) -> str:
    return f"cast(cast({price} AS decimal(12,2)) AS string)"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part with everything a page shows.

    ``k`` numbers the shop and ``c`` the case within it; ``links`` are the next
    up to three parts of the same block of ten, the colour family.
    """
    part = spread(table(spark, sf_dir, "part"))
    numbered = part.selectExpr("*", "cast(p_partkey % 8 AS int) AS k", "cast(floor(p_partkey / 8) AS bigint) AS c")
    shown = numbered.selectExpr(
        "*",
        f"get({texts([s.name for s in SITES])}, k) AS site",
        f"get({texts(["Women's Sizes", "Men's Sizes", "Unisex", "Big Kid"])}, cast(c % 4 AS int)) AS audience",
        "concat(format_number(cast(p_retailprice AS decimal(12,2)) * 100, 0), ' 원') AS won",
        f"concat('$', {price_text('p_retailprice')}) AS usd",
        f"concat('$', {price_text('p_retailprice - 10')}) AS usd_sale",
        "sequence(1, p_size % 5 + 1) AS pictures",
        "transform(filter(array(1, 2, 3), i -> i <= 9 - p_partkey % 10), i -> p_partkey + i) AS links",
        "c % 5 <> 4 AS described",
    )
    addressed = shown.selectExpr(
        "*", f"concat(try_element_at({host_map()}, site), '/p/', p_partkey, '.html?color=', p_partkey % 7) AS url"
    )
    none = "cast(array() AS array<double>)"
    sized = addressed.join(stocked_sizes(spark, sf_dir), F.expr("p_partkey = l_partkey"), "left")
    return sized.selectExpr(
        *addressed.columns,
        f"coalesce(quantities, {none}) AS quantities",
        f"coalesce(in_stock, {none}) AS in_stock",
    )


def _each(items: str, template: str, **parts) -> str:
    """Fill a template per list item; a part may be a function of the item."""

    def one_item(x: str) -> str:
        return fill(template, **{k: (v(x) if callable(v) else v) for k, v in parts.items()})

    return f"array_join({each(items, one_item)}, '')"


def _item(x: str) -> str:
    return f"cast({x} AS string)"


def _attribute(json: str) -> str:
    """JSON as an attribute value."""
    return f"replace({json}, '\"', '&quot;')"


HEAD = (
    '<!DOCTYPE html><html><head><meta charset="utf-8"><title>shop</title><style>p{margin:0}</style>'
    '<script>var t="</p>";track(1);</script>'
)
PROLOGUE = '</head><body><nav><ul><li><a href="/">home</a></li></ul></nav><!-- ad --><b>hot'
EPILOGUE = "<footer>&copy; shop</footer></body></html>"


def _page(*body: str, top: str = "''") -> str:
    return f"concat({', '.join([q(HEAD), top, q(PROLOGUE), *body, q(EPILOGUE)])})"


def _stocked(quantity: str) -> str:
    return f"array_contains(in_stock, {quantity})"


def _unless_stocked(text: str):
    return lambda x: f"if({_stocked(x)}, '', {q(text)})"


def _described(text: str) -> str:
    return f"if(described, {text}, '')"


P, SIZE = "cast(p_partkey AS string)", "cast(p_size AS string)"


def _zappos_page() -> str:
    return _page(
        q('<div id="stage"><img src="/logo.png">'),
        _each("pictures", '<img src="https://img.test/{p}-{i}._AC_SR38,50_.jpg" srcset="2x">', p=P, i=_item),
        q("</div>"),
        fill('<span itemprop="brand"><i>by</i><span itemprop="name"> {b} </span></span>', b="p_brand"),
        fill(
            '<span itemprop="price">from</span><span itemprop="price" content="1" aria-label="{usd}">{usd}</span>',
            usd="usd",
        ),
        fill('<fieldset><legend id="sizingChooser">{a}</legend>', a="audience"),
        _each(
            "quantities",
            '<input data-track-label="size" data-label="{s}" aria-label="Size {s}{out}">',
            s=size_text,
            out=_unless_stocked(" is Out Of Stock"),
        ),
        f"if(c % 10 = 3, {q('<input data-track-label="size" data-label="9D" aria-label="Size 9D">')}, '')",
        q("</fieldset>"),
        _described(
            fill(
                '<div itemprop="description"><ul><li> {t} </li><li>SKU {p}</li><li>size {z}</li></ul>'
                "<ul><li>no</li></ul></div>",
                t="p_type", p=P, z=SIZE,
            )
        ),
        top=fill('<meta itemprop="name" content="{b} {n}">', b="p_brand", n="p_name"),
    )


def _vans_page() -> str:
    offer = f"to_json(named_struct('offers', named_struct('price', {price_text('p_retailprice')})))"
    meta = fill('<script data-json-ld="product">{j}</script>', j=offer)
    sale = fill('<ins class="vf-price--sale"> {x} </ins>', x="usd_sale")
    box = '<div class="vf-product-details__description">'
    long = fill(box + "<p>{t}</p><p> </p><ul><li>size {z}</li></ul></div>", t="p_type", z=SIZE)
    return _page(
        fill('<h1 class="big vf-heading__title">{n}</h1>', n="p_name"),
        f"if(c % 3 = 1, {sale}, '')",
        fill('<div class="vf-product-price"> {x} </div>', x="usd"),
        q('<div class="image-grid"><button>zoom</button>'),
        _each("pictures", '<button data-image-hr-src="https://img.test/{p}-{i}.jpg"></button>', p=P, i=_item),
        q("</div>"),
        case([("c % 5 = 3", fill(box + " {t} </div>", t="p_type")), ("described", long)], "''"),
        fill(
            '<h3 data-id="colors-selector-on-static-pdp">{l}Red {p}</h3>', l="if(c % 2 = 0, 'Color: ', '')", p=P
        ),
        q('<div class="color-swatch__wrapper" aria-label="Color">'),
        _each("links", '<button aria-label="VN{q}X - Red"></button>', q=_item),
        q('</div><div class="color-swatch__wrapper" aria-label="Other"><button aria-label="no"></button></div>'),
        top=f"if(c % 3 = 0, {meta}, '')",
    )


def _lacoste_json() -> str:
    given = f"named_struct('texts', array(p_type), 'list', array(concat('size ', {SIZE})))"
    images = each("pictures", lambda i: f"named_struct('desktopUrl', concat('//img.test/', {P}, '-', {i}, '.jpg'))")
    sizes = each(
        "quantities", lambda x: f"named_struct('label', {size_text(x)}, 'unavailable', NOT {_stocked(x)})"
    )
    product = (
        f"named_struct('name', p_name, 'pricing', named_struct('salesPrice', named_struct('format', usd)), "
        f"'gallery', named_struct('images', {images}), "
        f"'description', named_struct('descriptions', filter(array({given}), x -> described)), "
        f"'variations', named_struct('size', named_struct('list', {sizes})))"
    )
    return f"to_json(named_struct('product', {product}))"


def _adidas_page() -> str:
    views = each(
        "pictures", lambda i: f"named_struct('image_url', concat('https://img.test/w_600/', {P}, '-', {i}, '.jpg'))"
    )
    text = f"named_struct('subtitle', p_type, 'text', concat('size ', {SIZE}), 'usps', array(concat('SKU ', {P})))"
    data = f"named_struct('view_list', {views}, 'product_description', if(described, {text}, NULL))"
    state = f"to_json(named_struct('queries', array(named_struct('state', named_struct('data', {data})))))"
    return _page(
        q("<script>window.DATA_STORE = 1;</script>"),
        fill("<script>window.REACT_QUERY_DATA = {j});\n</script>", j=state),
        fill('<h1 data-auto-id="product-title">{n}</h1>', n="p_name"),
        f"if(c % 3 = 0, {fill('<div class="gl-price-item--sale">{x}</div>', x='usd_sale')}, '')",
        fill('<div data-auto-id="gl-price-item">{x}</div>', x="usd"),
        q("<section>"),
        _each(
            "quantities",
            '<button class="size___2lbev{out}"> {s} </button>',
            out=_unless_stocked(" size--unavailable"),
            s=lambda x: f"if(c % 2 = 0, concat('M ', {size_text(x)}, ' / W ', {size_text(f'({x} + 2)')}), {size_text(x)})",
        ),
        q("</section>"),
    )


def _asics_page() -> str:
    def label(x: str) -> str:
        return f"concat(if(c % 4 = 3 AND {x} BETWEEN 14 AND 27, 'K', ''), {size_text(x)})"

    sold_out = each(keep("quantities", lambda x: f"NOT {_stocked(x)}"), label)
    data = (
        f"named_struct('product_name', array(p_name), 'product_unit_price', array({price_text('p_retailprice')}), "
        f"'product_sizes', {each('quantities', label)}, "
        f"'product_no_stock_sizes', array_join({sold_out}, '|'), "
        f"'product_gender', array(get({texts(['WOMEN', 'MEN', 'UNISEX', 'KIDS'])}, cast(c % 4 AS int))))"
    )
    return _page(
        fill("<script>\n\tvar utag_data = {j};\n\t</script>", j=f"to_json({data})"),
        q('<ul class="product-primary-image">'),
        _each("pictures", '<li><span data-zoom-image="https://img.test/{p}-{i}.jpg"></span></li>', p=P, i=_item),
        q("</ul>"),
        _described(
            fill(
                '<div class="product-info-section-inner"><p> {t} </p><p>size {z}</p></div>'
                '<div class="product-features-section"><ul><li><div> SKU {p} </div> tail </li></ul></div>',
                t="p_type", z=SIZE, p=P,
            )
        ),
        q('<ul><li class="variants__item--color" aria-checked="true"><a href="/self">c</a></li>'),
        _each(
            "links",
            '<li class="variants__item--color" aria-checked="false"><a href="https://www.asics.com/p/{q}.html">c</a></li>',
            q=_item,
        ),
        q("</ul>"),
    )


def sku_json() -> str:
    """Skus of a Korean page; on every third page the first label comes twice."""

    def sku(x: str, quantity: str) -> str:
        option = f"array('284', cast(cast({x} AS int) + 500 AS string))"
        return f"named_struct('price', won, 'quantity', cast({quantity} AS int), 'selectedOptions', {option})"

    skus = each("quantities", lambda x: sku(x, f"if({_stocked(x)}, {x}, 0)"))
    again = each("slice(quantities, 1, 1)", lambda x: sku(x, "3"))
    return f"to_json(concat({skus}, if(c % 3 = 0, {again}, slice({again}, 1, 0))))"


def option_json() -> str:
    """Options of a Korean page: a foot length, or a clothing size on every fourth."""

    def label(x: str) -> str:
        whole = f"cast({x} AS int)"
        return f"if(c % 4 = 3, concat('0', {whole}, '(W', {whole}, ')'), concat({whole} * 5, 'MM'))"

    sizes = each(
        "quantities", lambda x: f"named_struct('id', cast({x} AS int) + 500, 'friendlyName', {label(x)})"
    )
    color = f"""concat('{{"values":{{"284":"LIGHT_', upper(p_type), '"}}}}')"""
    return f"concat('[', {color}, ',', to_json(named_struct('allowedValues', {sizes})), ']')"


def _north_face_page() -> str:
    return _page(
        fill(
            '<div class="product-information fixit-container" data-product-id="{p}" '
            'data-sku-data="{s}" data-product-options="{o}">',
            p=P, s=_attribute(sku_json()), o=_attribute(option_json()),
        ),
        fill('<h1 class="product-name">{n}</h1><span data-kor-name="상품 {n}"></span><ul>', n="p_name"),
        _each("pictures", '<li class="thumb-list"><img src="https://img.test/{p}-{i}.jpg?thumbnail"></li>', p=P, i=_item),
        q('</ul></div><div id="product-info">'),
        _described(
            fill(
                '<div class="display-small-up"><p> {t} <br/>size {z}<br/>SKU {p}</p><p>no</p></div>',
                t="p_type", z=SIZE, p=P,
            )
        ),
        fill(
            '<div class="pdp-details-content"><div class="product-tags"><h3 class="section-title">{h}</h3>'
            '<img src="/tech/{p}.png"></div><div class="product-tags"><img src="/no.png"></div></div></div>'
            '<div id="product-size"><div class="display-small-only"><img src="/size/{p}.png"></div></div>',
            h="if(c % 2 = 0, '테크놀러지', '소재')", p=P,
        ),
        q(
            '<div class="product-option_radio selector-color">'
            '<div class="variation-color selectable selected"><a href="/self">c</a></div>'
        ),
        _each("links", '<div class="variation-color selectable"><a href="/p/{q}">c</a></div>', q=_item),
        q("</div>"),
    )


def _grand_stage_page() -> str:
    return _page(
        q('<div class="product-detail-box"><div class="detail-box-header">'),
        f"if(c % 6 = 5, '', {q('<input id="brandName" value="브랜드">')})",
        fill('<div class="prod-name"> 상품 {n} </div><div class="prod-name-en">{n}</div>', n="p_name"),
        fill('<span data-product="normal-price-amount">{x}</span></div>', x="won"),
        q('<ul class="detail-thumbs-list">'),
        _each("pictures", '<li><img src="https://img.test/{p}-{i}.jpg?x=1"></li>', p=P, i=_item),
        q("</ul>"),
        _each(
            "quantities",
            '<button class="btn-prod-size{out}">{s}</button>',
            out=_unless_stocked(" sold-out"),
            s=lambda x: f"cast(cast({x} AS int) * 5 AS string)",
        ),
        q("</div>"),
        fill(
            '<table><tbody id="product-detail-notice"><tr><td> {t} </td><td>no</td></tr></tbody></table>', t="p_type"
        ),
        q('<div id="product-detail-description-wrapper"><div>\n'),
        _described(fill("<strong>{t}</strong> <span>size {z}</span><div>SKU {p}</div>", t="p_type", z=SIZE, p=P)),
        fill('\n<img src="/detail/{p}.png"></div></div>', p=P),
        fill('<div id="dialogQnaApply"><span class="prod-brand"> {b} </span></div>', b="upper(p_brand)"),
        q('<ul class="style-color-list">'),
        _each("links", '<li><a href="/product?prdtNo={q}">c</a></li>', q=_item),
        q("</ul>"),
    )


def shop_documents(catalogue_rows: DataFrame, *keep_columns: str) -> DataFrame:
    """(p_partkey, …, site, kind, url, body): the rendered page of every part."""
    body = case(
        [
            ("k = 0", _zappos_page()),
            ("k = 1", _vans_page()),
            ("k = 2", _lacoste_json()),
            ("k = 3", _adidas_page()),
            ("k = 4", _asics_page()),
            ("k IN (5, 6)", _north_face_page()),
        ],
        _grand_stage_page(),
    )
    kind = case([("k = 2", "'json'"), ("k IN (3, 7)", "'rendered'")], "'raw'")
    return catalogue_rows.selectExpr("p_partkey", *keep_columns, "site", f"{kind} AS kind", "url", f"{body} AS body")
