"""Pages of every shop, with the cases that go wrong."""

import json
import os

import pytest

from listloom.operators.glossary import constant_glossary
from listloom.operators.rules import Rule, rules_from_table
from listloom.plans.listings import make_listings, make_products
from listloom.plans.products import extract_fields
from listloom.plans.sites import capabilities
from listloom.schemas import PRODUCT_FIELDS
from listloom.sources.dims import site_images

DOCUMENTS = "id string, site string, kind string, url string, body string"


@pytest.fixture(scope="module")
def extract(spark):
    def run(site, body, *fields, kind="raw"):
        docs = spark.createDataFrame([("x", site, kind, "https://x.test/1", body)], DOCUMENTS)
        row = extract_fields(docs, fields or None).first()
        return row.asDict(recursive=True)

    return run


def test_empty_page_gives_defaults(extract):
    got = extract("Zappos", "")
    assert got["product_name"] == "" and got["images"] == [] and got["price"] == ""
    assert got["descriptions"] == {"titles": [], "bullets": []}
    assert set(got["errors"]) == {"product_name", "brand_name", "price", "size_type", "images", "descriptions"}


def test_unknown_site_has_no_errors(extract):
    got = extract("Somewhere", "<h1>x</h1>")
    assert got["errors"] == [] and got["product_name"] == ""


def test_zappos(extract):
    page = """<meta itemprop="name" content="Lacoste Angular JQ"><span itemprop="brand"><span itemprop="name">Lacoste </span></span>
    <span itemprop="price" aria-label="no">x</span><span itemprop="price" content="1" aria-label="$135.00">y</span>
    <div id="stage"><img src="https://m/1._AC_SR1_.jpg" srcset="a"><img src="https://m/2.jpg" srcset="b"><img src="z"></div>
    <legend id="sizingChooser">Men's Sizes</legend>
    <input data-track-label="size" data-label="7" aria-label="Size 7"><input data-track-label="size" aria-label="8 is OUT OF STOCK">
    <div itemprop="description"><ul><li> Title </li><li>sku: 1</li><li>b<ul><li>nested</li></ul></li></ul></div>"""
    got = extract("Zappos", page)
    assert got["product_name"] == "Angular JQ"
    assert got["brand_name"] == "Lacoste"
    assert got["price"] == "$135.00"
    # A link without the size mark is kept whole.
    assert got["images"] == ["https://m/1._AC_SR800,1500_.jpg", "https://m/2.jpg"]
    assert got["size_options"] == ["7"] and got["size_type"] == "men"
    assert got["descriptions"] == {"titles": ["Title"], "bullets": ["bnested"]}
    assert got["errors"] == []


def test_zappos_size_without_label_spoils_the_list(extract):
    page = '<input data-track-label="size" data-label="7" aria-label="7"><input data-track-label="size" data-label="8">'
    assert extract("Zappos", page, "size_options")["size_options"] == []


def test_vans_price_sources(extract):
    meta = '<script data-json-ld="product">{"offers": {"price": %s}}</script>'
    sale = '<ins class="vf-price--sale"> $40 </ins><div class="vf-product-price">$50</div>'
    price = lambda body: extract("Vans", body, "price")["price"]
    assert price(meta % '"99.95"' + sale) == "99.95"
    # A number is kept as text instead of stopping the run.
    assert price(meta % "99.5" + sale) == "99.5"
    assert price(sale) == "$40"
    assert price('<script data-json-ld="product">{broken</script><div class="vf-product-price"> $50 </div>') == "$50"
    assert price("<p>none</p>") == ""


def test_vans_descriptions(extract):
    box = '<div class="vf-product-details__description">%s</div>'
    parts = lambda body: extract("Vans", body, "descriptions")["descriptions"]
    assert parts(box % " plain ") == {"titles": [], "bullets": ["plain"]}
    assert parts(box % "<p> long </p><p> </p><ul><li>a</li></ul><div><b>x</b>y</div>") == {"titles": ["long"], "bullets": ["a"]}
    assert parts("<p>none</p>") == {"titles": [], "bullets": []}


def test_vans_colors(extract):
    page = """<h3 data-id="colors-selector-on-static-pdp">COLOR: Earth Tones</h3>
    <div class="color-swatch__wrapper" aria-label="Size"><button aria-label="no"></button></div>
    <div class="color-swatch__wrapper" aria-label="Color"><button aria-label="VN0A - Red"></button><button aria-label="VN0B"></button></div>"""
    got = extract("Vans", page, "color_name", "color_urls")
    assert got["color_name"] == "Earth Tones"
    assert got["color_urls"] == ["https://www.vans.com/en-us/vn0a", "https://www.vans.com/en-us/vn0b"]


def _lacoste(**changes):
    product = {
        "name": "Polo", "pricing": {"salesPrice": {"format": "$90.99", "value": 90}},
        "gallery": {"images": [{"desktopUrl": "//i/1"}, {"desktopUrl": "//i/2"}]},
        "description": {"descriptions": [{"texts": ["t"], "list": ["a", "b"]}]},
        "variations": {"size": {"list": [{"label": "7", "unavailable": False}, {"label": "8", "unavailable": True}]}},
    }
    return json.dumps({"product": product | changes})


def test_lacoste_json(extract):
    got = extract("Lacoste", _lacoste(), kind="json")
    assert (got["product_name"], got["price"]) == ("Polo", "$90.99")
    assert got["images"] == ["https://i/1", "https://i/2"]
    assert got["descriptions"] == {"titles": ["t"], "bullets": ["a", "b"]}
    assert got["size_options"] == ["7"] and got["errors"] == []
    broken = extract("Lacoste", _lacoste(gallery={"images": [{}]}, description={"descriptions": []}), kind="json")
    assert broken["images"] == [] and broken["descriptions"] == {"titles": [], "bullets": []}
    assert set(broken["errors"]) == {"images", "descriptions"}


def test_lacoste_html(extract):
    page = """<script type="application/LD+json">{"itemListElement": [{"item": {"name": "Home"}}, {"item": {"name": "Polo"}}]}</script>
    <div class="js-pdp-price js-update-price-with-installments"><p> $80 </p><p>$90</p></div>
    <div class="js-zoomable-group"><img data-zoom-url="//z/1"></div>
    <div class="js-pdp-description-reload"><div><div>sku</div><div> Title </div></div><ul><li> a </li></ul></div>"""
    got = extract("Lacoste", page)
    assert (got["product_name"], got["price"], got["images"]) == ("Polo", "$80", ["https://z/1"])
    assert got["descriptions"] == {"titles": ["Title"], "bullets": ["a"]}
    assert got["size_options"] == []


def test_adidas(extract):
    data = {"queries": [{"state": {"data": {
        "view_list": [{"image_url": "https://a/w_600/1"}],
        "product_description": {"subtitle": "s", "text": "t", "usps": ["u"]}}}}]}
    page = f"""<h1 data-auto-id="product-title">Samba</h1><script>window.REACT_QUERY_DATA = {json.dumps(data)});
    </script><div class="gl-price-item--sale">$70</div><div data-auto-id="gl-price-item">$90</div>
    <button class="size___2lbev"> M 6.5 / W 7.5 </button><button class="size___2lbev unavailable__x">7</button>
    <button class="size___2lbev"> 13.5K </button>"""
    # strip() of the tail only removes ");" and line ends, so no blanks may follow.
    page = page.replace("});\n    </script>", "});\n</script>")
    got = extract("Adidas", page, kind="rendered")
    assert (got["product_name"], got["price"]) == ("Samba", "$70")
    assert got["images"] == ["https://a/w_1400/1"]
    assert got["descriptions"] == {"titles": ["s"], "bullets": ["t", "u"]}
    assert got["size_options"] == ["6.5", "13.5K"]


def _asics(**changes):
    data = {
        "product_name": ["GEL"], "product_unit_price": ["140.00"], "product_sizes": ["6", "6.5", "7", "7"],
        "product_no_stock_sizes": "6|6.5", "product_gender": ["MEN"],
    }
    return f"<script>\n\tvar utag_data = {json.dumps(data | changes)};\n\t</script>"


def test_asics(extract):
    page = _asics() + """<ul class="product-primary-image"><li><span data-zoom-image="z1"></span></li></ul>
    <div class="product-info-section-inner"><p> T </p><p>b</p></div>
    <div class="product-features-section"><li><div> x </div> y </li></div>
    <li class="variants__item--color" aria-checked="true"><a href="/1"></a></li><li class="variants__item--color"><a href="/2"></a></li>"""
    got = extract("Asics", page)
    assert (got["product_name"], got["price"], got["size_type"]) == ("GEL", "140.00", "men")
    assert got["size_options"] == ["7", "7"]
    assert got["images"] == ["z1"] and got["color_urls"] == ["/2"]
    assert got["descriptions"] == {"titles": ["T"], "bullets": ["b", "xy"]}


def test_asics_needs_all_of_its_data(extract):
    got = extract("Asics", _asics(product_no_stock_sizes=None), "product_name", "price", "size_options", "size_type")
    assert (got["product_name"], got["price"], got["size_options"], got["size_type"]) == ("", "", [], "")


def _north_face(skus, allowed):
    options = [{"values": {"284": "LIGHT_KHAKI"}}, {"allowedValues": allowed}]
    attr = lambda v: json.dumps(v, ensure_ascii=False).replace('"', "&quot;")
    return f'<div class="product-information fixit-container" data-product-id="1" data-sku-data="{attr(skus)}" data-product-options="{attr(options)}"></div>'


ALLOWED = [{"id": 543, "friendlyName": "230MM"}, {"id": 544, "friendlyName": "085(WS)"}, {"id": 545, "friendlyName": "230MM"}]


def _sku(option, quantity):
    return {"price": "170,100 원", "quantity": quantity, "selectedOptions": [284, option]}


@pytest.mark.parametrize("site", ["North Face Korea", "North Face Youngone"])
def test_north_face_skus(extract, site):
    # 543 and 545 share a label: the later sku counts, the place is the first one's.
    page = _north_face([_sku(543, 5), _sku(544, 2), _sku(545, 0)], ALLOWED)
    got = extract(site, page, "price", "size_options")
    assert got["price"] == "170100" and got["size_options"] == ["여성S"]
    page = _north_face([_sku(543, 0), _sku(544, 2), _sku(545, 9)], ALLOWED)
    assert extract(site, page, "size_options")["size_options"] == ["230", "여성S"]


def test_north_face_unknown_option_spoils_the_page(extract):
    got = extract("North Face Korea", _north_face([_sku(543, 5), _sku(999, 2)], ALLOWED), "price", "size_options")
    assert (got["price"], got["size_options"]) == ("", [])


def test_north_face_images_and_text(extract):
    section = '<div id="product-info"><div class="display-small-up"><p> a <br/>b<br/> </p></div><div class="pdp-details-content"><div class="product-tags">%s<img src="/t"></div></div></div>'
    size = '<div id="product-size"><div class="display-small-only"><img src="/s"></div></div>'
    read = lambda h: extract("North Face Korea", section % h + size, "description_images", "descriptions")
    assert read('<h3 class="section-title">테크놀러지</h3>')["description_images"] == ["/t", "/s"]
    assert read('<h3 class="section-title">소재</h3>')["description_images"] == ["/s"]
    # Without a heading nothing is taken, the size charts included.
    assert read("")["description_images"] == []
    assert read("")["descriptions"] == {"titles": ["a"], "bullets": ["b"]}


def test_grand_stage(extract):
    page = """<div class="product-detail-box"><div class="detail-box-header"><input id="brandName" value="나이키">
    <div class="prod-name"> 에어 </div><div class="prod-name-en">Air</div><span data-product="normal-price-amount">99,000</span></div>
    <ul class="detail-thumbs-list"><img src="/1.jpg?x"></ul><button class="btn-prod-size">250</button><button class="btn-prod-size sold-out">255</button></div>
    <table><tbody id="product-detail-notice"><td> 가죽 </td></tbody></table><div id="dialogQnaApply"><span class="prod-brand"> NIKE </span></div>
    <div id="product-detail-description-wrapper"><div> <span> One</span><strong>Two</strong><img src="/d.jpg"><img></div></div>
    <ul class="style-color-list"><a href="/product?prdtNo=2"></a></ul>"""
    got = extract("Abc Grand Stage", page)
    assert (got["product_name"], got["product_name_ko"], got["brand_name"]) == ("Air", "에어 가죽", "NIKE")
    assert got["price"] == "99,000" and got["images"] == ["/1.jpg"] and got["size_options"] == ["250"]
    assert got["descriptions"] == {"titles": [" One"], "bullets": ["Two"]}
    assert got["description_images"] == ["/d.jpg", None]
    assert got["color_urls"] == ["https://grandstage.a-rt.com/product?prdtNo=2"]
    without = page.replace('<input id="brandName" value="나이키">', "")
    assert extract("Abc Grand Stage", without, "brand_name")["brand_name"] == ""


def test_golden_row(spark):
    sizes = ["7", "7.5", "8", "8.5", "9", "9.5", "10", "10.5", "11", "11.5", "12", "13"]
    page = """<meta itemprop="name" content="Lacoste Angular JQ 123 1 CMA"><span itemprop="brand"><span itemprop="name">Lacoste</span></span>
    <span itemprop="price" content="135" aria-label="$135.00"></span><legend id="sizingChooser">Men's</legend>
    <div id="stage"><img src="https://m.media-amazon.com/images/I/71u7JoIP+WL._AC_SR1,1_.jpg" srcset="1"></div>"""
    page += "".join(f'<input data-track-label="size" data-label="{s}" aria-label="{s}">' for s in sizes)
    docs = spark.createDataFrame([("x", "Zappos", "raw", "https://www.zappos.com/p/1", page)], DOCUMENTS)
    translate = constant_glossary([("Lacoste", "라코스테"), ("Angular", "각도")])
    row = make_listings(docs, site_images(spark), "id", translator=translate).first()
    assert len(row) == 23 and None not in row
    assert row["C"] == "라코스테 각도 JQ 123 1 CMA Angular JQ 123 1 CMA"
    assert row["E"] == "135.00"
    assert row["J"] == "250,255,260,265,270,275,280,285,290,295,300,310"
    assert row["L"] == "11,22,33,44,55,66,77,88,99,10,11,12"
    assert row["R"] == "https://m.media-amazon.com/images/I/71u7JoIP+WL._AC_SR800,1500_.jpg"
    assert row["S"] == "https://www.zappos.com/p/1" and row["U"] == row["V"] == "라코스테"
    assert 'alt="라코스테"' in row["T"]
    assert [row[c] for c in "ABDFGHIKMNOPQ"] == [""] * 13


def test_size_type_asked_per_row(spark):
    page = '<input data-track-label="size" data-label="7" aria-label="7"><legend id="sizingChooser">Women</legend>'
    docs = spark.createDataFrame(
        [(n, "Zappos", "raw", "u", page) for n in (1, 2, 3, 4, 5)],
        "size_type_asked int, site string, kind string, url string, body string",
    )
    got = {r[0]: r[1] for r in make_products(docs).select("size_type_asked", "size_options").collect()}
    assert got == {1: ["250"], 2: ["240"], 3: ["130"], 4: ["7"], 5: ["240"]}


def test_rules_from_a_table(spark):
    table = spark.createDataFrame(
        [("Shop", "product_name", "h2", None, 1), ("Shop", "product_name", "h1", ["strip"], 2)],
        "site string, field string, selector string, post array<string>, priority int",
    )
    rules = rules_from_table(table)
    assert rules[1] == Rule("Shop", "product_name", "h1", post=("strip",), priority=2)
    docs = spark.createDataFrame([("a", "Shop", "raw", "u", "<h1> x </h1>"), ("b", "Shop", "json", "u", "{}")], DOCUMENTS)
    got = {r["id"]: r["product_name"] for r in extract_fields(docs, ["product_name"], rules).collect()}
    assert got == {"a": "x", "b": ""}


def test_json_rules_replace_built_in_sources(spark):
    rules = [
        Rule("Lacoste", "product_name", "$.title", source="json", post=("title",)),
        Rule("Lacoste", "tags", "$.tags", "all", source="json", post=("prefix:#",)),
    ]
    docs = spark.createDataFrame([("a", "Lacoste", "json", "u", '{"title": "ab c", "tags": ["x", "y"]}')], DOCUMENTS)
    row = extract_fields(docs, ["product_name", "tags"], rules).first()
    assert (row["product_name"], row["tags"]) == ("Ab C", ["#x", "#y"])


def test_all_fields_have_a_default(spark):
    docs = spark.createDataFrame([("a", "Vans", "raw", "u", None)], DOCUMENTS)
    row = extract_fields(docs)
    assert {f.name for f in row.schema} >= set(PRODUCT_FIELDS)
    assert all(row.first()[f] is not None for f in PRODUCT_FIELDS)


def test_no_shuffle_between_pages_and_rows(spark):
    docs = spark.createDataFrame([("a", "Vans", "raw", "u", "")], DOCUMENTS)
    plan = make_listings(docs, site_images(spark), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_spare_fields(spark):
    pages = [
        ("a", "Asics", "raw", "u", _asics(product_variant=["Teal"])),
        ("n", "North Face Korea", "raw", "u", _north_face([_sku(543, 5)], ALLOWED)),
    ]
    docs = spark.createDataFrame(pages, DOCUMENTS)
    read = lambda spare: {r["id"]: r["color_name"] for r in extract_fields(docs, ["color_name"], with_spare=spare).collect()}
    assert read(False) == {"a": "", "n": ""}
    assert read(True) == {"a": "Teal", "n": "LIGHT KHAKI"}


def test_capabilities(spark):
    rows = {r["site"]: (r["json"], r["rendered"], r["size_type_known"]) for r in capabilities(spark).collect()}
    assert rows["Lacoste"] == (True, False, False) and rows["Adidas"] == (False, True, False)
    assert rows["Zappos"] == (False, False, True) and rows["Abc Grand Stage"] == (False, True, False)
    assert len(rows) == 8


def test_pruned_pages_give_the_same_products(spark, monkeypatch):
    from listloom.plans import products
    from listloom.queries.shop_pages import catalogue, shop_documents
    from listloom.sources.pages import parse_pages

    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    docs = shop_documents(catalogue(spark, sf_dir))
    pruned = {str(r) for r in extract_fields(docs).collect()}
    monkeypatch.setattr(products, "parse_pages", lambda pages, wanted: parse_pages(pages))
    assert {str(r) for r in extract_fields(docs).collect()} == pruned
