"""Page reader, selectors and reading, against small pages and brute force."""

import random
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listloom.operators.css import parse_selector
from listloom.operators.dom import Page, one, select_nodes
from listloom.operators.rules import Rule
from listloom.plans.products import extract_fields
from listloom.sources.pages import Wanted, _PageReader, _Tag, parse_pages

SOUP = """<!DOCTYPE html><html><head><meta charset=utf-8><title>T &amp; co</title>
<script>var t="</p><b>";</script></head><body>
<div id=main class="a b"><p>one<p>two <b>bold<br>x</p> tail</div>
<ul><li class="x">1</li><li>2<ul><li>2a</li></ul></li><li class="x y" data-k="v">3</li></ul>
<img src="/i.png"/><input disabled value='q"q'></p></div>
<!-- note --><div class="c"><!-- inside --> &copy;<style>p{}</style></div><span>end
</body></html>"""


@pytest.fixture(scope="module")
def read(spark):
    def run(html, make, pruned=True):
        page = Page()
        expressions = make(page)
        wanted = page.wanted() if pruned else Wanted()
        parsed = parse_pages(spark.createDataFrame([(html,)], "html string"), wanted=wanted)
        return list(parsed.selectExpr(*[f"{e} AS c{i}" for i, e in enumerate(expressions)]).first())

    return run


@pytest.mark.parametrize("pruned", [True, False])
def test_tag_soup(read, pruned):
    got = read(
        SOUP,
        lambda p: [
            one(p.first("title").text()),
            one(p.first("script").string()),
            p.all("#main p").text(),
            one(p.first("div.a.b").text()),
            p.all("ul > li").text(),
            p.first("ul").children("li").text(),
            p.all("li.x").attr("data-k"),
            p.all("li.x").need("data-k"),
            p.all("li:not(.x)").text(),
            p.all("li:first-of-type").text(),
            p.all("li:last-of-type").text(),
            p.all("[data-k], img").attr("src"),
            one(p.first("input").attr("disabled")),
            one(p.first("input").attr("value")),
            p.first("div.c").all_texts(),
            one(p.first("div.c").text()),
            p.first("ul").inside("ul li").text(),
            p.all("li").nth(-1).text(),
            p.all("li").nth(9).text(),
            p.all("nothing").text(),
        ],
        pruned,
    )
    assert got == [
        "T & co",
        'var t="</p><b>";',
        ["onetwo boldx tail", "two boldx"],
        "onetwo boldx tail",
        ["1", "22a", "2a", "3"],
        ["1", "22a", "3"],
        [None, "v"],
        None,
        ["22a", "2a"],
        ["1", "2a"],
        ["2a", "3"],
        [None, "/i.png"],
        "",
        'q"q',
        [[" inside ", " ©", "p{}"]],
        " ©",
        ["1", "22a", "2a", "3"],
        ["3"],
        [],
        [],
    ]


def test_string_needs_a_single_chain(read):
    html = "<p><b><i>deep</i></b></p><p>a<br></p><p></p><p>x</p><p><!--c--></p>"
    (got,) = read(html, lambda p: [p.all("p").string()])
    assert got == ["deep", None, None, "x", "c"]


def test_contains_sees_scripts(read):
    html = "<div><script>utag_data = 1</script></div><div>utag</div>"
    got = read(html, lambda p: [p.all('script:-soup-contains("utag_data")').count(), p.all('div:-soup-contains("utag")').count()])
    assert got == [1, 2]


def test_any_ancestor_counts_not_only_the_nearest(read):
    html = '<div class="a"><section><div class="b"><div class="a x"><p>1</p></div></div></section></div>'
    got = read(html, lambda p: [p.all("section > div p").text(), p.all("div.a > section div.a p").text(), p.all("div.x > section p").text()])
    assert got == [["1"], ["1"], []]


@pytest.mark.parametrize("selector", ["a:hover", "a +", "", "a ~ b", "p:nth-child(2)", "> a"])
def test_unsupported_selectors_are_refused(selector):
    with pytest.raises(ValueError):
        parse_selector(selector)


def test_broken_page_does_not_stop_the_job(spark):
    pages = spark.createDataFrame([(1, "<p>ok</p>"), (2, "<![if x]>"), (3, None), (4, "<![bad bad")], "id int, html string")
    got = {r["id"]: r for r in parse_pages(pages).selectExpr("id", "size(nodes) AS n", "parse_error").collect()}
    assert got[1]["n"] == 1 and got[3]["n"] == 0
    assert len(got) == 4


def test_broken_page_keeps_what_stands_before_the_fault(spark):
    """Elements up to the fault, with those still open ended there; the errors name the page."""
    html = '<html><h1 class="t">A title</h1><div><b>1.50</b><p>cut<![bad[x]]><h1 class="t">late</h1></div>'
    rules = [Rule("s", "product_name", "h1.t"), Rule("s", "price", "div > b"), Rule("s", "images", "img", "all", "need", "src")]
    docs = spark.createDataFrame([(1, "s", "raw", "u", html)], "id int, site string, kind string, url string, body string")
    row = extract_fields(docs, ("product_name", "price", "images"), rules, sites=()).first()
    assert (row["product_name"], row["price"], row["images"]) == ("A title", "1.50", [])
    assert "page" in row["errors"] and "product_name" not in row["errors"]
    parsed = parse_pages(docs.selectExpr("id", "body AS html")).selectExpr("parse_error", "transform(nodes, n -> n.tag) AS tags")
    assert "marked section" in parsed.first()["parse_error"] and parsed.first()["tags"] == ["html", "h1", "div", "b", "p"]


def test_long_form(spark):
    parsed = parse_pages(spark.createDataFrame([(7, "<ul><li id=a>1<li>2</ul>")], "id int, html string"))
    rows = select_nodes(parsed.withColumnRenamed("id", "page"), "li", "page").collect()
    assert [(r["page"], r["pos"], r["text"], r["id"]) for r in rows] == [(7, 0, "12", "a"), (7, 1, "2", None)]


class _Plain(HTMLParser):
    """Events of the tolerant reader alone."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("start", tag, [(k, v or "") for k, v in attrs]))

    def handle_startendtag(self, tag, attrs):
        self.events.append(("empty", tag, [(k, v or "") for k, v in attrs]))

    def handle_endtag(self, tag):
        self.events.append(("end", tag))

    def handle_data(self, data):
        if self.events and self.events[-1][0] == "text":
            self.events[-1] = ("text", self.events[-1][1] + data)
        else:
            self.events.append(("text", data))

    def handle_comment(self, data):
        self.events.append(("comment", data))


class _FastReader(_PageReader):
    def __init__(self):
        super().__init__(Wanted())
        self.events = []

    handle_startendtag = _Plain.handle_startendtag
    handle_endtag = _Plain.handle_endtag
    handle_data = _Plain.handle_data
    handle_comment = _Plain.handle_comment
    handle_pi = handle_decl = unknown_decl = lambda self, text: None

    def handle_starttag(self, tag, attrs):
        _Plain.handle_starttag(self, tag, attrs)

    def _learn(self, raw, begin, end):
        tag = super()._learn(raw, begin, end)
        if tag is not None and not tag.ends:
            tag.empty = raw[end - 2] == "/"
        return tag

    def _tag(self, *args, **kwargs):
        tag = super()._tag(*args, **kwargs)
        written = _Written()
        for name in _Tag.__slots__:
            if hasattr(tag, name):
                setattr(written, name, getattr(tag, name))
        return written

    def _open(self, tag):
        (self.handle_startendtag if tag.empty else self.handle_starttag)(tag.name, tag.attrs)


class _Written(_Tag):
    """A tag that remembers how it ended."""

    empty = False


PARTS = st.sampled_from(
    ["<a href=\"/x\">", "<A HREF='y' b>", "</a>", "<br/>", "<br>", "</ p>", "<p class=\"a b\" id=\"i\">", "<p a=\"1\"b=\"2\">",
     "<i a=b/>", "<i / x>", "text", " ", "&amp;", "&lt", "<", ">", "\"", "<script>", "</script>", "<style>p{}</style>", "<!-- c -->",
     "<!x>", "</>", "<x-y z:w=\"&quot;\">", "<p a=\"\">", "<p a = \"1\" >", "<p\na=\"1\"\n>", "</P >", "<?pi>", "é"]
)


@settings(max_examples=600, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_fast_path_yields_the_same_events(html):
    plain, fast = _Plain(), _FastReader()
    plain.feed(html)
    plain.close()
    fast.feed(html)
    fast.close()
    assert fast.events == plain.events


def _naive_select(rows, tag, cls):
    return [r for r in rows if r[3] == tag and cls in r[5]]


def test_descendant_selection_matches_brute_force(spark):
    rng = random.Random(3)
    pages = []
    for page in range(30):
        html = []
        for _ in range(60):
            if rng.random() < 0.55:
                html.append(f'<{rng.choice("abd")} class="{rng.choice("xyz")} {rng.choice("uvw")}">')
            else:
                html.append(f'</{rng.choice("abd")}>')
        pages.append((page, "".join(html)))
    page = Page()
    found = page.all("a.x > b d.u").read(lambda e: f"{e.node}.node_id")
    got = {
        r["page"]: r["found"]
        for r in parse_pages(spark.createDataFrame(pages, "page int, html string"), wanted=page.wanted())
        .selectExpr("page", f"{found} AS found").collect()
    }
    reader = _PageReader(Wanted())
    for number, html in pages:
        rows, *_ = reader.read(html)
        expected = []
        for row in _naive_select(rows, "d", "u"):
            above = [rows[i] for i in row[2]]
            if any(
                b[3] == "b" and b[1] >= 0 and rows[b[1]][3] == "a" and "x" in rows[b[1]][5] for b in above
            ):
                expected.append(row[0])
        assert got[number] == expected


# --- random selectors against a matcher of its own ----------------------------------


def _holds(compound, row):
    tag, ident, classes, attrs, negated, place = compound
    if tag and row[3] != tag or ident and row[4] != ident:
        return False
    if any(c not in row[5] for c in classes):
        return False
    for name, op, wanted in attrs:
        actual = " ".join(row[5]) or None if name == "class" else row[4] if name == "id" else row[6].get(name)
        if actual is None:
            return False
        if op == "=" and actual != wanted or op == "*=" and wanted not in actual:
            return False
        if op == "^=" and not actual.startswith(wanted) or op == "$=" and not actual.endswith(wanted):
            return False
    if negated and _holds(negated, row):
        return False
    return not place or row[7 if place == "first" else 8] == 1


def _matches(chain, row, rows):
    *outer, (combinator, compound) = chain
    if not _holds(compound, row):
        return False
    if not outer:
        return True
    above = [row[1]] if combinator == ">" else row[2]
    return any(i >= 0 and _matches(outer, rows[i], rows) for i in above)


def _random_compound(rng, nested=False):
    tag = rng.choice(["a", "b", "d", None, None])
    ident = rng.choice([None, None, None, "i1"])
    classes = rng.sample("xyz", rng.choice([0, 0, 1, 1, 2]))
    attrs = []
    if rng.random() < 0.4:
        attrs.append(rng.choice([("k", None, None), ("k", "=", "v1"), ("k", "*=", "v"), ("k", "^=", "w"), ("class", "*=", "x"), ("k", "$=", "2")]))
    negated = _random_compound(rng, True)[0] if not nested and rng.random() < 0.3 else None
    place = rng.choice([None, None, None, "first", "last"]) if not nested else None
    compound = (tag, ident, classes, attrs, negated, place)
    if not (tag or ident or classes or attrs or negated or place):
        return _random_compound(rng, nested)
    return compound, _text(compound)


def _text(compound):
    tag, ident, classes, attrs, negated, place = compound
    out = (tag or "") + (f"#{ident}" if ident else "") + "".join(f".{c}" for c in classes)
    out += "".join(f"[{n}]" if op is None else f'[{n}{op}"{v}"]' for n, op, v in attrs)
    out += f":not({_text(negated)})" if negated else ""
    return out + (f":{place}-of-type" if place else "")


def test_random_selectors(spark):
    rng = random.Random(11)
    selectors = []
    for _ in range(40):
        chain, text = [], ""
        for step in range(rng.choice([1, 1, 2, 3])):
            combinator = "" if step == 0 else rng.choice([" ", ">"])
            compound, written = _random_compound(rng)
            chain.append((combinator, compound))
            text += {"": "", " ": " ", ">": " > "}[combinator] + written
        selectors.append((chain, text))
    pages = []
    for number in range(40):
        html = []
        for _ in range(50):
            if rng.random() < 0.6:
                ident = ' id="i1"' if rng.random() < 0.15 else ""
                key = f' k="{rng.choice(["v1", "v2", "w2", ""])}"' if rng.random() < 0.4 else ""
                html.append(f'<{rng.choice("abd")} class="{" ".join(rng.sample("xyz", rng.randint(0, 3)))}"{ident}{key}>')
            else:
                html.append(f'</{rng.choice("abd")}>')
        pages.append((number, "".join(html)))
    page = Page()
    found = [page.all(text).read(lambda e: f"{e.node}.node_id") for _, text in selectors]
    parsed = parse_pages(spark.createDataFrame(pages, "page int, html string"), wanted=page.wanted())
    got = {r["page"]: r for r in parsed.selectExpr("page", *[f"{f} AS s{i}" for i, f in enumerate(found)]).collect()}
    reader, hits = _PageReader(Wanted()), 0
    for number, html in pages:
        rows, *_ = reader.read(html)
        for i, (chain, text) in enumerate(selectors):
            expected = [r[0] for r in rows if _matches(chain, r, rows)]
            assert got[number][f"s{i}"] == expected, text
            hits += len(expected)
    assert hits > 500


def test_reading_pages_pauses_the_collector_and_skips_unread_text():
    """Page lists hold no cycles, text no rule reads is not put together, quotes in attributes are one replacement."""
    import gc
    import random
    from html import unescape

    import pyarrow as pa

    from listloom.sources import pages

    run = pages._dom_stage("html", pages.Wanted(elements=frozenset([("b", None, ())]), texts=frozenset()), "site")
    out = run(iter([pa.record_batch([pa.array(["<p>x &amp; y<b>z</b></p>"])], ["html"])]))
    assert gc.isenabled()
    got = next(out).to_pylist()[0]
    assert not gc.isenabled() and [n["tag"] for n in got["nodes"]] == ["b"] and got["pieces"] == []
    assert list(out) == [] and gc.isenabled()
    rng = random.Random(4)
    parts = ["&quot;", "&quot", "&amp", "&amp;", "&", "#38", ";", "quot", "a", '"', "&#x22;", "&lt"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 8)))
        assert pages._unescaped(text) == unescape(text)
