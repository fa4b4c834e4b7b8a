"""Golden values of the expression functions."""

import math
import random

import pytest

from listloom.functions import listing_html as H
from listloom.functions import sizes as S
from listloom.functions import text as X
from listloom.functions import urls as U
from listloom.functions.sql import each, fill, q, texts


@pytest.mark.parametrize("text", ["plain", "it's", 'a "b"', "back\\slash", "line\nbreak\tTab", "한글", "%_$1"])
def test_literals_survive_quoting(value, text):
    assert value(q(text)) == text


def test_fill_keeps_template_text(value):
    assert value(fill("<a x='{x}'>{y}</a>\n", x="'1'", y=q("it's"))) == "<a x='1'>it's</a>\n"


@pytest.mark.parametrize("text", ["  a b ", " x　", "\x1c\x1dy\x85", "", " \t\n "])
def test_strip_is_unicode_aware(value, text):
    assert value(X.strip(q(text))) == text.strip()


def test_strip_chars(value):
    assert value(X.strip_chars(q('{"a":1});\n'), ");\n")) == '{"a":1}'


@pytest.mark.parametrize("text", ["the NORTH face", "abc-mart", "levi's", "3m x2y", "ÉCLAIR été", ""])
def test_title_case(value, text):
    assert value(X.title_case(q(text))) == text.title()


@pytest.mark.parametrize(
    "text", ["7", " 7.5 ", "9D", "9f", "1_0", "+.5", "5.", "1e3", "nan", "-inf", "Infinity", "", "abc", "1__0", "0x1", "7 .5"]
)
def test_numbers_parse_as_python_floats(value, text):
    try:
        number = float(text)
    except ValueError:
        number = None
    assert value(X.parses_as_number(q(text))) is (number is not None)
    if number is not None and math.isfinite(number):
        assert value(X.to_number(q(text))) == number


def test_full_title_keeps_both_spaces(value):
    assert value(X.full_title("'반스'", "NULL", "'Old Skool'")) == "반스  Old Skool"


def test_golden_titles(value):
    got = value(X.full_title("'라코스테'", "'각도 JQ 123 1 CMA'", "'Angular JQ 123 1 CMA'"))
    assert got == "라코스테 각도 JQ 123 1 CMA Angular JQ 123 1 CMA"


def test_prices(value):
    assert value(X.without_currency("'$99.95'")) == "99.95"
    assert value(X.korean_price("'170,100 원'")) == "170100"


@pytest.mark.parametrize("length", [0, 1, 4999, 5000, 5001, 15000])
def test_chunks_cover_the_text(value, length):
    text = "".join(random.Random(length).choices("ab ", k=length))
    got = value(X.chunks(q(text)))
    assert "".join(got) == text
    assert all(len(c) == 5000 for c in got[:-1]) and len(got) == max(1, math.ceil(length / 5000))


# --- URLs -----------------------------------------------------------------------


def test_snapshot_key(value):
    import hashlib

    url = "https://www.fila.com/a/b?x=1#y"
    digest = hashlib.sha256(b"NorthFace_a/b?x=1#y").hexdigest()
    assert value(U.snapshot_key("'North Face'", q(url))) == f"res_NorthFace_{digest[:6]}.html"
    assert value(U.snapshot_key("'North Face'", q(url), "pickle", 12)) == f"res_NorthFace_{digest[:12]}.pickle"
    assert value(U.path_after_host("'https://x.test'")) == ""


def test_json_urls(value):
    good = "https://www.lacoste.com/us/men/CH0194-51.html?color=GBY"
    wanted = (
        "https://www.lacoste.com/on/demandware.store/Sites-FlagShip-Site/en_US/"
        "Product-PartialsData?pid=CH0194-51&color=GBY&full=true"
    )
    assert value(U.to_json_url(q(good))) == wanted
    assert value(U.to_json_url("'https://x.test/a.html'")) == "https://x.test/a.html"
    assert value(U.to_json_urls(texts([good]))) == [wanted]
    # One unusable URL keeps the whole list.
    assert value(U.to_json_urls(texts([good, "https://x.test/a"]))) == [good, "https://x.test/a"]


def test_image_links(value):
    assert value(U.large_image("'https://m.test/I/71e._AC_SR38,50_.jpg'")) == "https://m.test/I/71e._AC_SR800,1500_.jpg"
    assert value(U.large_image("'https://m.test/a.jpg'")) == "https://m.test/a.jpg"
    assert value(U.file_stem("'https://m.test/I/61RMh62td1L._AC_SR800,1500_.jpg'")) == "61RMh62td1L._AC_SR800,1500_"
    assert value(U.file_extension("'https://m.test/VN000CS0_BKA_HERO?wid=1.jpg'")) == ""
    assert value(U.color_url("'VN0A5KRF8EE'")) == "https://www.vans.com/en-us/vn0a5krf8ee"


# --- Sizes ----------------------------------------------------------------------


def test_size_tables():
    rows = S.size_rows()
    counts = {g: sum(r[0] == g for r in rows) for g in {r[0] for r in rows}}
    assert counts == {
        "mens": 23, "womens": 21, "kids": 25, "kids_with_k": 25, "kids_with_front_k": 25, "kids_complete": 35,
    }
    table = {(g, key): mm for g, key, _, mm in rows}
    assert table["mens", "3.5"] == 215 and table["mens", "15"] == 330
    assert table["womens", "5"] == 220 and table["womens", "16"] == 330
    assert table["kids", "13.5"] == 195 and table["kids", "1"] == 200
    assert table["kids_with_k", "7.5K"] == 135 and table["kids_with_front_k", "K10"] == 160
    assert table["kids_complete", "1.0K"] == 70 and table["kids_complete", "7.0"] == 260


def test_golden_sizes_and_labels(value):
    sizes = ["7", "7.5", "8", "8.5", "9", "9.5", "10", "10.5", "11", "11.5", "12", "13"]
    mm = S.convert_sizes(texts(sizes), "mens")
    assert ",".join(value(mm)) == "250,255,260,265,270,275,280,285,290,295,300,310"
    assert ",".join(map(str, value(S.quantity_labels(mm)))) == "11,22,33,44,55,66,77,88,99,10,11,12"
    assert value(S.quantity_labels(texts([]))) == []


def test_one_bad_size_keeps_the_list(value):
    assert value(S.convert_sizes(texts(["7", "9D"]), "mens")) == ["7", "9D"]
    assert value(S.convert_sizes(texts(["7", "99", "nan"]), "mens")) == ["250"]
    assert value(S.convert_sizes(texts(["K10", "9D", "1.5"]), "kids_with_front_k")) == ["160", "205"]


@pytest.mark.parametrize(
    "text, audience",
    [("Women's Sizes", "women"), ("Men's", "men"), ("Woman", "women"), ("Unisex", "unisex"), ("Big Kid", "kids"),
     ("Toddler", "kids"), ("Shoes", ""), ("unisex men", "men")],
)
def test_audience(value, text, audience):
    assert value(S.audience_of(q(text))) == audience


def test_size_types(value):
    for audience, number in (("women", 2), ("men", 1), ("unisex", 1), ("kids", 3), ("", 1)):
        assert value(S.resolve_size_type("5", q(audience))) == number
    assert value(S.resolve_size_type("4", "'women'")) == 4


def test_size_texts(value):
    assert value(S.first_of_pair("'M 6.5 / W 7.5'")) == "6.5"
    assert value(S.first_of_pair("'13.5K'")) == "13.5K"
    assert value(S.bracketed_size("'085(WS)'")) == "여성S"
    assert value(S.bracketed_size("'230'")) == "230"
    assert value(S.without(texts(["1", "2", "2", "3"]), texts(["3"]))) == ["1", "2", "2"]


# --- Listing body ---------------------------------------------------------------


def test_listing_body_whitespace(value):
    none = texts([])
    body = value(H.listing_html("'반스'", texts(["i"]), texts(["t"]), texts(["b"]), none, texts(["u"]), none, none))
    assert body == (
        '<center style="width: 90%; margin: 0 auto;">\n\t'
        '<img src="u" width="400" style="max-width: 100%; height: auto;">\n\t\n\t'
        '<img src="i" alt="반스" style="max-width: 100%; height: auto; margin-top: 3mm;">\n\n\t<br/>\n\t'
        '<div style="display: block;">\n\t\t\n\t</div>\n\t<br/>\n\t'
        "<p style=\"font-size: 26px; font-family: 'Noto Sans'; line-height: 150%;\"><b>t</b></p>\n\n\t<br/>\n\t"
        "<p style=\"font-size: 22px; font-family: 'Noto Sans'; line-height: 120%;\"><b>b</b></p>\n\t\n\t"
        "\n\t\n\t</center>\n\t"
    )


def test_each_uses_distinct_names(value):
    nested = each("array(1, 2)", lambda x: each("array(10, 20)", lambda y: f"{x} + {y}"))
    assert value(nested) == [[11, 21], [12, 22]]
