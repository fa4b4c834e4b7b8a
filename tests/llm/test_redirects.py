import re
from collections import Counter
from urllib.parse import urljoin

from listloom.llm.queries import QUERIES
from listloom.llm.redirects import RULES, judge


def split(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fit = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0]), default=(None, None))


def form_of(url):
    host, path = split(url)
    return host and re.sub(r"^(www|m)\.", "", host) + re.sub(r"(/index)?(\.html?)?/*$", "", path)


def brute(rows, links=()):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(form_of(a))] = find(form_of(b))
    seen = {}
    for _, url in rows:
        if form_of(url):
            seen.setdefault(find(form_of(url)), set()).add(rule_of(*split(url))[1])
    out = Counter()
    for page_id, url in rows:
        rule, verdict = rule_of(*split(url))
        around = seen.get(find(form_of(url)), set()) if form_of(url) else set()
        verdict = verdict or ("block" if "block" in around and "allow" not in around else "allow")
        out[(page_id, *split(url), rule, verdict)] += 1
    return out


def test_query_equals_brute_force(spark):
    import pyarrow.parquet as pq

    rows = [(r["page_id"], r["url"]) for r in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()]
    assert Counter(tuple(r) for r in QUERIES["op4_redirect_components"](spark, "/root/testdata/sf0.001").collect()) == brute(rows)


def test_links_and_odd_rows(spark):
    link = '<html><link href="{}" rel="canonical"></html>'
    refresh = "<META content='0; url={}' http-equiv=refresh>"
    rows = [
        (1, "https://a.com/de/1", None), (2, "https://b.net/x", link.format("https://a.com/de/1")), (3, "http://c.net/y?q", refresh.format("http://www.b.net/x.html")),
        (4, "https://d.net/z", link.format("http://e.org/ok")), (5, "https://e.org/ok", ""), (6, "https://f.net/", link.format("https://d.net/z/")), (7, "https://g.net/", refresh.format("https://a.com/de/1")),
        (8, "HTTPS://WWW.Example.ORG/es/", None), (9, None, "x"), (10, "no url", "x"), (None, "https://x.org", None), (1, "https://a.com/de/1", None),
        (11, "https://h.net/p", refresh.format("https://d.net/z")), (12, "https://h.net/p", link.format("https://a.com/de/1")), (13, "://", None), (14, "a://b.com/fr/#x?y/z", None),
    ]
    links = [("https://b.net/x", "https://a.com/de/1"), ("http://c.net/y", "http://www.b.net/x.html"), ("https://d.net/z", "http://e.org/ok"), ("https://f.net/", "https://d.net/z/"),
             ("https://g.net/", "https://a.com/de/1"), ("https://h.net/p", "https://d.net/z"), ("https://h.net/p", "https://a.com/de/1")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    assert Counter(tuple(r) for r in judge(pages).collect()) == brute([r[:2] for r in rows], links)
    alone = [r for r in rows if r[0] not in (11, 12, 4, 5, 6)]
    got = {r["page_id"]: r["verdict"] for r in judge(spark.createDataFrame([(*r, "x") for r in alone], pages.schema)).collect()}
    assert got[2] == got[3] == got[7] == "block" and got[9] == got[10] == "allow"
    assert judge(pages.limit(0)).count() == 0


def test_relative_and_repeated_links(spark):
    """Links are resolved as a browser does, all tags count, other schemes and queries give no edge."""
    link, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    cases = [
        ("https://a.com/de/1", None, None, []),
        ("https://b.net/p/x", None, link, ["//a.com/de/1?q"]),
        ("https://b.net/q/y", None, refresh, ["../p/./x.html"]),
        ("https://b.net/q/z#f", None, refresh, ["/q/y"]),
        ("https://b.net/q/w", None, link, ["https://u.net/", "z"]),
        ("https://v.net", None, refresh, ["https://v2.net/", "k.html", "?q=1", "#f"]),
        ("https://v.net/k", None, link, ["https://u.net"]),
        ("https://f.net/k", "//b.net/q/", link, ["z"]),
        ("https://d.net/k", None, link, ["mailto:a.com/de/1", "javascript:go()"]),
        ("https://e.net/k", None, refresh, ["/go?url=https://a.com/de/1"]),
        ("https://e.net/go", None, None, []),
        ("https://k.com/de/9", None, None, []),
        ("https://l.net/9", None, link, ["https://k.com/de/9", "//e.org/ok"]),
        ("https://m.net/9", None, link, ["https://l.net/9"]),
        ("https://e.org/ok", None, None, []),
        ("no url", None, link, ["https://a.com/de/1", "z"]),
    ]
    rows, links = [], []
    for i, (url, base, tag, targets) in enumerate(cases):
        rows.append((i, url, (f'<base href="{base}">' if base else "") + "".join(tag.format(t) + " text\n" for t in targets)))
        to = [urljoin(urljoin(url, base or ""), t) for t in targets]
        links += [(url, t) for t in to if form_of(url) and form_of(t)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = judge(pages)
    assert Counter(tuple(r) for r in got.collect()) == brute([r[:2] for r in rows], links)
    assert {r["page_id"] for r in got.collect() if r["verdict"] == "block"} == {0, 1, 2, 3, 4, 5, 6, 7, 11}
