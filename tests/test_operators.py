"""Relational operators against golden values and brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from listloom.operators import attempts, bloom, closure, fetchlog, filenames, glossary, joins, names, variants
from listloom.operators.names import with_site_host, with_site_name
from listloom.operators.ranking import in_ranges, with_rank, with_running_total
from listloom.session import enable_checkpoints, work_dir
from listloom.sources import dims, sheets, snapshots
from listloom.sources.pages import choose_document

NAMES = {
    "반스": "Vans", "zappos": "Zappos", "자포스": "Zappos", "노스페이스": "North Face", "노페": "", "northface korea": "North Face Korea",
    "north face": "", "Gap": "", "Guess": "", "gap factory": "", "gapfac": "Gap Factory", "UNDER ARMOUR": "", "the vans store": "Vans",
    "나이키": "Nike", "나": "", "": "", "7": "", "77": "", "asics running": "Asics", "밸리": "", "클락": "Clarks", "polo ralph lauren": "Ralph Lauren",
    "스클": "", "영원": "North Face Youngone", "n": "", "levis": "Levis", " ": "",
}


def brute_name(name, table=dict(dims.SITE_ALIASES)):  # noqa: B006, B008
    if name in table:
        return table[name]
    words = name.lower().split(" ")
    joined = "".join(words)
    hits = []
    for korean, official in table.items():
        if not joined.islower():
            if len(joined) >= 2 and set(joined) <= set(korean):
                hits.append(official)
        elif joined in official.lower().replace(" ", "") or set(words) & set(official.lower().split(" ")):
            hits.append(official)
    return hits[0] if len(hits) == 1 else ""


def test_site_names(spark):
    rng = random.Random(1)
    letters = "".join(k + o for k, o in dims.SITE_ALIASES) + "  "
    typed = list(NAMES) + ["".join(rng.choices(letters, k=rng.randint(0, 5))) for _ in range(300)]
    rows = with_site_name(spark.createDataFrame([(t,) for t in typed], "typed string"), "typed").collect()
    got = {r["typed"]: r["site_official"] for r in rows}
    assert got == {t: brute_name(t) for t in typed}
    for known in ("반스", "zappos", "자포스", "노스페이스", "Gap", "Guess", "north face"):
        assert got[known] == NAMES[known]


def test_site_hosts(spark):
    rows = with_site_host(spark.createDataFrame([("Vans",), ("Nike",), ("Other",)], "site string"), "site").collect()
    assert [(r["host"], r["host_or_name"]) for r in rows] == [
        ("https://www.vans.com", "https://www.vans.com"), ("", ""), (None, "Other"),
    ]
    wrong = {r["site_official"] for r in dims.suspicious_hosts(dims.site_host(spark)).collect()}
    assert wrong == {"Calvin Klein", "Nike"}


def test_site_names_of_a_given_table(spark):
    """The built-in aliases as a table give the same as the constant."""
    rng = random.Random(3)
    letters = "".join(k + o for k, o in dims.SITE_ALIASES) + "  "
    typed = list(NAMES) + ["".join(rng.choices(letters, k=rng.randint(0, 5))) for _ in range(200)] + ["반스"]
    df = spark.createDataFrame([(t,) for t in [*typed, None]], "typed string")
    rows = with_site_name(df, "typed", dims.site_alias(spark)).collect()
    assert len(rows) == len(typed) + 1
    assert {r["typed"]: r["site_official"] for r in rows} == {t: brute_name(t) for t in typed} | {None: ""}
    plain = with_site_name(df, "typed").collect()
    assert sorted(map(str, rows)) == sorted(map(str, plain))


def test_site_names_among_many_aliases(spark):
    """A hundred thousand aliases: no name meets all of them."""
    syllables = [chr(0xAC00 + 7 * i) for i in range(300)]
    aliases = [
        (syllables[i % 300] + syllables[i // 300 % 300] + syllables[(i * 31) % 300] + str(i), f"Shop {i} of Mall{i % 997}")
        for i in range(100_000)
    ]
    rng = random.Random(8)
    typed = [rng.choice(aliases)[0] for _ in range(5)] + ["".join(rng.sample(rng.choice(aliases)[0], 4)) for _ in range(10)]
    typed += [f"SHOP{rng.randrange(100_000)}of" for _ in range(5)] + [f"my {rng.randrange(10**5)} x" for _ in range(5)] + ["zz", "q1", ""]
    found = with_site_name(
        spark.createDataFrame([(t,) for t in typed], "typed string"),
        "typed",
        spark.createDataFrame(aliases, "ko_name string, site_official string"),
    )
    table = dict(aliases)
    assert {r["typed"]: r["site_official"] for r in found.collect()} == {t: brute_name(t, table) for t in typed}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_candidates_grow_with_names_and_aliases(spark, monkeypatch):
    """Codes of few digits: names share their characters and short pieces with very many aliases, yet few are looked at."""
    n = 2000
    aliases = [(f"상품{i}", f"{'red blue'.split()[i % 2]} ring {i}") for i in range(n)]
    typed = [f"{i}품{i % 7}" for i in range(0, n, 4)] + [f"BLUERING{i}" for i in range(1, n, 4)] + [f"blue x {i}" for i in range(0, n, 500)]
    sought, by_rarest = [], names._by_rarest

    def counting(*args):
        found = by_rarest(*args)
        sought.append(found.count())
        return found

    monkeypatch.setattr(names, "_by_rarest", counting)
    found = with_site_name(
        spark.createDataFrame([(t,) for t in typed], "typed string"),
        "typed",
        spark.createDataFrame([*aliases, *aliases[:3]], "ko_name string, site_official string"),
    ).collect()
    # Digits make 1023 sets at most, and pieces of six letters hold most of a code.
    assert len(sought) == 2 and max(sought) < 60 * n

    def hits(name):
        words, joined = name.lower().split(" "), name.lower().replace(" ", "")
        latin = joined.islower()
        return [
            official for korean, official in [*aliases, *aliases[:3]]
            if (joined in official.replace(" ", "") or set(words) & set(official.split(" ")) if latin else set(joined) <= set(korean))
        ]

    assert len(found) == len(typed)
    for row in found:
        expected = hits(row["typed"])
        assert (row["site_official"], row["match_count"]) == (expected[0] if len(expected) == 1 else "", len(expected))


def test_dimensions(spark):
    assert dims.site_alias(spark).count() == 44 and dims.site_host(spark).count() == 44
    assert dims.size_map(spark).count() == 154
    assert dims.site_images(spark).where("size(top) = 0").count() == 44


# --- Ranking ----------------------------------------------------------------------


def test_ranks_in_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 9)}", pos, rng.randint(0, 3)) for pos in range(3000)]
    df = spark.createDataFrame(rows, "k string, pos bigint, v int")
    got = with_running_total(df, ["k"], ["pos"], {"n": "1", "s": "v"}, 9).collect()
    seen, sums = defaultdict(int), defaultdict(int)
    expected = {}
    for k, pos, v in rows:
        expected[pos] = (seen[k], sums[k])
        seen[k] += 1
        sums[k] += v
    assert {r["pos"]: (r["n"], r["s"]) for r in got} == expected
    ranks = {r["pos"]: r["rank"] for r in with_rank(df, [], ["pos"], ranges=7).collect()}
    assert ranks == {pos: pos + 1 for pos in range(3000)}


def test_rows_without_a_key_are_ranked_too(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), (None, 3)], "k string, pos bigint")
    got = {r["pos"]: r["rank"] for r in with_rank(df, ["k"], ["pos"]).collect()}
    assert got == {1: 1, 2: 1, 3: 2}


@pytest.mark.parametrize("order", ["id * 1000000000", "if(id % 3 = 0, id, 7)", "0"])
def test_ranges_spread_sparse_and_crowded_orders(spark, order):
    """Positions far apart and one value that most or all rows share fill all ranges alike."""
    df = spark.range(8000).selectExpr(f"cast({order} AS bigint) AS pos", "id").repartition(5)
    sizes = [r["count"] for r in in_ranges(df, [], ["pos"], 8).groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2000
    rows = with_rank(df, [], ["pos"], ranges=8).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 8001))
    assert [r["pos"] for r in rows] == sorted(r["pos"] for r in rows)


# --- Work lists -------------------------------------------------------------------


def brute_batch(urls, colors, start_row):
    """Work through a list that grows while it is worked on."""
    todo, labels, frozen, appended, i = [(u, False) for u in urls], [], set(), 0, 0
    while i < len(todo):
        url, variant = todo[i]
        labels.append((url, variant, f"{i + 1}/{len(todo)} (S{start_row + i - appended})"))
        extra = [] if i in frozen else colors.get(url, [])
        if extra:
            todo[i + 1:i + 1] = [(u, True) for u in extra]
            frozen = set(range(i + 1, i + 1 + len(extra)))
            appended += len(extra)
        i += 1
    return labels


def test_listing_positions(spark):
    rng = random.Random(2)
    urls = [f"u{i}" for i in range(40)]
    colors = {u: [f"u{rng.randint(0, 39)}" for _ in range(rng.randint(0, 4))] for u in urls}
    df = spark.createDataFrame(
        [(i, u, colors[u]) for i, u in enumerate(urls)], "pos bigint, url string, color_urls array<string>"
    )
    rows = variants.listing_positions(df, 101, 11).orderBy("row_no").collect()
    assert [(r["url"], r["is_variant"], r["progress"]) for r in rows] == brute_batch(urls, colors, 11)
    assert [r["row_no"] for r in rows] == list(range(101, 101 + len(rows)))
    counts = variants.batch_counts(df).first()
    assert counts["rows"] == len(rows) and counts["pages"] == 40


def test_url_batch(spark):
    cells = [(1, "https://a"), (2, ""), (3, None), (4, "see http here"), (5, "ftp://x"), (6, "https://b")]
    got = variants.read_url_batch(spark.createDataFrame(cells, "pos bigint, url string"), 2, 4).collect()
    assert [r["pos"] for r in got] == [4]
    numbered = variants.with_batch(spark.createDataFrame(cells, "pos bigint, url string"), 2, 2).collect()
    assert [(r["pos"], r["batch"], r["start_row"]) for r in numbered] == [(4, 1, 4), (6, 2, 6)]
    assert variants.next_start(11, 40) == 51
    assert variants.next_target_row(100, 30, 40, 5) == 130
    assert variants.next_target_row(100, 30, 40, 5, "reference") == 145
    with pytest.raises(ValueError):
        variants.next_target_row(1, 1, 1, 1, "other")


def brute_closure(seeds, links):
    hops, frontier, step = {s: 0 for s in seeds}, set(seeds), 0
    while frontier:
        step += 1
        frontier = {b for a, b in links if a in frontier} - hops.keys()
        hops |= dict.fromkeys(frontier, step)
    return hops


def run_closure(spark, seeds, links):
    rows = closure.variants_closure(
        spark.createDataFrame([(s,) for s in seeds], "code int"), spark.createDataFrame(links, "code int, linked int")
    ).collect()
    got = {r["code"]: r["hops"] for r in rows}
    assert len(got) == len(rows)
    return got


def test_closure_with_cycles_and_far_links(spark):
    links = [(i, i + 1) for i in range(20)] + [(20, 0), (3, 15), (100, 101), (101, 100), (50, 50), (60, 61), (61, 62), (62, 60)]
    seeds = [0, 100, 7, 0]
    assert run_closure(spark, [*seeds, None], [*links, (None, 1), (1, None)]) == brute_closure(seeds, links)
    assert run_closure(spark, [5], []) == {5: 0} and run_closure(spark, [], links) == {}


def test_closure_of_random_links(spark):
    """Sparse links: many chains, some met half-way by nearer paths, circles and dead ends."""
    rng = random.Random(6)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(130)]
    seeds = rng.sample(range(120), 6)
    assert run_closure(spark, seeds, links) == brute_closure(seeds, links)


def test_closure_of_a_long_chain(spark, monkeypatch):
    """A thousand links in a row take a few rounds, and rounds read only the parts they touch."""
    rounds, parts, nearer, of = [], [], closure._nearer, closure.Parted.of
    monkeypatch.setattr(closure, "_nearer", lambda *a: rounds.append(1) or nearer(*a))

    def watched(self, rows, code):
        found = of(self, rows, code)
        parts.append(found.select(F.input_file_name()).distinct().count())
        return found

    monkeypatch.setattr(closure.Parted, "of", watched)
    links = [(i, i + 1) for i in range(1000)] + [(500, 2000), (2000, 2001)]
    assert run_closure(spark, [0], links) == brute_closure([0], links)
    assert len(rounds) <= 4 and max(parts) <= 3


def test_not_listed(spark):
    products = spark.createDataFrame([(1,), (2,), (3,)], "code int")
    listed = spark.createDataFrame([(2,), (2,), (9,)], "code int")
    assert sorted(r[0] for r in variants.not_listed(products, listed).collect()) == [1, 3]


def test_insert_rows(spark):
    sheet = spark.createDataFrame([(i, f"old{i}") for i in range(1, 6)], "row_no bigint, cell string")
    block = spark.createDataFrame([(2, "b"), (1, "a")], "rank bigint, cell string")
    got = sheets.insert_rows(sheet, block, 3)
    assert [tuple(r) for r in got.orderBy("row_no").collect()] == [
        (1, "old1"), (2, "old2"), (3, "a"), (4, "b"), (5, "old3"), (6, "old4"), (7, "old5"),
    ]
    for file_format in ("parquet", "csv"):
        path = work_dir(spark, "sheet")
        sheets.write_sheet(got, path, file_format, partitions=2)
        reader = spark.read.option("header", True).option("escape", '"').format(file_format)
        back = reader.load(path).select(F.col("row_no").cast("int"), "cell", F.input_file_name().alias("f")).collect()
        assert sorted((r["row_no"], r["cell"]) for r in back) == sorted(tuple(r) for r in got.collect())
        by_file = defaultdict(list)
        for r in back:
            by_file[r["f"]].append(r["row_no"])
        ranges = sorted((min(v), max(v)) for v in by_file.values())
        assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


# --- File names -------------------------------------------------------------------


def test_unique_file_names(spark):
    rng = random.Random(9)
    names = ["a.jpg", "b.tar.gz", "c"]
    images = [(d, i, f"https://x/{n}?w=1") for i, (d, n) in enumerate((rng.choice("pq"), rng.choice(names)) for _ in range(400))]
    taken = {(d, f"{s} ({rng.randint(1, 60)}){e}") for d in "pq" for s, e in (("a", ".jpg"), ("b.tar", ".gz"), ("z", ".jpg")) for _ in range(25)}
    taken |= {("p", "a.jpg"), ("p", "a (x).jpg")}
    got = filenames.unique_file_names(
        spark.createDataFrame(images, "dir string, pos bigint, url string"),
        spark.createDataFrame(sorted(taken), "dir string, file_name string"),
    ).collect()
    used = set(taken)
    for d, pos, url in images:
        name = url.split("/")[-1].split("?")[0]
        stem, dot, extension = name.rpartition(".")
        if not dot:
            expected = ""
        else:
            k = 1
            while (d, f"{stem} ({k}).{extension}") in used:
                k += 1
            expected = f"{stem} ({k}).{extension}"
            used.add((d, expected))
        assert [r["file_name"] for r in got if r["pos"] == pos] == [expected]


def test_file_numbers_over_many_chunks(spark, monkeypatch):
    """Lists of a few numbers each: dense and far numbers taken, files without a folder."""
    monkeypatch.setattr(filenames, "CHUNK", 4)
    rng = random.Random(5)
    numbers = {k for k in range(1, 200) if rng.random() < 0.6} | {10**12, 10**12 + 1}
    images = spark.range(300).selectExpr("cast(null AS string) AS dir", "id AS pos", "'https://x/a.jpg' AS url")
    existing = spark.createDataFrame([(None, f"a ({k}).jpg") for k in numbers] * 2, "dir string, file_name string")
    free = [k for k in range(1, 1000) if k not in numbers][:300]
    got = [r["file_name"] for r in filenames.unique_file_names(images, existing).orderBy("pos").collect()]
    assert got == [f"a ({k}).jpg" for k in free]


def test_sniffed_extension_and_golden_name(spark):
    images = spark.createDataFrame(
        [("t", 1, "https://m/61RMh62td1L._AC_SR800,1500_.jpg", None), ("t", 2, "https://m/HERO?wid=1", "jpeg")],
        "dir string, pos bigint, url string, sniffed_extension string",
    )
    existing = spark.createDataFrame(
        [("t", f"61RMh62td1L._AC_SR800,1500_ ({k}).jpg") for k in (1, 2)], "dir string, file_name string"
    )
    got = {r["pos"]: r["file_name"] for r in filenames.unique_file_names(images, existing).collect()}
    assert got == {1: "61RMh62td1L._AC_SR800,1500_ (3).jpg", 2: "HERO (1).jpeg"}


# --- Attempts, logs ---------------------------------------------------------------


def test_first_success(spark):
    tries = {"a": [503, 200], "b": [503, None, 404, 200], "c": [503] * 4 + [200], "d": [200, 200], "e": [None]}
    rows = [(k, i, s) for k, statuses in tries.items() for i, s in enumerate(statuses)]
    df = spark.createDataFrame(rows, "k string, at int, status int")
    out = attempts.first_success(df, "k", ["at"], "status BETWEEN 200 AND 299")
    got = {r["k"]: (r["tries"], r["success"], r["attempt"], r["direct"]) for r in out.collect()}
    assert got == {
        "a": (2, True, 2, False), "b": (4, True, 4, True), "c": (4, False, None, False), "d": (1, True, 1, False),
        "e": (1, False, None, False),
    }
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_request_line(spark):
    rows = [("x.execute-api.eu-west-3.amazonaws.com", 403, "Forbidden", "10.0.0.1", "boom"), (None, 200, "OK", None, "u"), ("a.b", 200, "OK", None, "u")]
    df = spark.createDataFrame(rows, "host string, status int, reason string, ip string, message string")
    lines = [r["line"] for r in fetchlog.with_request_line(df).collect()]
    assert lines[0] == "%-12s %-4s%-14s %-15s\n\t%s" % ("eu-west-3", 403, "Forbidden", "10.0.0.1", "boom")
    assert lines[1] == lines[2] == "%-12s %-4s%-14s %-15s\n\t%s" % ("", 200, "OK", "", "u")


@pytest.mark.parametrize("root", ["DEBUG", "INFO", "ERROR"])
def test_log_routes(spark, root):
    loggers = ["request.fail", "request.fail.Adidas", "request.failure", "Adidas"]
    rows = [(lg, lv) for lg in loggers for lv in fetchlog.LEVELS]
    df = spark.createDataFrame([(*r, "m") for r in rows], "logger string, level string, message string")
    df = df.withColumn("ts", F.lit("2024-01-02 03:04:05.678").cast("timestamp_ntz"))
    got = {(r["logger"], r["level"], r["sink"]) for r in fetchlog.log_routes(df, root).collect()}
    expected, floor = set(), fetchlog.LEVELS[root]
    for lg, lv in rows:
        n, family = fetchlog.LEVELS[lv], lg == "request.fail" or lg.startswith("request.fail.")
        if n < floor:
            continue
        if n < 30:
            expected.add((lg, lv, "console"))
        else:
            expected.add((lg, lv, "console_error"))
        if family and n >= 20:
            expected.add((lg, lv, "request_fail"))
        if not family and n >= 40:
            expected.add((lg, lv, "error"))
    assert got == expected


# --- Glossary ---------------------------------------------------------------------

ENTRIES = [("red", "빨강"), ("running shoe", "러닝화"), ("shoe", "신발"), ("", "빈")]


@pytest.mark.parametrize("limit", [joins.MAX_BROADCAST, 0])
def test_glossary(spark, limit):
    texts = ["red shoe", "running shoe", "running shoe red", "a  b", "", None, "red"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    terms = spark.createDataFrame(ENTRIES, "term string, translation string")
    got = {r["id"]: r["text"] for r in glossary.glossary_translate(df, terms, "text", "id", limit).collect()}
    table = dict(ENTRIES)
    for i, text in enumerate(texts):
        expected = None if text is None else table.get(text) or " ".join(table.get(w, w) for w in text.split(" "))
        assert got[i] == expected
    assert len(got) == len(texts)
    wide = glossary.glossary_translate(df.withColumn("more", F.col("id") * 2), terms, "text", "id", limit)
    assert {r["id"]: (r["text"], r["more"]) for r in wide.collect()} == {i: (got[i], 2 * i) for i in got}


def test_large_glossary(spark):
    """Thousands of terms, heavy and light words, terms of several words, missing keys and translations."""
    rng = random.Random(12)
    entries = [(f"w{i}", f"x{i}") for i in range(3000)] + [("a", "A"), ("w1 w2", "both"), ("q", None), (None, "z")]
    words = [t for t, _ in entries[:3000:7]] + ["a"] * 300 + ["b", "q", ""]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(200)] + ["w1 w2", None, "a"]
    rows = [(None if i == 5 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    terms = spark.createDataFrame(entries, "term string, translation string")
    table = {t: x for t, x in entries if t and x}
    expected = {i: None if t is None else table.get(t) or " ".join(table.get(w, w) for w in t.split(" ")) for i, t in rows}
    for limits in ({}, {"max_broadcast": 1000}, {"max_broadcast": 10, "heavy": 20}, {"max_broadcast": 0}):
        got = glossary.glossary_translate(df, terms, "text", "id", **limits)
        assert {r["id"]: r["text"] for r in got.collect()} == expected


def test_small_glossary_is_narrow(spark):
    terms = spark.createDataFrame(ENTRIES, "term string, translation string")
    df = spark.range(10).selectExpr("id", "cast(id AS string) AS text")
    plan = glossary.glossary_translate(df, terms, "text", "id")._jdf.queryExecution().optimizedPlan().toString()
    own = [line for line in plan.split("Project")[0].splitlines()]
    assert "Join" not in own and "Aggregate" not in "".join(own)


def test_constant_glossary(value):
    translate = glossary.constant_glossary(ENTRIES)
    assert value(translate("'running shoe'")) == "러닝화"
    assert value(translate("'running red shoe'")) == "running 빨강 신발"
    many = glossary.constant_glossary([(str(i), f"x{i}") for i in range(1000)])
    assert value(many("'7 999 none'")) == "x7 x999 none"


# --- Snapshots, documents -----------------------------------------------------------


def test_key_filter(spark):
    """All keys pass, few others do; nulls and several columns are keys like others."""
    keys = spark.range(0, 40_000, 2).selectExpr("cast(id AS string) AS k", "id % 7 AS n").union(
        spark.createDataFrame([(None, 1)], "k string, n bigint")
    )
    asked = spark.range(40_000).selectExpr("cast(id AS string) AS k", "id % 7 AS n", "id").union(
        spark.createDataFrame([(None, 1, -1), (None, 2, -2)], "k string, n bigint, id bigint")
    )
    found = {r["id"] for r in bloom.KeyFilter(keys, "k", "n").passing(asked).collect()}
    assert {-1, *range(0, 40_000, 2)} <= found and len(found) < 20_500
    assert bloom.KeyFilter(keys.limit(0), "k", "n").passing(asked).count() == 0


def test_documents_beyond_broadcast(spark):
    """With very many asked pages, others are left out before their bodies are shuffled."""
    pages = spark.range(20_000).selectExpr("concat('u', id) AS url", "concat('body ', id) AS body")
    urls = spark.range(0, 20_000, 50).selectExpr("id AS pos", "'s' AS site", "concat('u', id) AS url")
    able = spark.createDataFrame([("s", False, False)], "site string, json boolean, rendered boolean")
    none = pages.limit(0)
    got = choose_document(urls, able, none, none, pages, max_broadcast=0)
    assert {(r["pos"], r["body"]) for r in got.collect()} == {(i, f"body {i}") for i in range(0, 20_000, 50)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "forall" in plan and "LeftSemi" in plan


def test_snapshots(spark):
    pages = spark.createDataFrame(
        [("Vans", f"https://v.test/{i % 4}", f"{i}" * 200) for i in range(8)], "site string, url string, html string"
    )
    keyed = snapshots.with_snapshot_key(pages, n_hex=32)
    path = work_dir(spark, "snap")
    snapshots.write_snapshots(keyed, path)
    assert spark.read.parquet(path).count() == 4
    snapshots.write_snapshots(keyed, path, spark.read.parquet(path))
    saved = spark.read.parquet(path)
    assert saved.count() == 4 and saved.select("site").distinct().first()["site"] == "Vans"
    assert snapshots.cache_misses(keyed.select("key").distinct(), saved).count() == 0
    assert saved.where("chars <> length(html)").count() == 0
    short = saved.drop("chars").withColumn("html", F.when(F.col("url").endswith("1"), "x").otherwise(F.col("html")))
    wanted = keyed.select("key", "url").distinct()
    assert [r["url"] for r in snapshots.cache_misses(wanted, short).collect()] == ["https://v.test/1"]
    assert snapshots.snapshot_lookup(wanted, short).count() == 3


def test_choose_document(spark):
    urls = spark.createDataFrame([("J", "u1"), ("R", "u1"), ("H", "u1"), ("J", "u2")], "site string, url string")
    able = spark.createDataFrame([("J", True, True), ("R", False, True)], "site string, json boolean, rendered boolean")
    table = lambda tag: spark.createDataFrame([("u1", tag)], "url string, body string")
    got = choose_document(urls, able, table("json"), table("rendered"), table("raw")).collect()
    assert {(r["site"], r["url"], r["kind"], r["body"]) for r in got} == {
        ("J", "u1", "json", "json"), ("R", "u1", "rendered", "rendered"), ("H", "u1", "raw", "raw"), ("J", "u2", "json", None),
    }


def test_whole_digest_is_the_store_key(spark):
    pages = spark.range(20_000).selectExpr("'S' AS site", "concat('https://s.test/', id) AS url", "repeat('x', 100) AS html")
    path = work_dir(spark, "snap")
    snapshots.write_snapshots(snapshots.with_snapshot_key(pages), path)
    saved = spark.read.parquet(path)
    assert saved.count() == 20_000
    # Some of these share a name of six digits.
    names = snapshots.with_snapshot_key(saved.drop("key"), n_hex=6).select("key")
    assert names.distinct().count() < 20_000


def test_repeated_and_endpoint_documents(spark):
    product = "https://www.lacoste.com/us/men/CH0194-51.html?color=GBY"
    endpoint = (
        "https://www.lacoste.com/on/demandware.store/Sites-FlagShip-Site/en_US/"
        "Product-PartialsData?pid=CH0194-51&color=GBY&full=true"
    )
    urls = spark.createDataFrame([(1, "Lacoste", product), (2, "H", "u"), (3, "H", "u")], "id long, site string, url string")
    able = spark.createDataFrame([("Lacoste", True, False)], "site string, json boolean, rendered boolean")
    store = lambda *rows: spark.createDataFrame(rows, "url string, body string")
    got = choose_document(urls, able, store((endpoint, "{}")), store(("u", "r")), store(("u", "a"), ("u", "long"), ("u", "lang")))
    assert sorted((r["id"], r["body"]) for r in got.collect()) == [(1, "{}"), (2, "long"), (3, "long")]


def test_small_side(spark):
    df = spark.range(20)
    assert joins.fits(df, 20) and not joins.fits(df, 19)
    # Few but wide rows are not copied.
    assert not joins.fits(df.selectExpr("repeat('x', 1000) AS wide"), 20, 10_000)


def test_checkpoint_folder_is_the_shared_one(spark):
    enable_checkpoints(spark)
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared in spark.sparkContext.getCheckpointDir()
    assert work_dir(spark, "x").startswith(shared) and work_dir(spark, "x") != work_dir(spark, "x")
