"""Streaming jobs: restarts, late files, repeated codes."""

from listloom.queries.listings import article_listings
from listloom.session import work_dir
from listloom.sources.dims import site_images
from listloom.streaming import listings as S

PAGE = '<html lang="en"><nav><a href="/x">x</a></nav><article><h1>Page {n}</h1></article></html>'


def _pages(spark, numbers):
    rows = [(n, f"https://x.test/{n}", PAGE.format(n=n)) for n in numbers]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)


def test_listings_follow_arriving_files(spark):
    folder, sink, offsets = (work_dir(spark, n) for n in ("in", "out", "offsets"))
    flow = lambda pages: article_listings(pages, site_images(spark))
    schema = _pages(spark, [0]).schema

    def run():
        S.stream_listings(S.page_stream(spark, folder, schema, 1), flow, sink, offsets)
        return sorted(r["page_id"] for r in spark.read.parquet(sink).collect())

    _pages(spark, [1, 2]).write.mode("append").parquet(folder)
    assert run() == [1, 2]
    _pages(spark, [3]).write.mode("append").parquet(folder)
    # A restarted job goes on and repeats nothing.
    assert run() == [1, 2, 3]
    assert run() == [1, 2, 3]
    table = {tuple(r) for r in article_listings(_pages(spark, [1, 2, 3]), site_images(spark)).collect()}
    assert {tuple(r) for r in spark.read.parquet(sink).collect()} == table


def test_codes_are_listed_once(spark):
    folder, sink, offsets = (work_dir(spark, n) for n in ("in", "out", "offsets"))
    schema = _pages(spark, [0]).schema

    def run():
        rows = S.page_stream(spark, folder, schema, 1).selectExpr("page_id % 5 AS code", "url")
        S.stream_skip_listed(rows, "code", "url", sink, offsets)
        return {r["code"]: r["url"] for r in spark.read.parquet(sink).collect()}, spark.read.parquet(sink).count()

    _pages(spark, [6, 1, 2]).write.mode("append").parquet(folder)
    first, count = run()
    assert first == {1: "https://x.test/1", 2: "https://x.test/2"} and count == 2
    _pages(spark, [11, 12, 13, 18]).write.mode("append").parquet(folder)
    second, count = run()
    assert second == first | {3: "https://x.test/13"} and count == 3
    # A new checkpoint on the old sink lists what is new and loses nothing.
    offsets = work_dir(spark, "renewed")
    _pages(spark, [14]).write.mode("append").parquet(folder)
    third, count = run()
    assert third == second | {4: "https://x.test/14"} and count == 4


def test_null_and_frequent_codes(spark):
    """Null is one code, whatever its rows; most rows share a code; large numbers stay as they are."""
    folder, sink, offsets = (work_dir(spark, n) for n in ("in", "out", "offsets"))
    schema = "code bigint, at bigint, note string"
    big = (1 << 60) + 1

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = S.page_stream(spark, folder, spark.createDataFrame([], schema).schema, 1)
        S.stream_skip_listed(stream, "code", "at", sink, offsets)
        return sorted((tuple(r) for r in spark.read.parquet(sink).select("code", "at", "note").collect()), key=str)

    first = run([(None, 5, "e"), (None, 3, "c"), (big, None, None), (big, 9, "z")] + [(7, 10_000 - i, "many") for i in range(5000)])
    assert first == sorted([(None, 3, "c"), (big, 9, "z"), (7, 5001, "many")], key=str)
    assert run([(None, 1, "a"), (7, 1, "a"), (big + 1, None, "n")]) == sorted([*first, (big + 1, None, "n")], key=str)


def test_batches_do_not_read_the_sink(spark, monkeypatch):
    """The sink is read once a run, for the initial state, however many batches follow."""
    folder, sink, offsets = (work_dir(spark, n) for n in ("in", "out", "offsets"))
    schema = _pages(spark, [0]).schema
    for n in range(4):
        _pages(spark, [n, n + 10]).write.mode("append").parquet(folder)
    reads, listed_before = [], S._listed_before
    monkeypatch.setattr(S, "_listed_before", lambda *a: reads.append(a) or listed_before(*a))
    rows = S.page_stream(spark, folder, schema, 1).selectExpr("page_id % 10 AS code", "url")
    S.stream_skip_listed(rows, "code", "url", sink, offsets)
    out = spark.read.parquet(sink)
    assert len(reads) == 1 and out.count() == 4 and out.select("batch_id").distinct().count() == 4


def test_listed_codes_are_state_of_spark_itself(spark):
    """Many codes over many Arrow batches and tasks: no Python call for each code, the first row of a code still wins."""
    folder, sink, offsets = (work_dir(spark, n) for n in ("in", "out", "offsets"))
    rows = spark.range(6000).selectExpr("id % 2000 AS code", "6000 - id AS at", "id AS note")
    rows.repartition(4).write.parquet(folder)
    stream = S.page_stream(spark, folder, rows.schema)
    S.stream_skip_listed(stream, "code", "at", sink, offsets)
    got = sorted((r["code"], r["at"], r["note"]) for r in spark.read.parquet(sink).collect())
    assert got == [(c, 2000 - c, 4000 + c) for c in range(2000)]
    operators = spark.read.format("state-metadata").load(offsets).select("operatorName").distinct().collect()
    assert [r["operatorName"] for r in operators] == ["dedupe"]
