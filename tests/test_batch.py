"""The batch as a whole."""

import random

import pytest

from listloom.operators.rules import Rule
from listloom.plans.batch import Sources, run_batch, run_batches
from listloom.schemas import LISTING_COLUMNS
from listloom.session import work_dir
from listloom.sources.dims import site_images
from listloom.sources.sheets import Sheet, insert_rows, inserted, write_sheet

RULES = [Rule("mini", "product_name", "h1"), Rule("mini", "color_urls", "a", "all", "need", "href")]


@pytest.fixture()
def tables(spark):
    pages = spark.createDataFrame(
        [("http://1", '<h1>one</h1><a href="http://2"></a><a href="http://9"></a>'), ("http://2", '<h1>two</h1><a href="http://1"></a>')],
        "url string, body string",
    )
    able = spark.createDataFrame([("mini", False, False)], "site string, json boolean, rendered boolean")
    none = spark.createDataFrame([], "url string, body string")
    cells = ["concat('old', id) AS C" if c == "C" else f"'' AS {c}" for c in LISTING_COLUMNS]
    sheet = spark.range(1, 5).selectExpr("id AS row_no", *cells)
    urls = spark.createDataFrame(
        [(1, "mini", "http://1"), (2, "mini", ""), (3, "mini", "http://2"), (4, "mini", "http://1")],
        "pos bigint, site string, url string",
    )
    return urls, sheet, Sources(able, none, none, pages, site_images(spark))


def _titles(batch):
    return [(r["row_no"], r["C"].removeprefix("mini ").split(" ")[0], r["S"]) for r in batch.sheet.orderBy("row_no").collect()]


def test_variants_follow_their_page(tables):
    urls, sheet, sources = tables
    batch = run_batch(urls, sheet, sources, 1, 3, 3, rules=RULES, sites=())
    assert _titles(batch) == [
        (1, "old1", ""), (2, "old2", ""), (3, "one", "http://1"), (4, "two", "http://2"), (5, "", "http://9"),
        (6, "two", "http://2"), (7, "one", "http://1"), (8, "old3", ""), (9, "old4", ""),
    ]
    assert (batch.next_start, batch.next_target_row) == (4, 8)
    following = run_batch(urls, batch.sheet, sources, batch.next_start, 3, batch.next_target_row, rules=RULES, sites=())
    assert [t[1] for t in _titles(following)][7:10] == ["one", "two", ""]


def test_without_variants_and_with_gaps(tables):
    urls, sheet, sources = tables
    batch = run_batch(urls, sheet, sources, 1, 3, 10, rules=RULES, sites=(), expand_colors=False, gap_mode="reference")
    assert _titles(batch)[4:] == [(10, "one", "http://1"), (11, "two", "http://2")]
    assert batch.next_target_row == 13


@pytest.mark.parametrize("gap_mode", ["dense", "reference"])
def test_batches_fill_a_sheet(spark, tables, gap_mode):
    """Batch after batch equals the table form; a second call goes on, a third has nothing to do."""
    urls, rows, sources = tables
    options = {"rules": RULES, "sites": (), "gap_mode": gap_mode}
    sheet = Sheet.create(rows, work_dir(spark, "sheet"))
    assert run_batches(urls, sheet, sources, 1, 2, 3, batches=1, **options) == 1
    again = Sheet(spark, sheet._path, rows.drop("row_no").schema)
    assert run_batches(urls, again, sources, 1, 2, 3, **options) == 1
    assert run_batches(urls, again, sources, 1, 2, 3, **options) == 0
    one = run_batch(urls, rows, sources, 1, 2, 3, **options)
    two = run_batch(urls, one.sheet, sources, one.next_start, 2, one.next_target_row, **options)
    listed = sorted(tuple(r) for r in again.rows().select(two.sheet.columns).collect())
    assert listed == sorted(tuple(r) for r in two.sheet.collect())
    path = work_dir(spark, "export")
    write_sheet(again.rows(), path, partitions=3)
    back = spark.read.parquet(path).selectExpr("row_no", "_metadata.file_path AS f", "_metadata.row_index AS i")
    assert [r["row_no"] for r in back.orderBy("f", "i").collect()] == [r[0] for r in listed]


def test_insertions_at_any_row(spark):
    """Offsets give the same as pushing rows down, however pieces are cut; blanks stay blank."""
    rng = random.Random(4)
    rows = [(i, f"old{i}") for i in range(1, 30) if i % 4]
    lines, cells = [("first", 1, 29, 1, {})], {("first", i): c for i, c in rows}
    table = dict(rows)
    for n in range(40):
        at, count = rng.randrange(1, 90), rng.randrange(0, 5)
        lines = inserted(lines, at, count, f"b{n}", {})
        cells |= {(f"b{n}", k): f"{n}.{k}" for k in range(1, count + 1)}
        table = {r + count if r >= at else r: c for r, c in table.items()} | {at + k - 1: f"{n}.{k}" for k in range(1, count + 1)}
    got = {row + k - low: cells[(b, k)] for b, low, high, row, _ in lines for k in range(low, high + 1) if (b, k) in cells}
    assert got == table and len(lines) <= 1 + 2 * 40


def test_attempts_that_failed_leave_nothing(spark):
    """A block that was written but not committed, or committed and tried again, stands once or not at all."""
    schema = "row_no bigint, cell string"
    old = spark.createDataFrame([(1, "a"), (2, "b"), (5, "c")], schema)
    sheet = Sheet.create(old, work_dir(spark, "sheet"))
    block = spark.createDataFrame([(2, "y"), (1, "x")], "rank bigint, cell string")
    sheet._write_block("batch", block.withColumn("cell", block["rank"].cast("string")))
    assert sheet.rows().count() == 3
    assert sheet.insert(block, 2, "batch") and not sheet.insert(block, 2, "batch")
    assert sorted(tuple(r) for r in sheet.rows().collect()) == [(1, "a"), (2, "x"), (3, "y"), (4, "b"), (7, "c")]
    assert sheet.insert(block.limit(0), 1, "empty") and sheet.rows().count() == 5
    pushed = insert_rows(old, block, 2)
    assert sorted(tuple(r) for r in pushed.collect()) == sorted(tuple(r) for r in sheet.rows().collect())
    blank = Sheet.create(old.limit(0), work_dir(spark, "sheet"))
    assert blank.rows().count() == 0 and blank.insert(block, 4, "b") and blank.rows().count() == 2


def test_a_work_list_of_one_split_is_read_by_all_cores(spark, tables, monkeypatch):
    from pyspark.sql import functions as F

    from listloom.plans import batch

    urls, sheet, sources = tables
    more = spark.range(1, 401).selectExpr("id AS pos", "'mini' AS site", "concat('http://', id % 9) AS url").coalesce(1)
    seen, make = [], batch.make_products

    def counting(documents, *args):
        seen.append(documents.select(F.spark_partition_id().alias("p")).distinct().count())
        return make(documents, *args)

    monkeypatch.setattr(batch, "make_products", counting)
    run_batch(more, sheet, sources, 1, 400, 3, rules=RULES, sites=())
    assert len(seen) == 2 and min(seen) >= 4
