"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is ``window`` consecutive words of an item (a shorter item is one window),
seen as the ordered set of its shingles of up to three words.  Since a document must
hold every shingle of a window, one prefix token per window suffices: its rarest
shingle, by how often the documents hold it.  The steps:

1. One scan of the documents keeps the places of shingles that items have: first by
   hash, then by their words.  Hashes and shingles of the items are copied to the
   executors if their bytes allow; else every shingle is joined by shuffle.
2. Counting those places gives the order by rarity; a window with a shingle that no
   document holds goes at once.
3. Places of a window's prefix token give a start by its offset.  Starts before the
   document's first word or too near its end go (position and length bounds).
4. The other shingles are looked up at their exact places; a window occurs where all
   are there, which is exact containment of its words in order.

Every step groups or joins by (row, place) or by shingle with partial counts, never
by document source or item, so shared passages spread over the tasks.

Missing or empty texts have no words; an item without words has no window; items
with a missing id mark words but are not listed; repeated rows and equal ids are kept
apart by row; empty tables give no hits or no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listloom.llm.tables import fits_broadcast, numbered, stored

SHINGLE = 3
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Place of the entry that every document has before its shingles.
NO_PLACE = -1


def raw_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), SEPARATORS), lambda w: w != "")


def lower_ascii(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def _hashes(words: Column) -> Column:
    """Hashes of words; letters that differ in case only may share one."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _shingles(hashes: Column, k: int) -> Column:
    """Hashes of the k words from each place on; null or too few words give none."""
    n = F.greatest(F.size(hashes) - (k - 1), F.lit(0))
    out = F.slice(hashes, 1, n)
    for i in range(1, k):
        out = F.zip_with(out, F.slice(hashes, i + 1, n), lambda a, b: F.xxhash64(a, b))
    return out


def _text(words: Column) -> Column:
    return F.array_join(words, " ")


def _places(hashes: Column, k: int, known: list[int] | None) -> Column:
    """(place, k) of the shingles whose hash is known; of all if none are given."""
    shingles = _shingles(hashes, k)
    here = F.transform(shingles, lambda h, i: i if known is None else F.when(h.isin(known), i))
    return F.transform(F.filter(here, lambda i: i.isNotNull()), lambda i: F.struct(i.alias("at"), F.lit(k).alias("k")))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(window_id, item, n, words) of every distinct window and item."""
    words = items.select(F.col(id_col).cast("string").alias("item"), F.transform(raw_words(F.col(text_col)), lower_ascii).alias("words"))
    words = words.where(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(window)))
    starts = words.select("item", "n", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))).alias("at"))
    cut = starts.select("item", "n", F.expr("slice(words, at + 1, n)").alias("words"))
    return cut.select(F.sha2(F.array_join("words", " "), 256).alias("window_id"), "item", "n", "words").distinct()


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    row_col: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of documents (row, id, n_words), hit spans (row, start, n, window_id), and windows' items.

    Rows get ids while they are read, once, unless ``row_col`` holds them.
    """
    listed = stored(item_windows(items, item_id_col, item_text_col, window), "windows")
    kinds = listed.groupBy("window_id").agg(F.first("n").alias("n"), F.first("words").alias("words"))
    size = F.least(F.col("n"), F.lit(SHINGLE))
    parts = kinds.select("window_id", "n", "words", size.alias("k"), F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("offset"))
    parts = parts.select("window_id", "n", "k", "offset", F.expr("slice(words, offset + 1, k)").alias("words"))
    parts = stored(parts.select("window_id", "n", "k", "offset", "words", _text(F.col("words")).alias("shingle")), "window-shingles")
    wanted = stored(parts.select("k", "shingle", "words").dropDuplicates(["shingle"]), "shingles")
    lengths = sorted(r[0] for r in wanted.select("k").distinct().collect())  # at most SHINGLE numbers
    small = fits_broadcast(wanted, "shingle")

    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(row.alias("row"), F.col(id_col).alias("id"), raw_words(F.col(text_col)).alias("raw"))
    rows = rows.withColumn("n_words", F.size("raw")).withColumn("hashes", _hashes(F.col("raw")))
    at = F.array().cast("array<struct<at:int,k:int>>")
    for k in lengths:
        hashed = F.element_at(_shingles(_hashes(F.col("words")), k), 1)
        known = [r[0] for r in wanted.where(F.col("k") == k).select(hashed).distinct().collect()] if small else None
        at = F.concat(at, _places(F.col("hashes"), k, known))
    rows = rows.select("row", "id", "n_words", "raw", at.alias("places"))
    seen = F.transform(
        "places", lambda p: F.struct(p["at"].alias("at"), _text(F.transform(F.slice(F.col("raw"), p["at"] + 1, p["k"]), lower_ascii)).alias("shingle"))
    )
    mark = F.array(F.struct(F.lit(NO_PLACE).alias("at"), F.lit("").alias("shingle")))
    each = rows.select("row", "id", "n_words", F.explode(F.concat(mark, seen)).alias("p")).select("row", "id", "n_words", "p.at", "p.shingle")
    known = wanted.select("shingle").union(docs.sparkSession.range(1).select(F.lit("")))
    found = stored(each.join(F.broadcast(known) if small else known, "shingle", "left_semi"), "places")

    places = found.where(F.col("at") != NO_PLACE).select("row", "n_words", "at", "shingle")
    counts = places.groupBy("shingle").agg(F.count("*").alias("places"))
    ranked = parts.join(counts, "shingle", "left").groupBy("window_id", "n").agg(
        F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "shingle", "offset")).alias("rarest"),
        F.count("*").alias("n_shingles"),
    )
    prefix = ranked.where(F.col("rarest.places") > 0).select("window_id", "n", "n_shingles", "rarest.shingle", "rarest.offset")
    start = F.col("at") - F.col("offset")
    candidates = places.join(prefix, "shingle").where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
    candidates = candidates.select("row", start.alias("start"), "n", "window_id", "n_shingles")
    expected = candidates.join(parts.select("window_id", "offset", "shingle"), "window_id")
    expected = expected.withColumn("at", F.col("start") + F.col("offset"))
    spans = (
        expected.join(places.select("row", "at", "shingle"), ["row", "at", "shingle"])
        .groupBy("row", "start", "n", "window_id", "n_shingles")
        .agg(F.count("*").alias("held"))
        .where(F.col("held") == F.col("n_shingles"))
        .select("row", "start", "n", "window_id")
    )
    return found.where(F.col("at") == NO_PLACE).select("row", "id", "n_words"), stored(spans, "spans"), listed


def leak_report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: words, hit words, items found in it, and whether it is contaminated."""
    rows, spans, listed = decontaminate(docs, items, id_col, text_col, **options)
    ends = F.col("start") + F.col("n")
    before = F.max(ends).over(Window.partitionBy("row").orderBy("start", ends).rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), ends - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    hits = spans.select("row", "start", "n").distinct().select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    # Windows recur within a document: meet their items once each.
    of_row = spans.select("row", "window_id").distinct().join(listed.where(F.col("item").isNotNull()).select("window_id", "item"), "window_id")
    found = of_row.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = rows.join(hits, "row", "left").join(found, "row", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        items_of.alias("items"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows that hold no window of any item, with all their columns."""
    texts = numbered(docs, "texts")
    kept = F.col("kept")
    rows = texts.select("row", kept[id_col].alias("id"), kept[text_col].alias("text"))
    _, spans, _ = decontaminate(rows, items, "id", "text", row_col="row", **options)
    return texts.join(spans.select("row").distinct(), "row", "left_anti").select("kept.*")
