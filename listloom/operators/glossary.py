"""Glossary translation: whole texts first, then word by word.

Stands in for a web service.  A text no entry knows stays as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listloom.functions.sql import each, q
from listloom.operators.joins import MAX_BROADCAST, fits
from listloom.session import work_dir

#: A word is heavy when it is in more than one of so many shares of all (text, word) pairs.
HEAVY = 10_000
#: Entries a bucket of a look-up table holds on average, and buckets of a text's own table.
PER_BUCKET, TEXT_BUCKETS = 4, 64


def constant_glossary(entries: Sequence[tuple[str, str]]):
    """A translator for product texts from a few (term, translation) pairs."""
    table = f"map({', '.join(f'{q(term)}, {q(target)}' for term, target in dict(entries).items())})"

    def translate(text: str) -> str:
        words = each(f"split({text}, ' ', -1)", lambda w: f"coalesce(try_element_at({table}, {w}), {w})")
        return f"coalesce(try_element_at({table}, {text}), array_join({words}, ' '))"

    return translate


def _bucket(word: str, buckets: str) -> str:
    return f"cast(pmod(xxhash64({word}), {buckets}) AS int)"


def _find(table: str, word: str) -> str:
    """Translation of a word, from an array of maps by hash: maps alone are searched entry by entry."""
    return f"try_element_at(get({table}, {_bucket(word, f'size({table})')}), {word})"


def _table(terms: DataFrame) -> Column:
    """All terms as one look-up table, a constant of every task; the caller has checked their size."""
    rows = terms.select("term", "translation", F.expr("xxhash64(term)").alias("hash")).collect()
    table: list[dict] = [{} for _ in range(1 + len(rows) // PER_BUCKET)]
    for row in rows:
        table[row["hash"] % len(table)][row["term"]] = row["translation"]
    return terms.sparkSession.createDataFrame([(table,)], "table array<map<string,string>>").scalar()


def _translated(column: str, *tables: str) -> str:
    """The text by any of the tables as a whole, else each of its words."""
    known = lambda w: ", ".join(_find(t, w) for t in tables)
    words = each(f"split({column}, ' ', -1)", lambda w: f"coalesce({known(w)}, {w})")
    return f"coalesce({known(column)}, array_join({words}, ' '))"


def _with_tables(df: DataFrame, column: str, *own: str, **shared: Column) -> DataFrame:
    """Translate by tables that rows carry and by tables for all rows."""
    translated = F.expr(_translated(column, *own, *shared))
    return df.withColumns(shared).withColumn(column, translated).select(*df.columns)


def glossary_translate(
    df: DataFrame, glossary: DataFrame, column: str, key: str, max_broadcast: int = MAX_BROADCAST, heavy: int = HEAVY
) -> DataFrame:
    """Replace ``column`` by its translation; ``key`` identifies a row.

    A ``glossary(term, translation)`` of checked size goes to every task as a hashed
    look-up table: the scan stays narrow.  A larger one is cut down to a dictionary:
    the distinct words of the texts, each joined once with the glossary, however often
    it occurs.  If the dictionary is still large, its measured heavy words (at most
    ``heavy``) are looked up narrowly and only the others, none of which is in many
    texts, travel to their texts; a text gets the table of its own words.
    """
    terms = glossary.where("term IS NOT NULL").groupBy("term").agg(F.min("translation").alias("translation"))
    if fits(glossary, max_broadcast):
        return _with_tables(df, column, _known=_table(terms))
    longest = terms.agg(F.max(F.length("term"))).first()[0] or 0
    # Whole text and words, as far as they can be a term; each once a text.
    pieces = F.expr(
        f"array_distinct(filter(array_append(split({column}, ' ', -1), {column}), w -> length(w) <= {longest}))"
    )
    seen = df.select(F.explode(pieces).alias("term")).groupBy("term").agg(F.count("*").alias("texts"))
    path = work_dir(df.sparkSession, "dictionary")
    seen.join(terms, "term").write.parquet(path)
    dictionary = df.sparkSession.read.parquet(path)
    words = dictionary.select("term", "translation")
    if fits(words, max_broadcast):
        return _with_tables(df, column, _known=_table(words))
    total = dictionary.agg(F.sum("texts")).first()[0] or 0
    is_heavy = F.col("texts") > total // heavy
    often = dictionary.where(is_heavy).select("term", "translation")
    if not fits(often, heavy):
        # Few but huge terms: joined like the others, split by adaptive execution.
        is_heavy = F.lit(False)
        often = often.limit(0)
    often = _table(often)
    rest = df.select(key, pieces.alias("_pieces")).withColumn("_often", often).select(
        key, F.explode(F.expr(f"filter(_pieces, w -> {_find('_often', 'w')} IS NULL)")).alias("term")
    )
    found = rest.join(dictionary.where(~is_heavy), "term").groupBy(F.col(key).alias("_key")).agg(
        F.collect_set(F.struct("term", "translation")).alias("_entries")
    )
    with_own = df.join(found, F.col(key).eqNullSafe(F.col("_key")), "left")
    buckets = f"least({TEXT_BUCKETS}, 1 + size(_entries) div {PER_BUCKET})"
    own = F.expr(
        f"transform(sequence(0, {buckets} - 1), "
        f"b -> map_from_entries(filter(_entries, e -> {_bucket('e.term', buckets)} = b)))"
    )
    return _with_tables(with_own.withColumn("_own", own), column, "_own", _often=often).select(*df.columns)
