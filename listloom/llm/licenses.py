"""Licence scan by a positional index of rare words, in DataFrame operations only.

Templates of licence notices are indexed by word and position, without function
words.  One scan of the documents keeps, for each, its licence words with their
places and the words that follow.  Their document frequencies give the inverse
document frequency.  Each place looks up the postings of its word; a template at
relative position ``place - position`` is a candidate, whatever else the document
holds.  Postings are intersected by that position, and a template counts where at
least two of its words (or all it has) agree, its weighted share of words is
``MIN_SHARE`` or more and its mandatory key phrase stands at its own place.

Besides, the fixed phrases of ``PHRASES`` are found wherever they stand; the method
adds labels and removes none.

Missing and empty texts have no words, no labels and score 0; equal rows and ids are
kept apart by row; an empty table gives an empty one; other columns are ignored.
Nothing is grouped but (row, template, position), so no key can grow hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listloom.llm.leaks import SEPARATORS, lower_ascii
from listloom.llm.tables import stored

# Phrase -> label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label -> (notice, key phrase that must stand in it).
TEMPLATES = {
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", "affero general public license"),
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    "cc-by-4.0": ("licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "cc by nc"),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", "gnu general public license"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose", "distribute this software"),
    "lgpl": ("licensed under the gnu lesser general public license", "lesser general public license"),
    "mit": ("released under the mit license", "mit license"),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free"),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "unencumbered software"),
}
# Words that are never indexed.
FUNCTION_WORDS = set("a and any are by for in into is of or the this to under with without".split())

MIN_SHARE, CONTEXT = 0.6, 5


def _postings() -> list[tuple[str, str, int, int, str | None]]:
    """(word, template, position, words of the template, key phrase if it begins at the word)."""
    out = []
    for label, (notice, key) in TEMPLATES.items():
        words, phrase = notice.split(), key.split()
        begins = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        for i, word in enumerate(words):
            if word not in FUNCTION_WORDS:
                out.append((word, label, i, len(words), key if i == begins else None))
    return out


def lower_words(text: Column) -> Column:
    """Words with A-Z lowered.

    Full lowering is faster and differs from it only beyond ASCII, but for two
    letters whose lower case is ASCII; texts with those take the slower way.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    odd = text.contains("\u212a") | text.contains("\u0130")
    return F.filter(F.split(F.when(odd, lower_ascii(text)).otherwise(F.lower(text)), SEPARATORS), lambda w: w != "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: words, places of the fixed phrases with labels, licence words with places."""
    index = sorted({p[0] for p in _postings()})
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), lower_words(F.col(text_col)).alias("w"))
    w = F.col("w")

    def label_at(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in PHRASES.items():
            stands = None
            for k, word in enumerate(phrase.split()):
                one = F.get(w, i + k) == word
                stands = one if stands is None else stands & one
            out = F.when(stands, F.lit(label)).otherwise(out)
        return out

    first_words = sorted({p.split()[0] for p in PHRASES})
    wanted = sorted({*index, *first_words})
    places = F.filter(F.transform(w, lambda x, i: F.when(x.isin(wanted), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("places", places)
    begins = F.filter(
        F.transform("places", lambda i: F.struct(i.alias("at"), label_at(i).alias("label"))), lambda p: p["label"].isNotNull()
    )
    # The word itself, its place, and what follows, with a blank at the end to compare whole words.
    words = F.transform(
        F.filter("places", lambda i: F.get(w, i).isin(index)),
        lambda i: F.struct(
            F.get(w, i).alias("word"), i.alias("at"), F.concat(F.array_join(F.slice(w, i + 1, CONTEXT), " "), F.lit(" ")).alias("follows")
        ),
    )
    return rows.select("row", "id", F.size(w).alias("n_words"), begins.alias("begins"), words.alias("words"))


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Phrases, labels and score of every document."""
    spark = docs.sparkSession
    seen = stored(scan(docs, id_col, text_col), "licences")
    with_words = seen.where(F.size("words") > 0)
    total = seen.agg(F.count("*").alias("total"))
    in_docs = with_words.select(F.explode(F.array_distinct(F.col("words.word"))).alias("word")).groupBy("word").agg(F.count("*").alias("docs"))
    # One row for each posting: the templates bound its size.
    index = spark.createDataFrame(_postings(), "word string, template string, position int, size int, key string")
    weights = index.join(in_docs, "word", "left").crossJoin(total).withColumn(
        "idf", F.log((F.col("total") + 1.0) / (F.coalesce("docs", F.lit(0)) + 1.0)) + 1.0
    )
    weights = stored(weights.select("word", "template", "position", "size", "key", "idf"), "licence-index")
    whole = weights.groupBy("template").agg(F.sum("idf").alias("whole"), F.count("*").alias("n_rare"))
    weights = F.broadcast(weights.join(F.broadcast(whole), "template"))

    places = with_words.select("row", F.explode("words").alias("p")).select("row", "p.word", "p.at", "p.follows")
    met = places.join(weights, "word").withColumn("shift", F.col("at") - F.col("position"))
    phrase = F.col("key").isNotNull() & F.expr("startswith(follows, concat(key, ' '))")
    aligned = met.groupBy("row", "template", "shift").agg(
        F.sum("idf").alias("share"), F.count("*").alias("agree"), F.max(phrase).alias("has_key"),
        F.first("whole").alias("whole"), F.first("n_rare").alias("n_rare"),
    )
    share = F.round(F.least(F.lit(1.0), F.col("share") / F.col("whole")), 6)
    good = aligned.where(
        F.col("has_key") & (F.col("agree") >= F.least(F.lit(2), F.col("n_rare"))) & (share >= MIN_SHARE)
    ).groupBy("row").agg(F.collect_set("template").alias("templates"), F.max(share).alias("score"))

    none = F.array().cast("array<string>")
    base = F.array_distinct(F.col("begins.label"))
    labels = F.array_distinct(F.concat(base, F.coalesce("templates", none)))
    joined = lambda a: F.array_join(F.sort_array(a), ",")
    return seen.join(good, "row", "left").select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.size("begins").cast("long").alias("n_base"),
        F.array_min("begins.at").cast("long").alias("first_word"),
        F.array_max("begins.at").cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(labels).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
