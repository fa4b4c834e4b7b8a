"""Ranked lexical search, reversed: documents stream through an index of the items.

A search usually sends each query through an index of the documents.  Here the items
are few and the documents many, so it is turned round: the items' terms make an
inverted index that is broadcast, and each document's term counts pass through it and
add to the score of every item that holds one of its terms.  A task keeps the ``k``
best documents of each item and hands out no more than these; heaps are merged in two
steps, so no task sees the heaps of all tasks for an item.

Items are cut into blocks of at most about ``postings`` entries and ``items`` items,
so what is broadcast, collected and kept as heaps has a bound whatever the number of
items; a document is read once for each block.  An item longer than a block makes one
of its own.

Terms are runs of ASCII letters (A-Z lower-cased), digits and characters beyond
ASCII, known by 64-bit hashes.  Scores are whole numbers, see :func:`weights` and
:class:`Scorer`; equal scores rank by ascending id, missing ids last.  Ids of documents
are integers.

Missing and empty texts have no terms and are never found; items without terms find
nothing; repeated items are searched each for itself, repeated documents rank side by
side; empty tables give an empty result; very long texts are split into words at once,
in memory of some ten times their size; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listloom.llm.tables import numbered, stored
from listloom.llm.words import ALNUM, Words, slices, split_words, texts_of

#: Entries and items of a block.
POSTINGS, ITEMS = 1 << 20, 10_000
SLICE_BYTES = 4 << 20
#: Scores held at a time, and additions to them.
CELLS, ADDITIONS = 1 << 22, 1 << 22
#: Groups in which the heaps of an item are merged first.
SLOTS = 64
HEAPS = "item int, score long, doc long"


@dataclass
class Index:
    """Terms of a block's items in order of hash; term t stands in the entries ends[t] to ends[t + 1]."""

    rows: np.ndarray  #: row of each item
    terms: np.ndarray
    ends: np.ndarray
    item: np.ndarray
    times: np.ndarray


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in slices(batch.column(1), SLICE_BYTES):
            words = _terms(batch.column(1).slice(low, high - low))
            order = np.lexsort((words.hashes, words.text))
            text, terms = words.text[order], words.hashes[order]
            head = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (terms[1:] != terms[:-1])))[: len(text)])
            rows = batch.column(0).to_numpy()[low:high][text[head]]
            times = np.diff(np.append(head, len(text)))
            yield pa.record_batch([pa.array(rows), pa.array(terms[head].view(np.int64)), pa.array(times)], ["row", "term", "times"])


def _terms(column: pa.Array) -> Words:
    return split_words(texts_of(column), ALNUM, lower=True)


def _index(postings: DataFrame) -> Index:
    """The index of a block, whose size was bounded before."""
    table = postings.toArrow()
    rows, item = np.unique(table["row"].to_numpy(), return_inverse=True)
    terms = table["term"].to_numpy().view(np.uint64)
    order = np.lexsort((item, terms))
    known, starts = np.unique(terms[order], return_index=True)
    return Index(rows, known, np.append(starts, len(terms)), item[order], table["times"].to_numpy()[order])


def _look_up(index: Index, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and count of the indexed terms in each text."""
    at = np.minimum(np.searchsorted(index.terms, words.hashes), len(index.terms) - 1)
    hit = np.flatnonzero(index.terms[at] == words.hashes)
    keys = np.sort(words.text[hit] * len(index.terms) + at[hit])
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
    return keys[head] // len(index.terms), keys[head] % len(index.terms), np.diff(np.append(head, len(keys)))


def _frequencies(shared: Broadcast):
    """Of the documents: how many have terms, how many terms, and how many hold each indexed one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        # After the terms: documents with terms, and all terms.
        counts = np.zeros(len(index.terms) + 2, np.int64)
        for batch in batches:
            for low, high in slices(batch.column(0), SLICE_BYTES):
                words = _terms(batch.column(0).slice(low, high - low))
                counts[: len(index.terms)] += np.bincount(_look_up(index, words)[1], minlength=len(index.terms))
                counts[-2] += np.count_nonzero(words.counts)
                counts[-1] += len(words)
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(seen), pa.array(counts[seen])], ["term", "n"])

    return run


def weights(documents: int, frequencies: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    values = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequencies]
    return np.array(values, np.int64)


def exact_sums(cells: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by cell; doubles add the upper and lower halves without rounding."""
    low = np.bincount(cells, values & ((1 << 26) - 1), n).astype(np.int64)
    return low + (np.bincount(cells, values >> 26, n).astype(np.int64) << 26)


class Scorer:
    """Best documents of each item of a block, with whole-number scores.

    A term of weight w that a document of n terms holds tf times adds, for each time
    it stands in the item, w ((10^9 tf) div (1000 tf + 12 m)), m = 75 + (25 n N) div L.
    """

    def __init__(self, index: Index, weight: np.ndarray, documents: int, length: int, k: int):
        self.index, self.weight, self.documents, self.length, self.k = index, weight, documents, length, k
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        #: Score an item's next document must reach.
        self.least = np.ones(len(index.rows), np.int64)

    def add(self, docs: np.ndarray, column: pa.Array) -> None:
        words = _terms(column)
        text, term, times = _look_up(self.index, words)
        m = 75 + (25 * words.counts[text] * self.documents) // max(1, self.length)
        gain = self.weight[term] * ((1_000_000_000 * times) // (1000 * times + 12 * m))
        items = len(self.index.rows)
        fan = self.index.ends[term + 1] - self.index.ends[term]
        low = 0
        while low < len(text):
            # Whole texts, as many as the cells hold.
            high = int(np.searchsorted(text, text[low] + max(1, CELLS // items)))
            scores = np.zeros((int(text[high - 1] - text[low]) + 1) * items, np.int64)
            for a in _parts(fan, low, high):
                here = fan[a]
                entry = np.repeat(self.index.ends[term[a]], here) + _ramp(here)
                cells = np.repeat((text[a] - text[low]) * items, here) + self.index.item[entry]
                scores += exact_sums(cells, np.repeat(gain[a], here) * self.index.times[entry], len(scores))
            self._keep(scores, docs[text[low] :], items)
            low = high

    def _keep(self, scores: np.ndarray, docs: np.ndarray, items: int) -> None:
        good = np.flatnonzero(scores.reshape(-1, items) >= self.least)
        item = np.concatenate((self.item, good % items))
        score = np.concatenate((self.score, scores[good]))
        doc = np.concatenate((self.doc, docs[good // items]))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        first = np.searchsorted(item, np.arange(items))
        best = np.arange(len(item)) - first[item] < self.k
        self.item, self.score, self.doc = item[best], score[best], doc[best]
        ends = np.searchsorted(self.item, np.arange(items), "right")
        full = ends - np.searchsorted(self.item, np.arange(items)) == self.k
        self.least[full] = self.score[ends[full] - 1]


def _parts(fan: np.ndarray, low: int, high: int) -> Iterator[slice]:
    """Runs of look-ups whose entries fit the additions made at a time; each has one at least."""
    total = np.cumsum(fan[low:high])
    begin = 0
    while begin < len(total):
        done = int(total[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + ADDITIONS, "right")))
        yield slice(low + begin, low + end)
        begin = end


def _ramp(lengths: np.ndarray) -> np.ndarray:
    """0, 1, … for each length, one after another."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _best(shared: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight, documents, length = shared.value
        scorer = Scorer(index, weight, documents, length, k)
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for low, high in slices(batch.column(1), SLICE_BYTES):
                scorer.add(docs[low:high], batch.column(1).slice(low, high - low))
        columns = [pa.array(scorer.item, pa.int32()), pa.array(scorer.score), pa.array(scorer.doc)]
        yield pa.record_batch(columns, ["item", "score", "doc"])

    return run


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    k: int = 20,
    postings: int = POSTINGS,
    block_items: int = ITEMS,
) -> DataFrame:
    """(item id, rank, doc id, score) of the ``k`` best documents of each item; fewer where fewer score above 0."""
    spark = docs.sparkSession
    asked = numbered(items.select(item_col, F.col(text_col).cast("string").alias("text")), "items")
    entries = asked.select("row", "kept.text").mapInArrow(_item_terms, "row long, term long, times long")
    entries = stored(entries, "postings")
    size = entries.agg(F.count("*"), F.count_distinct("row")).first()
    blocks = max(1, -(-size[0] // postings), -(-size[1] // block_items))
    # Ids order ties; a missing one comes after all others, with a place of its own below.
    missing = (1 << 63) - 1
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(missing)).alias("doc"), F.col(text_col).cast("string").alias("text")
    )
    results = []
    for block in range(blocks):
        part = entries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block)
        index = _index(part)
        if not len(index.rows):
            continue
        counted = texts.select("text").mapInArrow(_frequencies(spark.sparkContext.broadcast(index)), "term long, n long")
        counts = np.zeros(len(index.terms) + 2, np.int64)
        for row in counted.groupBy("term").agg(F.sum("n").alias("n")).collect():
            counts[row["term"]] = row["n"]
        documents, length = int(counts[-2]), int(counts[-1])
        shared = spark.sparkContext.broadcast((index, weights(documents, counts[:-2]), documents, length))
        heaps = texts.mapInArrow(_best(shared, k), HEAPS).withColumn("slot", F.spark_partition_id() % SLOTS)
        best = _top(_top(heaps, ["item", "slot"], k).drop("rank", "slot"), ["item"], k)
        rows = spark.createDataFrame(list(enumerate(index.rows.tolist())), "item int, row long")
        results.append(best.join(F.broadcast(rows), "item").select("row", "rank", "doc", "score"))
    if not results:
        results = [spark.createDataFrame([], "row long, rank int, doc long, score long")]
    every = results[0]
    for more in results[1:]:
        every = every.union(more)
    kind = docs.schema[id_col].dataType
    return asked.join(every, "row").select(
        F.col(f"kept.{item_col}").alias(item_col),
        "rank",
        F.when(F.col("doc") != missing, F.col("doc")).cast(kind).alias(id_col),
        "score",
    )
