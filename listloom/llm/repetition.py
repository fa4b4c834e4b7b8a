"""Quality rules over repetition, by suffix arrays.

The suffixes of a text's words are sorted by prefix doubling, refining only groups
that still hold several suffixes; the longest common prefixes of neighbours give
the intervals of the suffix array, thus every maximal repeated substring.  The
spans of repeats of at least ``min_repeat`` words are united.  A text fails if they
cover more than ``max_covered`` of its words, or if one repeat is longer than
``max_longest`` words and than ``max_longest_share`` of the text, or longer than
``max_longest_any`` words whatever the text's length.  What repeats cover is part of
what the base rule counts, so ``max_covered`` lies well below ``max_repeat_percent``.

One row stays one row: no shuffle, no group.  Missing and empty texts have no words
and fail the base rule; equal rows get equal verdicts; an empty table gives an empty
one; other columns are ignored by the report and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listloom.llm.words import CONTINUATION, LINES, SPACED, Texts, byte_table, covered, slices, split_words, texts_of

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
NEWLINE_FREE = byte_table((0x0A, 0x0A))
#: Bytes and texts sorted together.
SLICE_BYTES, SLICE_TEXTS = 1 << 19, 1000

REPORT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, covered_words long, longest_repeat long, kept boolean"
)


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    min_repeat: int = 8
    max_covered: float = 0.3
    max_longest: int = 40
    max_longest_share: float = 0.15
    max_longest_any: int = 200


def _suffix_order(words: np.ndarray, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes sorted by text, then words; ranks after 3, 6, 12 … words."""
    n = len(words)
    code = np.zeros(n + 2, np.uint64)
    code[:n] = words + 1
    at = np.arange(n)
    second = np.where(at + 1 < ends, code[1 : n + 1], 0).astype(np.uint64)
    third = np.where(at + 2 < ends, code[2 : n + 2], 0).astype(np.uint64)
    bits = int(code.max()).bit_length()
    if 3 * bits + int(text[-1]).bit_length() <= 64:
        key = text.astype(np.uint64)
        for part in (code[:n], second, third):
            key = (key << np.uint64(bits)) | part
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.concatenate(([True], key[1:] != key[:-1]))
    else:
        order = np.lexsort((third, second, code[:n], text))
        head = np.zeros(n, bool)
        head[0] = True
        for part in (text, code[:n], second, third):
            part = part[order]
            head[1:] |= part[1:] != part[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, at, 0))
    levels, length = [(3, rank.copy())], 3
    tail = np.concatenate((head[1:], [True]))
    active = np.flatnonzero(~(head & tail))
    while len(active):
        p = order[active]
        beyond = p + length
        follow = np.where(beyond < ends[p], rank[np.minimum(beyond, n - 1)] + 1, 0)
        old = rank[p]
        sub = np.lexsort((follow, old))
        p, follow, old = p[sub], follow[sub], old[sub]
        order[active] = p
        new = np.concatenate(([True], (old[1:] != old[:-1]) | (follow[1:] != follow[:-1])))
        rank[p] = np.maximum.accumulate(np.where(new, active, 0))
        length *= 2
        levels.append((length, rank.copy()))
        last = np.concatenate((new[1:], [True]))
        active = active[~(new & last)]
    return order, levels


def repeats(words: np.ndarray, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: whether its three words occur again in the text, and how many words from it do."""
    n = len(words)
    longest = np.zeros(n, np.int64)
    if not n:
        return np.zeros(0, bool), longest
    order, levels = _suffix_order(words, text, ends)
    ranks = levels[0][1][order]
    # Neighbours in the order that share three words, all of them inside the text.
    near = np.flatnonzero(ranks[1:] == ranks[:-1])
    a, b = order[near], order[near + 1]
    near, a, b = (x[np.maximum(a, b) + 3 <= ends[a]] for x in (near, a, b))
    common = np.zeros(len(near), np.int64)
    for length, rank in reversed(levels):
        x, y = a + common, b + common
        inside = (x < ends[a]) & (y < ends[b])
        same = inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]) & (np.maximum(x, y) + length <= ends[a])
        common += np.where(same, length, 0)
    for _ in range(2):
        x, y = a + common, b + common
        inside = (x < ends[a]) & (y < ends[b])
        common += inside & (words[np.minimum(x, n - 1)] == words[np.minimum(y, n - 1)])
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest >= 3, longest


def assess(texts: Texts, limits: Limits = Limits()) -> dict[str, np.ndarray]:
    """All measures and verdicts of a slice of texts."""
    found = split_words(texts, SPACED)
    counts, first = found.counts, found.first
    text, n = found.text, len(found)
    ends = np.repeat(first[1:], counts)
    ids = np.unique(found.hashes, return_inverse=True)[1] if n else np.zeros(0, np.int64)
    again, longest = repeats(ids, text, ends)
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[first])
    thrice = covered(np.flatnonzero(again), 3, n)
    long_enough = np.flatnonzero(longest >= limits.min_repeat)
    held = total(covered(long_enough, longest[long_enough], n))
    most = np.zeros(len(counts), np.int64)
    np.maximum.at(most, text, longest)
    # Lines that hold a word, as often as an equal one came before.
    lines = split_words(texts, LINES)
    word_bytes = np.concatenate(([0], np.cumsum(SPACED[texts.data])))
    real = word_bytes[lines.ends] > word_bytes[lines.starts]
    line_text, line_hash = lines.text[real], lines.hashes[real]
    kinds = np.lexsort((line_hash, line_text))
    line_text, line_hash = line_text[kinds], line_hash[kinds]
    equal = (line_text[1:] == line_text[:-1]) & (line_hash[1:] == line_hash[:-1])
    dup_lines = np.bincount(line_text[1:][equal], minlength=len(counts))
    repeated = total(thrice)
    failed = (counts < limits.min_words) | (100 * repeated > limits.max_repeat_percent * counts)
    bad = (held > limits.max_covered * counts) | (most > limits.max_longest_any)
    bad |= (most > limits.max_longest) & (most > limits.max_longest_share * counts)
    return {
        "n_words": counts,
        "word_chars": texts.per_text(SPACED[texts.data] & ~CONTINUATION[texts.data]),
        "n_symbols": texts.per_text(SYMBOLS[texts.data]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeated,
        "base_failed": failed,
        "covered_words": held,
        "longest_repeat": most,
        "kept": ~failed & ~bad,
    }


def repetition_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Measures and verdict of every text, under its id."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1), SLICE_BYTES, SLICE_TEXTS):
                part = batch.slice(low, high - low)
                columns = assess(texts_of(part.column(1)), limits)
                yield pa.record_batch([part.column(0), *map(pa.array, columns.values())], ["id", *columns])

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return frame.mapInArrow(run, f"id {kind}, {REPORT}").withColumnRenamed("id", id_col)


def keep_varied(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Rows whose text passes, with all their columns."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(place), SLICE_BYTES, SLICE_TEXTS):
                part = batch.slice(low, high - low)
                yield part.filter(pa.array(assess(texts_of(part.column(place)), limits)["kept"]))

    return docs.mapInArrow(run, docs.schema)
