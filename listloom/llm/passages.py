"""Removal of repeated word passages, by difference-cover anchors.

A window of ``WINDOW`` words is removed wherever its sequence also starts elsewhere.
Hashing every window of every text would move each word; instead only windows of
``ANCHOR`` words at places whose remainder by ``PERIOD`` lies in a difference cover
are hashed.  For any two places some shift below the period brings both to cover
places, so two equal windows share an aligned anchor (PERIOD - 1 + ANCHOR = WINDOW).

1. Texts are dealt into slices of bounded size.  A slice sends the anchors it holds,
   each once and packed, and learns which occur twice or more in all.
2. Around these the text is extended: only windows that hold a repeated anchor are
   hashed whole, with 96 bits, and sent in the same way.
3. Words covered by windows found twice or more go.

The exchange of the texts is made once and used by all three steps.  A slice sends a
hash once, so a passage shared by a third of all rows gives a key no more entries than
there are slices, and places do not travel.

Missing and empty texts have no words; texts below ``WINDOW`` words lose none;
repeated rows and equal ids count as separate texts; very long texts make a slice of
their own; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listloom.llm.packed import NOTE, SENT, answer, distinct, marks, sent
from listloom.llm.words import covered, split_words, starts_window, texts_of, windows

#: A perfect difference cover: every remainder is a difference of two of these.
COVER, PERIOD = (0, 1, 4, 14, 16), 21
WINDOW = 35
ANCHOR = WINDOW - PERIOD + 1
SLICE_BYTES = 4 << 20
SECOND = 0xC2B2AE3D27D4EB4F
#: Bits of an anchor's hash that do not travel; who shares the others is only a candidate.
SHIFT = 12
#: Slices that share a bucket of hashes, and buckets of small inputs.
SHARE, BUCKETS = 16, 32
ANCHORS, WINDOWS = 0, 1


class _Slice:
    """Words of the texts of a slice, with their anchors."""

    def __init__(self, table: pa.Table):
        self.texts = texts_of(table["text"])
        self.words = split_words(self.texts)
        self.at = np.arange(len(self.words)) - np.repeat(self.words.first[:-1], self.words.counts)
        in_cover = np.isin(np.arange(PERIOD), COVER)[self.at % PERIOD][: max(0, len(self.words) - ANCHOR + 1)]
        self.anchors = np.flatnonzero(starts_window(self.words, ANCHOR) & in_cover)
        hashes = windows(self.words.hashes, ANCHOR)[self.anchors] >> np.uint64(SHIFT)
        (self.known,), self.times, self.which = distinct(hashes)

    def candidates(self, marked: np.ndarray) -> None:
        """Windows that hold a marked anchor; they start up to PERIOD - 1 places before it, in its text."""
        near = self.anchors[marked[self.which] > 0]
        starts = np.maximum(near - PERIOD + 1, near - self.at[near])
        valid = starts_window(self.words, WINDOW)
        self.starts = np.flatnonzero(valid & covered(starts, near + 1 - starts, len(self.words))[: len(valid)])
        one = windows(self.words.hashes, WINDOW)[self.starts]
        two = (windows(self.words.hashes, WINDOW, SECOND)[self.starts] >> np.uint64(32)).astype(np.uint32)
        (self.known, self.check), self.times, self.which = distinct(one, two)


def _send_anchors(buckets: int) -> Callable:
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        part = _Slice(docs)
        return sent(key[0].as_py(), part.known, part.times, buckets, SHIFT)

    return run


def _send_windows(buckets: int) -> Callable:
    def run(key: tuple, docs: pa.Table, notes: pa.Table) -> pa.Table:
        part = _Slice(docs)
        part.candidates(marks(notes, ANCHORS, part.known, buckets, SHIFT))
        return sent(key[0].as_py(), part.known, part.times, buckets, check=part.check)

    return run


def _removed(buckets: int, with_text: bool) -> Callable:
    def run(key: tuple, docs: pa.Table, notes: pa.Table) -> pa.Table:
        part = _Slice(docs)
        words, texts = part.words, part.texts
        part.candidates(marks(notes, ANCHORS, part.known, buckets, SHIFT))
        found = marks(notes, WINDOWS, part.known, buckets)
        gone = covered(part.starts[found[part.which] > 0], WINDOW, len(words))
        n_gone = np.diff(np.concatenate(([0], np.cumsum(gone)))[words.first])
        data, digests, kept = texts.data.tobytes(), [], []
        for i in range(len(texts)):
            a, b = words.first[i], words.first[i + 1]
            if n_gone[i]:
                stay = a + np.flatnonzero(~gone[a:b])
                parts = [data[s:e] for s, e in zip(words.starts[stay].tolist(), words.ends[stay].tolist())]
            else:
                parts = data[texts.offsets[i] : texts.offsets[i + 1]].split()
            text = b" ".join(parts)
            digests.append(hashlib.sha256(text).hexdigest())
            if with_text:
                kept.append(text.decode())
        out = {"id": docs["id"], "n_words": words.counts, "n_removed": n_gone, "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept_text": pa.array(kept, pa.string())} if with_text else {}))

    return run


def remove_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """Per document: words, words removed, and digest (and text, if asked) of those that stay."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-total // slice_bytes))
    buckets = max(min(slices, BUCKETS), slices // SHARE)
    # Dealt by content, so that no later step depends on how the rows were read.
    dealt = rows.withColumn("p", F.pmod(F.xxhash64("id", "text"), F.lit(slices))).groupBy("p")
    anchors = dealt.applyInArrow(_send_anchors(buckets), SENT).groupBy("b").applyInArrow(answer(ANCHORS), NOTE)
    hashed = dealt.cogroup(anchors.groupBy("p")).applyInArrow(_send_windows(buckets), SENT)
    notes = anchors.union(hashed.groupBy("b").applyInArrow(answer(WINDOWS), NOTE))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    out = dealt.cogroup(notes.groupBy("p")).applyInArrow(_removed(buckets, with_text), schema)
    return out.withColumnRenamed("id", id_col)
