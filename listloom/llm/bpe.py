"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

Within a run of bytes, whether a boundary between two tokens stays depends on bytes
to its right only through merges of falling rank: a merge (b, c) across it needs c to
stand, which a merge of lower rank across c's right end can prevent, and so on.  The
longest such chain, found by one pass over the merges in order of rank, bounds the
bytes that can matter: the merge list's sufficient lookahead.  Tokens that end at
least that far before what has been read are final and leave the buffer, so a run of
any length is encoded with a buffer of constant size, fed as the split pattern gives its
place in the text; a piece is merged by a heap of ranks, in time of its length times the
logarithm.  The text itself and its ids, four bytes a token, are held for the row.

Decoding runs tokens through a byte-to-text state machine that keeps at most an
unfinished character.

Short runs need no lookahead; new ones are merged many at a time, and a worker
remembers them in a table of bounded size.  One row stays one row: no
shuffle.  Missing texts count as empty and give no tokens; equal rows give equal
tokens; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from codecs import getincrementaldecoder
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text, and runs of it, handled at a time; above LONG_RUN a run is fed to the transducer.
CHUNK, LONG_RUN = 1 << 16, 64
#: Lookaheads fed at a time: what is merged again because it was not final is a small part.
FEED = 16
NONE = np.int64(2**62)
#: Runs remembered by a worker.
MEMO = 300_000
#: Texts whose new runs are merged together.
GROUP = 200

# Fixed value: the pattern that splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _range(kind: str) -> str:
    """Characters of a kind up to U+FFFF as ranges of a character class."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    runs = (m.group() for part in (plane[:0xD800], plane[0xD800:]) for m in regex.finditer(kind + "+", part))
    return "".join(f"{re.escape(r[0])}-{re.escape(r[-1])}" for r in runs)


def split_pattern() -> re.Pattern:
    """PATTERN for text up to U+FFFF, for the standard library's matcher, which is several times as fast.

    A run of letters or of digits and a contraction begin differently, so their order is free.
    """
    letter, digit, space = _range(r"\p{L}"), _range(r"\p{N}"), _range(r"\s")
    other = f"[^{space}{letter}{digit}]"
    return re.compile(
        f" ?[{letter}]+| ?[{digit}]+|'(?:[stmd]|re|ve|ll)| ?{other}+|[{space}]+(?![^{space}])|[{space}]+"
    )


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files of this kind."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Merges, ids and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        of_letter = {letter: b for b, letter in enumerate(byte_letters())}
        to_bytes = lambda s: bytes(of_letter[c] for c in s)
        model = content["model"]
        ids = {to_bytes(token): i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        #: (left id, right id) -> (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.size = {i: len(token) for token, i in ids.items()}
        self.bytes = {i: token for token, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        for rank, (a, b) in enumerate(pairs):
            a, b = to_bytes(a), to_bytes(b)
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.lookahead = self._lookahead()
        self._table()

    def _lookahead(self) -> int:
        """Bytes after a boundary that can decide whether it stays."""
        right_part: dict[int, int] = {}
        reach: dict[int, int] = {}  # token -> longest chain of a merge with it at the left, so far
        longest = 0
        for (a, b), (_, merged) in sorted(self.merges.items(), key=lambda m: m[1][0]):
            chain, token = reach.get(b, 0), b
            while token in right_part:
                token = right_part[token]
                chain = max(chain, reach.get(token, 0))
            chain += self.size[b]
            reach[a] = max(reach.get(a, 0), chain)
            right_part[merged] = b
            longest = max(longest, chain)
        return longest

    def merge(self, run: bytes) -> list[int]:
        """Tokens of a whole run: the pair of lowest rank merges first, leftmost of equals.

        Pairs wait in a heap; neighbours are linked, so a merge costs no more than the heap.
        """
        byte_id, get = self.byte_id, self.merges.get
        tokens, n = [byte_id[b] for b in run], len(run)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*found, i, pair) for i, pair in enumerate(zip(tokens, tokens[1:])) if (found := get(pair)) is not None]
        heapify(heap)
        while heap:
            _, merged, i, (a, b) = heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (found := get((merged, tokens[k]))) is not None:
                    heappush(heap, (*found, i, (merged, tokens[k])))
            h = before[i]
            if h >= 0 and (found := get((tokens[h], merged))) is not None:
                heappush(heap, (*found, h, (tokens[h], merged)))
        return [t for t in tokens if t >= 0]

    def _table(self) -> None:
        """Merges as arrays sorted by pair, for :meth:`merge_many`."""
        items = sorted((a << 32 | b, rank, merged) for (a, b), (rank, merged) in self.merges.items())
        self.pairs, self.ranks, self.merged = (np.array(column, np.int64) for column in zip(*items))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, by which merging order can be read; NONE if it never merges."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at] << 32 | at, NONE)

    def merge_many(self, runs: list[bytes]) -> list[bytes]:
        """Ids of many short runs, as :meth:`merge` gives them, one merge of each at a time."""
        if not runs:
            return []
        sizes = np.array([len(r) for r in runs])
        tokens = np.array(self.byte_id)[np.frombuffer(b"".join(runs), np.uint8)]
        of = np.repeat(np.arange(len(runs)), sizes)
        best = np.full(len(tokens), NONE)
        same = of[1:] == of[:-1]
        best[:-1][same] = self._rank(tokens[:-1][same], tokens[1:][same])
        done_tokens, done_of = [], []
        while len(tokens):
            starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            lowest = np.repeat(np.minimum.reduceat(best, starts), np.diff(np.append(starts, len(tokens))))
            ended = lowest == NONE
            if ended.any():
                done_tokens.append(tokens[ended])
                done_of.append(of[ended])
                tokens, of, best, lowest = (x[~ended] for x in (tokens, of, best, lowest))
                if not len(tokens):
                    break
            at = np.flatnonzero(best == lowest)
            # Of overlapping places (the same token thrice) the leftmost counts.
            fresh = np.concatenate(([True], at[1:] != at[:-1] + 1))
            first = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            at = at[(at - first) % 2 == 0]
            tokens[at] = self.merged[best[at] & 0xFFFFFFFF]
            gone = np.zeros(len(tokens), bool)
            gone[at + 1] = True
            new = at - np.arange(len(at))
            tokens, of, best = tokens[~gone], of[~gone], best[~gone]
            # Pairs at the merged token and before it are new.
            touched = np.concatenate((new, new[new > 0] - 1))
            best[touched] = NONE
            touched = touched[touched + 1 < len(tokens)]
            touched = touched[of[touched] == of[touched + 1]]
            best[touched] = self._rank(tokens[touched], tokens[touched + 1])
        tokens, of = np.concatenate(done_tokens), np.concatenate(done_of)
        order = np.argsort(of, kind="stable")
        data = tokens[order].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(of, minlength=len(runs)))).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


class RunTransducer:
    """Tokens of one run that arrives in pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.buffer = vocabulary, b""

    def feed(self, piece: bytes) -> list[int]:
        self.buffer += piece
        final = len(self.buffer) - self.vocabulary.lookahead
        # Merging again only once as much is new keeps the work linear.
        if final < self.vocabulary.lookahead:
            return []
        out, end, size = [], 0, self.vocabulary.size
        for token in self.vocabulary.merge(self.buffer):
            if end + size[token] > final:
                break
            end += size[token]
            out.append(token)
        self.buffer = self.buffer[end:]
        return out

    def finish(self) -> list[int]:
        out = self.vocabulary.merge(self.buffer)
        self.buffer = b""
        return out


class Encoder:
    """Ids of texts as little-endian 32-bit integers."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.any, self.fast = regex.compile(PATTERN), split_pattern()
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.memo: dict[str, bytes] = {}

    def _pattern(self, text: str):
        return self.any if self.beyond(text) else self.fast

    def split(self, text: str) -> list[str]:
        return self._pattern(text).findall(text)

    def run(self, text: str, low: int = 0, high: int | None = None) -> bytes:
        """Ids of the run at a place of a text, which is never cut out or held as a whole."""
        high = len(text) if high is None else high
        if high - low <= LONG_RUN:
            return np.array(self.vocabulary.merge(text[low:high].encode()), "<u4").tobytes()
        transducer, out = RunTransducer(self.vocabulary), []
        step = FEED * self.vocabulary.lookahead
        for i in range(low, high, step):
            out.append(np.array(transducer.feed(text[i : min(i + step, high)].encode()), "<u4").tobytes())
        out.append(np.array(transducer.finish(), "<u4").tobytes())
        return b"".join(out)

    def _ids(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of several lists of runs; runs not met before are merged together."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        found = [list(map(memo.get, runs)) for runs in lists]
        short = [i for i, ids in enumerate(found) if None in ids]
        missing = {r for i in short for r, ids in zip(lists[i], found[i]) if ids is None}
        new = {r: self.run(r) for r in missing if len(r) > LONG_RUN // 4}
        rest = [r for r in missing if r not in new]
        fresh = dict(zip(rest, self.vocabulary.merge_many([r.encode() for r in rest])))
        memo.update(fresh)
        new |= fresh
        for i in short:
            found[i] = [new[r] if ids is None else ids for r, ids in zip(lists[i], found[i])]
        return [b"".join(ids) for ids in found]

    def _stream(self, text: str) -> Iterator[bytes]:
        """Ids of a text without special tokens, run by run as the pattern meets them."""
        runs: list[str] = []
        for found in self._pattern(text).finditer(text):
            low, high = found.span()
            if high - low <= LONG_RUN and len(runs) < CHUNK:
                runs.append(text[low:high])
                continue
            yield self._ids([runs])[0]
            runs = []
            yield self.run(text, low, high)
        yield self._ids([runs])[0]

    def _long(self, text: str) -> bytes:
        parts = self.special.split(text) if self.special else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(np.array([self.vocabulary.special[part]], "<u4").tobytes())
            else:
                out.extend(self._stream(part))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = {i for i, t in enumerate(texts) if len(t) > CHUNK or self.special and self.special.search(t)}
        plain = [i for i in range(len(texts)) if i not in odd]
        out = {i: self._long(texts[i]) for i in odd}
        for low in range(0, len(plain), GROUP):
            some = plain[low : low + GROUP]
            out.update(zip(some, self._ids([self.split(texts[i]) for i in some])))
        return [out[i] for i in range(len(texts))]


class Decoder:
    """Text of ids; a broken character becomes the replacement sign once its bytes end."""

    def __init__(self, vocabulary: Vocabulary):
        top = max(vocabulary.bytes) + 1
        self.pieces = [vocabulary.bytes.get(i, b"") for i in range(top)]
        self.machine = getincrementaldecoder("utf-8")("replace")

    def decode(self, ids: np.ndarray) -> Iterator[str]:
        self.machine.reset()
        pieces = self.pieces
        for i in range(0, len(ids), CHUNK):
            yield self.machine.decode(b"".join([pieces[t] for t in ids[i : i + CHUNK].tolist()]))
        yield self.machine.decode(b"", True)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text as ``ids`` (array of int), under its id."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = encoder(path)
        for batch in batches:
            for low in range(0, len(batch), GROUP):
                part = batch.slice(low, GROUP)
                ids = transducer.encode([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                counts = pa.array(np.diff(ends))
                yield pa.record_batch([part.column(0), counts, lists], ["id", "n_tokens", "ids"])

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return frame.mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode its ids, and give digests of both."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = encoder(path)
        decoder = Decoder(transducer.vocabulary)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for low in range(0, len(batch), GROUP):
                for ids in transducer.encode([t or "" for t in batch.column(1).slice(low, GROUP).to_pylist()]):
                    counts.append(len(ids) // 4)
                    of_ids.append(hashlib.sha256(ids).hexdigest())
                    digest = hashlib.sha256()
                    for piece in decoder.decode(np.frombuffer(ids, "<u4")):
                        digest.update(piece.encode())
                    of_text.append(digest.hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.record_batch(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = frame.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
