"""Words of whole texts as numpy arrays, read straight from Arrow's buffers.

A batch of texts is one run of bytes with offsets.  Words are found by a table of
256 flags and get a 64-bit hash from prefix sums of a polynomial, so no Python
object is made for a word.  Texts are cut into slices of bounded size and long
texts into pieces at separators, which keeps memory in proportion to the slice.
A missing text counts as empty throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes hashed at a time; only a single word longer than this makes a longer piece.
PIECE = 1 << 18


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Flags of the bytes within the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words are runs of anything but blank and the controls tab to carriage return.
SPACED = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of ASCII letters and digits and of everything beyond ASCII.
ALNUM = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LINES = ~byte_table((0x0A, 0x0A))
CONTINUATION = byte_table((0x80, 0xBF))

_RNG = np.random.default_rng(20240229)
_CODE = _RNG.integers(1, 2**63, 256, dtype=U64)
_LOWER_CODE = _CODE.copy()
_LOWER_CODE[0x41:0x5B] = _CODE[0x61:0x7B]
_BASE = int(_RNG.integers(1, 2**63)) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=U64)


_TABLES = [_powers(_BASE, PIECE), _powers(_INVERSE, PIECE)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    h = h ^ (h >> U64(32))
    h = h * U64(0x9FB21C651E98DF25)
    h = h ^ (h >> U64(29))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


@dataclass
class Texts:
    """Bytes of a run of texts; text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])


@dataclass
class Words:
    """Words of a run of texts, in order."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  #: text i has the words first[i] to first[i + 1]

    def __len__(self) -> int:
        return len(self.hashes)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(len(column) + 1, np.int64)
    low, high = (int(at[0]), int(at[-1])) if len(at) else (0, 0)
    raw = np.frombuffer(data, np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)
    return Texts(raw, at - low)


def slices(column: pa.Array, max_bytes: int, max_texts: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes and texts; one long text may exceed the bytes."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > begin and (held + n > max_bytes or i - begin >= max_texts):
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(lengths):
        yield begin, len(lengths)


def split_words(texts: Texts, table: np.ndarray = SPACED, lower: bool = False) -> Words:
    """Words of all texts; ``lower`` makes A-Z count as a-z."""
    data, offsets = texts.data, texts.offsets
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none.astype(U64), none, none, np.zeros(len(offsets), np.int64))
    word = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, word[:-1]
    before &= ~edge[:-1]
    starts = np.flatnonzero(word & ~before)
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, word[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(word & ~after) + 1
    code = _LOWER_CODE if lower else _CODE
    hashes = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + PIECE, "right")))
        high = int(ends[j - 1])
        n = high - low
        if n <= PIECE:
            power, inverse = _TABLES
        else:
            power, inverse = _powers(_BASE, n), _powers(_INVERSE, n)
        sums = np.zeros(n + 1, U64)
        np.cumsum(code[data[low:high]] * power[:n], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        hashes[i:j] = (sums[b] - sums[a]) * inverse[a] + b.astype(U64)  - a.astype(U64)
        i = j
    return Words(mix(hashes), starts, ends, np.searchsorted(starts, offsets))


_STEP = 0x9E3779B97F4A7C15 | 1


def windows(hashes: np.ndarray, k: int, step: int = _STEP) -> np.ndarray:
    """Hash of the k words from each position on, mixed; shorter by k - 1 than the input.

    Windows that cross from one text into the next are in it too: mask them with
    :func:`starts_window`.
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, have, power, size, left = None, 0, hashes, 1, k
    while left:
        if left & 1:
            out = power[:n].copy() if out is None else out * U64(pow(step, size, 1 << 64)) + power[have : have + n]
            have += size
        left >>= 1
        if left:
            power = power[: len(power) - size] * U64(pow(step, size, 1 << 64)) + power[size:]
            size *= 2
    return mix(out)


def starts_window(words: Words, k: int) -> np.ndarray:
    """For each position of :func:`windows`, whether the window lies within one text."""
    n = max(0, len(words) - k + 1)
    room = np.repeat(words.first[1:], words.counts)[:n] - np.arange(n)
    return room >= k


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Flags of n positions that lie in any span [start, start + length)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0
