"""Hashes that slices of a corpus exchange to learn how often each occurs elsewhere.

A slice is a group of texts of bounded size that one call handles.  It sends its
distinct hashes in order, cut by range into buckets, as gaps: a row for each bucket,
some bytes for each hash.  A bucket adds up what all slices sent and answers each with
a mark for each hash, in the order sent; nothing else has to travel back.  A hash that
very many texts hold costs a slice one entry, and a bucket as many as there are slices.

Answers are notes (p, kind, b, body): slice, kind, bucket, bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
NOTES = pa.schema([("p", pa.int64()), ("kind", pa.int32()), ("b", pa.int32()), ("body", pa.binary())])
NOTE = "p long, kind int, b int, body binary"
SENT = "b int, p long, first long, low binary, high binary, times binary, check binary"
_SENT = pa.schema(
    [("b", pa.int32()), ("p", pa.int64()), ("first", pa.int64())] + [(c, pa.binary()) for c in ("low", "high", "times", "check")]
)
#: Steps of a mark for each doubling of a count.
STEPS = 12


def heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new value of the sorted keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))))


def ramp(lengths: np.ndarray) -> np.ndarray:
    """0, 1, … for each length, one after another."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Range of the hash, so that order of hashes is order of buckets."""
    return (((hashes >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


def runs_of(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted buckets."""
    head = heads(buckets)
    for low, high in zip(head.tolist(), np.append(head[1:], len(buckets)).tolist()):
        yield int(buckets[low]), low, high


def small(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def large(packed: bytes, kind, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, n * np.dtype(kind).itemsize, codec="zstd"), kind)


def distinct(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys in order, how often each occurs, and which one each entry is."""
    order = np.lexsort(keys[::-1])
    sorted_ = [k[order] for k in keys]
    head = heads(*sorted_)
    times = np.diff(np.append(head, len(order)))
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(head)), times)
    return [k[head] for k in sorted_], times, which


def sent(p: int, known: np.ndarray, times: np.ndarray, buckets: int, shift: int = 0, check: np.ndarray | None = None) -> pa.Table:
    """Rows for the buckets of a slice's distinct hashes of ``64 - shift`` bits, with 32 more bits of each if given."""
    out = {name: [] for name in _SENT.names}
    for bucket, low, high in runs_of(bucket_of(known << U64(shift), buckets)):
        # Shingles in order as gaps, whose upper halves are small.
        gaps = np.diff(known[low:high])
        more = b"" if check is None else check[low:high].tobytes()
        row = (
            bucket, p, int(known[low : low + 1].view(np.int64)[0]), gaps.astype(np.uint32).tobytes(),
            small((gaps >> U64(32)).astype(np.uint32)), small(np.minimum(times[low:high], 255).astype(np.uint8)), more,
        )
        for name, value in zip(_SENT.names, row):
            out[name].append(value)
    return pa.table(out, _SENT)


def answer(kind: int) -> Callable:
    """Marks of what slices sent to a bucket: 0 where it occurs once in all, else by the logarithm of its count."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        hashes, times, checks = [], [], []
        for first, low, high, counts, check in zip(*(table[c].to_pylist() for c in _SENT.names[2:])):
            low = np.frombuffer(low, np.uint32)
            gaps = low.astype(U64) | (large(high, np.uint32, len(low)).astype(U64) << U64(32))
            values = np.full(len(low) + 1, np.int64(first).view(U64), U64)
            values[1:] += np.cumsum(gaps, dtype=U64)
            hashes.append(values)
            times.append(large(counts, np.uint8, len(values)))
            checks.append(np.frombuffer(check, np.uint32) if check else np.zeros(len(values), np.uint32))
        counts, which = np.concatenate(times).astype(np.int64), distinct(np.concatenate(hashes), np.concatenate(checks))[2]
        total = np.bincount(which, counts)
        mark = np.where(total > 1, np.clip(STEPS * np.log2(np.maximum(total, 1)), 1, 255), 0).astype(np.uint8)[which]
        ends = np.cumsum([len(v) for v in hashes])
        out = {name: [] for name in NOTES.names}
        for p, high, values in zip(table["p"].to_pylist(), ends.tolist(), hashes):
            body = mark[high - len(values) : high]
            if body.any():
                for name, value in zip(NOTES.names, (p, kind, key[0].as_py(), len(body).to_bytes(8, "little") + small(body))):
                    out[name].append(value)
        return pa.table(out, NOTES)

    return run


def marks(notes: pa.Table, kind: int, known: np.ndarray, buckets: int, shift: int = 0) -> np.ndarray:
    """The answers to a slice, one for each of its distinct hashes."""
    bucket = bucket_of(known << U64(shift), buckets)
    out = np.zeros(len(known), np.uint8)
    for b, of, body in zip(*(notes[c].to_pylist() for c in ("b", "kind", "body"))):
        if of == kind:
            low, size = int(np.searchsorted(bucket, b)), int.from_bytes(body[:8], "little")
            out[low : low + size] = large(body[8:], np.uint8, size)
    return out
