"""Class-based n-gram language model with exchange clustering.

p(word | previous) = p(class | previous class) * p(word | class), both add-one smoothed.
Counts come from all training texts: words and pairs of neighbouring words (both shuffled,
so they grow with the corpus) and pairs of classes.  The exchange algorithm moves every
training word, however rare, to the class that raises the likelihood of all pairs most,
until a sweep over the words raises it no further (``word_classes``); the ``CLUSTERED`` most
frequent words are exchanged first among themselves.  Words that no training text has belong
to classes by form (digits, letters beyond ASCII, other signs, length).

Scoring reads each text once.  Counts of the ``HEAD`` most frequent words are copied to
the executors (a fixed number), with their classes; every other word is joined with the
word table, summed by text, word and the classes beside it before it moves.

A missing text is empty: its only token is the end.  A missing id counts as an empty
one when texts are set aside.  Equal ids and repeated rows are told apart by row;
without training texts all counts are 0; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listloom.llm.packed import bucket_of, heads, large, runs_of, small
from listloom.llm.tables import BROADCAST_BYTES, shuffles_removed, stored
from listloom.llm.words import byte_table, mix, slices, split_words, texts_of

CLUSTERED, CLASSES, SWEEPS = 1024, 32, 6
HEAD = 1 << 18
FORMS = 24
END_CLASS = CLASSES + FORMS
TOTAL = END_CLASS + 1
#: The end of a text as a token; no word hashes to it but by an accident of 64 bits.
END = np.uint64(0)
SLICE_BYTES = 4 << 20
#: Words of a bucket, and how many of them are weighed against the same table.
WORDS, CHUNK = 1 << 17, 1 << 12
#: Classes whose likelihood is worked out for a word; turns of a sweep; the rise of the likelihood a token (in nats) below which sweeps end.
NEAREST, TURNS, GAIN = 3, 2, 1e-3
#: Distinct words a task holds before it hands them on.
HELD = 1_000_000


def held_out(id_: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


class Tokens:
    """Words and one end per text, in order, with the form of each."""

    def __init__(self, column: pa.Array):
        texts = texts_of(column)
        words = split_words(texts, lower=True)
        raw = texts.data

        def has(table: np.ndarray) -> np.ndarray:
            total = np.zeros(len(raw) + 1, np.int32)
            np.cumsum(table[raw], out=total[1:])
            return total[words.ends] > total[words.starts]

        letters = byte_table((65, 90), (97, 122))
        digits, beyond = byte_table((48, 57)), byte_table((128, 255))
        form = has(digits) + 2 * has(beyond) + 4 * has(~(letters | digits | beyond))
        form = form * 3 + np.digitize(words.ends - words.starts, (6, 11))
        n = words.counts
        self.first = words.first + np.arange(len(words.first))
        ends = self.first[1:] - 1
        total = len(words) + len(n)
        is_word = np.ones(total, bool)
        is_word[ends] = False
        self.hashes, self.forms, self.is_end = np.full(total, END), np.full(total, FORMS), ~is_word
        self.hashes[is_word], self.forms[is_word] = words.hashes, form
        self.text = np.repeat(np.arange(len(n)), n + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def handed(parts):
        hashes, counts, forms = (np.concatenate(x) for x in zip(*parts))
        keys, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        return keys, np.bincount(back, counts, len(keys)).astype(np.int64), forms[at]

    def batch_of(keys, counts, forms):
        return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts), pa.array(forms.astype(np.int32))], ["word", "n", "form"])

    parts: list = []
    for batch in batches:
        for low, high in slices(batch.column(0), SLICE_BYTES):
            tokens = Tokens(batch.column(0).slice(low, high - low))
            keys, at, counts = np.unique(tokens.hashes, return_index=True, return_counts=True)
            parts.append((keys, counts, tokens.forms[at]))
            if sum(len(p[0]) for p in parts) > HELD:
                parts = [handed(parts)]
                if len(parts[0][0]) > HELD // 2:
                    yield batch_of(*parts.pop())
    if parts:
        yield batch_of(*handed(parts))


@dataclass
class Lookup:
    """Numbers of known words, sorted by hash."""

    hashes: np.ndarray
    values: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.values[at], self.hashes[at] == hashes


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each word of a square table of pair counts, by the exchange algorithm.

    Words are in order of frequency: at first the most frequent have a class each, all others the last.
    """
    k = len(pairs)
    of = np.minimum(np.arange(k), classes - 1)
    log = lambda x: x * np.log(np.maximum(x, 1))
    between = np.zeros((classes, classes))
    np.add.at(between, (of[:, None], of[None, :]), pairs)
    right, left = pairs.sum(1), pairs.sum(0)
    if not pairs.any():
        return of

    def value(t: np.ndarray) -> np.ndarray:
        """Likelihood terms of stacked class tables."""
        return log(t).sum((-1, -2)) - log(t.sum(-1)).sum(-1) - log(t.sum(-2)).sum(-1)

    eye = np.eye(classes)
    for _ in range(sweeps):
        moved = 0
        for w in range(k):
            if not right[w] + left[w]:
                continue
            to, by, self_pair = np.bincount(of, pairs[w], classes), np.bincount(of, pairs[:, w], classes), pairs[w, w]
            old = of[w]
            to[old] -= self_pair
            by[old] -= self_pair
            base = between.copy()
            base[old, :] -= to
            base[:, old] -= by
            base[old, old] -= self_pair
            tables = base + eye[:, :, None] * to + eye[:, None, :] * by[:, None] + self_pair * eye[:, :, None] * eye[:, None, :]
            new = int(value(tables).argmax())
            if new != old and value(tables[new]) > value(tables[old]) + 1e-9:
                of[w], between, moved = new, tables[new], moved + 1
        if not moved:
            break
    return of


def _dense(frame: DataFrame, size: int) -> np.ndarray:
    """Sums by pair as a table; its size is fixed whatever the input."""
    got = frame.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(size, size)


def _packed(hashes: np.ndarray, n: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    return hashes[order], n[order], forms[order].astype(np.int8)


def _bucket(group: pa.Table) -> pa.Table:
    """Words of a bucket in order of their hashes: a word's place is its number."""
    hashes, n, forms = _packed(group["word"].to_numpy().view(np.uint64), group["n"].to_numpy(), group["form"].to_numpy())
    return pa.table({"i": pa.array([group["i"][0].as_py()], pa.int32()), "words": [hashes.tobytes()], "counts": [n.tobytes()], "forms": [forms.tobytes()]})


def _neighbours(buckets: int) -> Callable:
    """Counts of neighbouring words, a row for each two buckets; before a text stands an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(0), SLICE_BYTES):
                known, number = np.unique(Tokens(batch.column(0).slice(low, high - low)).hashes, return_inverse=True)
                # The end is the least hash, and every text has one.
                keys, n = np.unique(np.concatenate(([0], number[:-1])) * len(known) + number, return_counts=True)
                left, right = np.divmod(keys, len(known))
                of = bucket_of(known, buckets)
                block = of[left] * buckets + of[right]
                order = np.argsort(block, kind="stable")
                left, right, n, block = known[left[order]], known[right[order]], n[order].astype(np.uint32), block[order]
                rows: dict = {"i": [], "j": [], "a": [], "b": [], "n": []}
                for k, a, b in runs_of(block):
                    for name, value in zip(rows, (k // buckets, k % buckets, left[a:b].tobytes(), right[a:b].tobytes(), n[a:b].tobytes())):
                        rows[name].append(value)
                yield pa.record_batch([pa.array(rows["i"], pa.int32()), pa.array(rows["j"], pa.int32()), *(pa.array(rows[c], pa.binary()) for c in "abn")], [*rows])

    return run


def _joined(column: Iterable, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in column])


def _summed(n: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sum of each."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    keys = tuple(k[order] for k in keys)
    head = heads(*keys)
    return *(k[head] for k in keys), np.add.reduceat(n[order], head) if len(head) else n


def _merged(group: pa.Table) -> pa.Table:
    left, right, n = _summed(_joined(group["n"], np.uint32).astype(np.int64), _joined(group["a"], np.uint64), _joined(group["b"], np.uint64))
    ids = [pa.array([group[c][0].as_py()], pa.int32()) for c in "ij"]
    return pa.table([*ids, *(pa.array([x.tobytes()], pa.binary()) for x in (left, right, n))], names=[*"ijabn"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with numbers of words in their buckets for their hashes."""
    for batch in batches:
        for r in range(len(batch)):
            get = lambda name, kind: np.frombuffer(batch.column(name)[r].as_buffer(), kind)  # noqa: B023, E731
            a = np.searchsorted(get("words", np.uint64), get("a", np.uint64)).astype(np.uint32)
            b = np.searchsorted(get("others", np.uint64), get("b", np.uint64)).astype(np.uint32)
            body = [small(np.diff(a, prepend=np.uint32(0))), small(b), small(get("n", np.int64))]
            yield pa.record_batch([batch.column("i").slice(r, 1), batch.column("j").slice(r, 1), pa.array([len(a)], pa.int64()), *(pa.array([x], pa.binary()) for x in body)], ["i", "j", "size", "a", "b", "n"])


def _labelled(batches: Iterator[pa.RecordBatch], kind) -> Iterator[tuple]:
    """(i, j, a, b, n, label of each a, label of each b) of blocks with the labels of their words."""
    for batch in batches:
        for r in range(len(batch)):
            i, j, size, a, b, n, left, right = (batch.column(c)[r] for c in ("i", "j", "size", "a", "b", "n", "left", "right"))
            size = size.as_py()
            a = np.cumsum(large(a.as_buffer(), np.uint32, size), dtype=np.int64)
            b, n = large(b.as_buffer(), np.uint32, size).astype(np.int64), large(n.as_buffer(), np.int64, size)
            yield i.as_py(), j.as_py(), a, b, n, *(np.frombuffer(x.as_buffer(), kind)[at].astype(np.int64) for x, at in ((left, a), (right, b)))


def _with_labels(blocks: DataFrame, labels: DataFrame, copied: bool) -> DataFrame:
    labels = F.broadcast(labels) if copied else labels
    left = labels.select("i", F.col("labels").alias("left"))
    return blocks.join(left, "i").join(labels.select(F.col("i").alias("j"), F.col("labels").alias("right")), "j")


def _label_pairs(size: int, kind) -> Callable:
    """Counts of neighbouring labels; words below 0 have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size * size, np.int64)
        for _, _, _, _, n, left, right in _labelled(batches, kind):
            both = (left >= 0) & (right >= 0)
            counts += np.bincount(left[both] * size + right[both], n[both], size * size).astype(np.int64)
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(seen), pa.array(counts[seen])], ["pair", "n"])

    return run


OUT, INTO, SELF, LABELS = range(4)
_NOTE = pa.schema([("i", pa.int32()), ("kind", pa.int32()), ("size", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])


def _in_turn(numbers: np.ndarray, turn: int) -> np.ndarray:
    """Words that may move in a turn; in ``TURNS`` turns each may once."""
    return mix(numbers.astype(np.uint64) + np.uint64(1)) % np.uint64(TURNS) == np.uint64(turn % TURNS)


def _profiles(turn: int) -> Callable:
    """Classes that follow (OUT) and precede (INTO) the words in turn, and which of them follow themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j, a, b, n, left, right in _labelled(batches, np.int8):
            notes = []
            for bucket, kind, word, other in ((i, OUT, a, right), (j, INTO, b, left)):
                may = np.flatnonzero(_in_turn(np.arange(word.max() + 1), turn)[word])
                notes.append((bucket, kind, *_summed(n[may], word[may] * TOTAL + other[may])))
            if i == j:
                own = a == b
                notes.append((i, SELF, a[own], n[own]))
            rows = [(i, kind, len(keys), small(np.diff(keys, prepend=0).astype(np.uint32)), small(n)) for i, kind, keys, n in notes if len(keys)]
            if rows:
                yield pa.record_batch([pa.array(column, type_) for column, type_ in zip(zip(*rows), _NOTE.types)], _NOTE.names)

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


@dataclass
class Profiles:
    """Words of a run with their classes, their neighbours' classes as entries and as tables, and counts of own repeats."""

    of: np.ndarray
    selves: np.ndarray
    entries: list  #: (word, class, n) that follow and precede; repeats of a word itself are left out
    tables: list  #: the same as tables

    @classmethod
    def read(cls, of: np.ndarray, selves: np.ndarray, sides: Iterable[tuple[np.ndarray, np.ndarray]]) -> Profiles:
        entries, tables = [], []
        for keys, n in sides:
            word, other = np.divmod(keys, TOTAL)
            n = n - np.where(other == of[word], selves[word], 0)
            entries.append((word, other, n.astype(float)))
            tables.append(np.bincount(keys, n, len(of) * TOTAL).reshape(-1, TOTAL))
        return cls(of, selves.astype(float), entries, tables)

    @property
    def totals(self) -> list[np.ndarray]:
        return [t.sum(1) + self.selves for t in self.tables]

    def nearest(self, pairs: np.ndarray, usable: np.ndarray) -> np.ndarray:
        """Classes that raise the likelihood most to first order."""
        logs = np.log(np.maximum(pairs, 0.5))
        right, left = (np.log(np.maximum(pairs.sum(side), 0.5)) for side in (1, 0))
        following, before = (t + s for t, s in zip(self.tables, self._own()))
        out, into = self.totals
        rough = following @ logs.T + before @ logs - out[:, None] * right - into[:, None] * left
        rough[:, ~usable] = -np.inf
        rough[np.arange(len(rough)), self.of] = -np.inf
        return np.argpartition(-rough, NEAREST, 1)[:, :NEAREST]

    def _own(self) -> list[np.ndarray]:
        own = np.zeros((len(self.of), TOTAL))
        own[np.arange(len(own)), self.of] = self.selves
        return [own, own]

    def value(self, pairs: np.ndarray, to: np.ndarray) -> np.ndarray:
        """By how much each word raises the likelihood of the table without it when it is in class ``to``."""
        every, stays = np.arange(len(self.of)), to == self.of
        gain = np.zeros(len(to))
        for side, (word, other, n) in enumerate(self.entries):
            there = to[word]
            now = pairs[there, other] if side == 0 else pairs[other, there]
            # The table without the word lacks it where it is now.
            now = now - np.where(stays[word], n, np.where(other == self.of[word], self.tables[1 - side][word, there], 0.0))
            gain += np.bincount(word, np.where(other == there, 0.0, _xlogx(now + n) - _xlogx(now)), len(to))
        corner = self.tables[0][every, to] + self.tables[1][every, to] + self.selves
        now = pairs[to, to] - np.where(stays, corner, 0.0)
        gain += _xlogx(now + corner) - _xlogx(now)
        for side, total in enumerate(self.totals):
            now = pairs.sum(1 - side)[to] - np.where(stays, total, 0.0)
            gain -= _xlogx(now + total) - _xlogx(now)
        return gain

    def move(self, pairs: np.ndarray, to: np.ndarray) -> None:
        """Change the table by the words that leave their class."""
        moved = np.flatnonzero(to != self.of)
        for classes, sign in ((self.of[moved], -1.0), (to[moved], 1.0)):
            member = sign * np.eye(TOTAL)[classes].T
            pairs += member @ self.tables[0][moved] + (member @ self.tables[1][moved]).T + np.diag(member @ self.selves[moved])


def _sweep(pairs: np.ndarray, turn: int) -> Callable:
    """Moves the words of a bucket that are in turn against the table of class pairs."""
    usable = pairs.sum(1) > 0
    usable[END_CLASS] = False

    def run(group: pa.Table) -> pa.Table:
        table, i = pairs.copy(), group["i"][0].as_py()
        kinds, parts = group["kind"].to_numpy(), [[], [], []]
        for r, kind in enumerate(kinds.tolist()):
            if kind == LABELS:
                labels = np.frombuffer(group["keys"][r].as_buffer(), np.int8).astype(np.int64)
                continue
            size = group["size"][r].as_py()
            parts[kind].append((np.cumsum(large(group["keys"][r].as_buffer(), np.uint32, size), dtype=np.int64), large(group["n"][r].as_buffer(), np.int64, size)))
        sides = [_summed(*(np.concatenate(x) for x in list(zip(*part))[::-1])) if part else (np.zeros(0, np.int64),) * 2 for part in parts]
        selves = np.bincount(sides[SELF][0], sides[SELF][1], len(labels))
        new, turns = labels.copy(), np.flatnonzero(_in_turn(np.arange(len(labels)), turn) & (labels != END_CLASS))
        for low in range(0, len(turns), CHUNK):
            at = turns[low : low + CHUNK]
            cut = []
            for keys, n in sides[:SELF]:
                a, b = np.searchsorted(keys, (at[0] * TOTAL, (at[-1] + 1) * TOTAL))
                word, other = np.divmod(keys[a:b], TOTAL)
                cut.append((np.searchsorted(at, word) * TOTAL + other, n[a:b]))
            words = Profiles.read(labels[at], selves[at], cut)
            best, most = words.of.copy(), words.value(table, words.of) + 1e-9
            for to in words.nearest(table, usable).T:
                value = words.value(table, to)
                better = (value > most) & usable[to]
                best, most = np.where(better, to, best), np.where(better, value, most)
            words.move(table, best)
            new[at] = best
        columns = [pa.array([i], pa.int32()), pa.array([new.astype(np.int8).tobytes()], pa.binary())]
        return pa.table(columns, names=["i", "labels"])

    return run


def likelihood(pairs: np.ndarray) -> float:
    """Of class pairs, save what depends on words alone."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(1)).sum() - _xlogx(pairs.sum(0)).sum())


def _labels(label: Callable, kind) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [label(*(np.frombuffer(batch.column(c)[r].as_buffer(), k) for c, k in (("words", np.uint64), ("forms", np.int8)))) for r in range(len(batch))]
            yield pa.record_batch([batch.column("i"), pa.array([x.astype(kind).tobytes() for x in of], pa.binary())], ["i", "labels"])

    return run


def word_classes(training: DataFrame, words: DataFrame, distinct: int, frequent: Lookup) -> tuple[DataFrame, np.ndarray]:
    """(word, n, class) of all words, and counts of class pairs.

    The exchange algorithm runs over every training word and all pairs of neighbours.
    Words are dealt into buckets by range of hash and pairs into blocks of two buckets, so a
    very frequent word is spread over as many blocks as there are buckets.  The most frequent
    words are first exchanged among themselves, all others begin in the class of their form.
    Then sweeps of ``TURNS`` turns go on: a turn sums for its words the classes before and behind
    them, and buckets move them against the table of class pairs, which is counted anew after
    each turn.  As buckets move words at a time, a turn can lower the likelihood; it is undone.
    Sweeps end when one raises the likelihood by less than ``GAIN`` a token.
    """
    buckets = max(1, -(-distinct // WORDS))
    bucket = F.shiftright(F.shiftrightunsigned("word", 32) * F.lit(buckets).cast("long"), 32).cast("int")
    table = stored(words.withColumn("i", bucket).groupBy("i").applyInArrow(_bucket, "i int, words binary, counts binary, forms binary"), "buckets")
    parts = training.mapInArrow(_neighbours(buckets), "i int, j int, a binary, b binary, n binary")
    merged = parts.groupBy("i", "j").applyInArrow(_merged, "i int, j int, a binary, b binary, n binary")
    known = table.select("i", "words")
    known, copied = F.broadcast(known) if distinct * 8 <= BROADCAST_BYTES else known, distinct * 2 <= BROADCAST_BYTES
    numbered = merged.join(known, "i").join(known.select(F.col("i").alias("j"), F.col("words").alias("others")), "j")
    blocks = stored(numbered.mapInArrow(_numbered, "i int, j int, size long, a binary, b binary, n binary"), "blocks")

    def number(words: np.ndarray, _forms: np.ndarray) -> np.ndarray:
        value, found = frequent.find(words)
        return np.where(found, value, -1)

    def count(labels: DataFrame, size: int, kind) -> np.ndarray:
        return _dense(_with_labels(blocks, labels, copied).mapInArrow(_label_pairs(size, kind), "pair long, n long"), size).astype(float)

    of = exchange(count(table.mapInArrow(_labels(number, np.int16), "i int, labels binary"), CLUSTERED, np.int16))

    def first(words: np.ndarray, forms: np.ndarray) -> np.ndarray:
        value, found = frequent.find(words)
        out = np.where(found, of[value], CLASSES + forms)
        out[words == END] = END_CLASS
        return out

    labels = stored(table.mapInArrow(_labels(first, np.int8), "i int, labels binary"), "classes")
    pairs = count(labels, TOTAL, np.int8)
    turn, since = 0, 0.0
    while pairs.any():
        notes = _with_labels(blocks, labels, copied).mapInArrow(_profiles(turn), "i int, kind int, size long, keys binary, n binary")
        own = labels.select("i", F.lit(LABELS).alias("kind"), F.lit(0).cast("long").alias("size"), F.col("labels").alias("keys"), F.lit(b"").alias("n"))
        moved = stored(notes.union(own).groupBy("i").applyInArrow(_sweep(pairs, turn), "i int, labels binary"), "classes")
        after = count(moved, TOTAL, np.int8)
        gain, turn = (likelihood(after) - likelihood(pairs)) / pairs.sum(), turn + 1
        if gain > 0:
            labels, pairs, since = moved, after, since + gain
        if turn % TURNS == 0:
            if since < GAIN:
                break
            since = 0.0

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                hashes, n, of = (np.frombuffer(batch.column(c)[r].as_buffer(), k) for c, k in (("words", np.int64), ("counts", np.int64), ("labels", np.int8)))
                yield pa.record_batch([pa.array(hashes), pa.array(n), pa.array(of.astype(np.int32))], ["word", "n", "class"])

    return stored(table.join(labels, "i").mapInArrow(words_of, "word long, n long, class int"), "classed"), pairs


def _score(head: Lookup, counts: np.ndarray, of: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Callable:
    """What is known of texts by the head alone; other words go on with the classes beside them, or in pairs."""

    def lists(text: np.ndarray, texts: int, *columns: np.ndarray, names: tuple[str, ...]) -> pa.ListArray:
        order = np.lexsort((*columns[::-1], text))
        head = heads(text[order], *(c[order] for c in columns))
        times = np.diff(np.append(head, len(order)))
        at = order[head]
        ends = np.concatenate(([0], np.cumsum(np.bincount(text[at], minlength=texts))))
        values = [pa.array(c[at].view(np.int64) if c.dtype == np.uint64 else c[at].astype(np.int32)) for c in columns]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([*values, pa.array(times.astype(np.int64))], [*names, "times"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(low, high - low)
                tokens = Tokens(part.column(1))
                place, known = head.find(tokens.hashes)
                logs, classes = np.zeros(len(place)), np.full(len(place), -1)
                logs[known], classes[known] = np.log10(counts[place[known]] + 1.0), of[place[known]]
                classes[tokens.is_end] = END_CLASS
                # Every text ends with an end, which thus stands before the next.
                before, behind = np.append(END_CLASS, classes[:-1]), np.append(classes[1:], END_CLASS)
                here = classes >= 0
                steps = np.where(here, -emit[classes], 0.0) + np.where(here & (before >= 0), move[before, classes], 0.0)
                per = lambda x: np.add.reduceat(x, tokens.first[:-1]) if len(part) else np.zeros(0)  # noqa: B023, E731
                rest, both = np.flatnonzero(~known), np.flatnonzero(~here & (before < 0))
                # The class of an end is known even where its count is not.
                end = tokens.is_end[rest]
                forms, left, right = (np.where(end, -1, x[rest]) for x in (tokens.forms, before, behind))
                single = lists(tokens.text[rest], len(part), tokens.hashes[rest], forms, left, right, names=("word", "form", "before", "behind"))
                pairs = lists(tokens.text[both], len(part), tokens.hashes[both - 1], tokens.hashes[both], tokens.forms[both - 1], tokens.forms[both], names=("word", "next", "form", "next_form"))
                columns = [part.column(0), part.column(2), part.column(3), pa.array(np.diff(tokens.first)), pa.array(per(known.astype(np.int64)).astype(np.int64)), pa.array(per(logs)), pa.array(per(steps)), single, pairs]
                yield pa.record_batch(columns, ["row", "id", "held_out", "n_tokens", "known", "logs", "steps", "rest", "both"])

    return run


def _of(batch: pa.RecordBatch, of: str, form: str) -> np.ndarray:
    """Classes of words; those no training text has belong to the class of their form."""
    of, form = batch.column(of), batch.column(form).to_numpy()
    return np.where(of.is_null().to_numpy(zero_copy_only=False), CLASSES + form, of.fill_null(0).to_numpy())


def _late(move: np.ndarray, emit: np.ndarray) -> Callable:
    """Counts and steps of words beyond the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times, form, before, behind = (batch.column(c).to_numpy() for c in ("times", "form", "before", "behind"))
            n, of = batch.column("n").fill_null(0).to_numpy(), _of(batch, "class", "form")
            steps = np.where(before >= 0, move[before, of], 0.0) + np.where(behind >= 0, move[of, behind], 0.0) - emit[of]
            steps = times * np.where(form >= 0, steps, 0.0)
            yield pa.record_batch([batch.column("row"), pa.array(np.where(n > 0, times, 0)), pa.array(times * np.log10(n + 1.0)), pa.array(steps)], ["row", "more", "logs", "steps"])

    return run


def _late_pairs(move: np.ndarray) -> Callable:
    """Steps from one word beyond the head to another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = batch.column("times").to_numpy() * move[_of(batch, "class", "form"), _of(batch, "next_class", "next_form")]
            yield pa.record_batch([batch.column("row"), pa.array(np.zeros(len(steps), np.int64)), pa.array(np.zeros(len(steps))), pa.array(steps)], ["row", "more", "logs", "steps"])

    return run


def class_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and class-model log10 probability of every text."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string").alias("text")
    training = docs.where(~held_out(F.col(id_col))).select(text)
    counted = training.mapInArrow(_count, "word long, n long, form int")
    words = stored(counted.groupBy("word").agg(F.sum("n").alias("n"), F.min("form").alias("form")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()

    def top(frame: DataFrame, limit: int) -> dict[str, np.ndarray]:
        """Most frequent words, in order of hash, with their rank."""
        got = frame.orderBy(F.desc("n"), "word").limit(limit).toArrow()
        columns = {c: got[c].to_numpy() for c in got.column_names} | {"rank": np.arange(len(got))}
        order = np.argsort(columns["word"].view(np.uint64))
        return {c: x[order] for c, x in columns.items()} | {"word": columns["word"].view(np.uint64)[order]}

    frequent = top(words.where(F.col("word") != int(END)).select("word", "n"), CLUSTERED)
    # What a sweep shuffles is not needed after it.
    with shuffles_removed(docs.sparkSession):
        classed, pairs = word_classes(training, words, distinct, Lookup(frequent["word"], frequent["rank"]))
    sizes = np.zeros(TOTAL)
    for r in classed.groupBy("class").agg(F.count("*").alias("n")).collect():
        sizes[r["class"]] = r["n"]
    move = np.log10((pairs + 1) / (pairs.sum(1, keepdims=True) + TOTAL))
    emit = np.log10(pairs.sum(0) + sizes + 1)
    most = top(classed, HEAD)
    head = Lookup(most["word"], np.arange(len(most["word"])))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), text, F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"))
    schema = f"""row long, id {kind}, held_out boolean, n_tokens long, known long, logs double, steps double,
        rest array<struct<word:long,form:int,before:int,behind:int,times:long>>,
        both array<struct<word:long,next:long,form:int,next_form:int,times:long>>"""
    scored = stored(rows.mapInArrow(_score(head, most["n"], most["class"], move, emit), schema), "scores")
    late = "row long, more long, logs double, steps double"
    rest = scored.select("row", F.explode("rest").alias("r")).select("row", "r.*").join(classed, "word", "left").mapInArrow(_late(move, emit), late)
    following = classed.select(F.col("word").alias("next"), F.col("class").alias("next_class"))
    both = scored.select("row", F.explode("both").alias("r")).select("row", "r.*").join(classed.drop("n"), "word", "left").join(following, "next", "left")
    found = rest.union(both.mapInArrow(_late_pairs(move), late)).groupBy("row").agg(
        F.sum("more").alias("more"), F.sum("logs").alias("more_logs"), F.sum("steps").alias("more_steps")
    )
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        (logs + F.col("steps") + F.coalesce("more_steps", F.lit(0.0))).alias("score"),
    )
