"""Secret scan by a linear-chain conditional random field, beside fixed patterns.

Tokens are blank-separated words, tagged as secret begin (B), inside (I) or outside
(O).  A token's class is made of its shape (letters of either case, digits, symbols),
length and whether it names a secret; features are its own class, those of both
neighbours, and the file's share of secret-naming words.  Weights are fitted by
maximum likelihood (numpy, Adam) on at most ``SAMPLE`` windows around matches of the
fixed patterns and as many without; matches are used again with other values and the separator in words, which
is what lets the field find secrets the patterns miss.

Decoding is Viterbi.  A token whose outside score leads by more than the transitions
beside it can make good is outside on the best path, so the search runs, exactly and
for many runs at a time, over what lies between such tokens.

Spans of the patterns always stay; of those of the field, what no pattern covers is
added, but for rests of nothing but quotes, brackets and stops, and for words after a
closing quote.
Missing and empty texts have no spans; equal rows get equal spans; an empty table gives
an empty one; other columns are ignored by the report and kept when masking.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listloom.llm.words import CONTINUATION, SPACED, Texts, byte_table, slices, split_words, texts_of

# The patterns, and the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
MIN_LENGTH = {"assign": 6, "access": 20, "hex": 24}

# Words that name a secret, and what stands between name and value.
NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey", b"credential", b"private_key")
BETWEEN = ("is", "->", "=>", "was", "equals", "is:", "reads")

SAMPLE, WINDOW_CHARS, SIDE = 400, 400, 12
SLICE_BYTES = 4 << 20
_HEX_ONLY = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: What may enclose or follow a value without being part of it.
ENCLOSING = " \t\n\x0b\x0c\r\"'`()[]{}<>,;:."
LETTER = re.compile(r"[^\W_]")
SHAPES, LENGTHS = 16, 5
CLASSES = SHAPES * LENGTHS * 2 + 1  # the last stands beyond the ends of a text
O, B, I = range(3)  # noqa: E741


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, by start, then kind."""
    spans = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_LENGTH["assign"]]
    spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_LENGTH["access"]]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_LENGTH["hex"]]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def _places(data: bytes, needle: bytes) -> list[int]:
    out, at = [], data.find(needle)
    while at >= 0:
        out.append(at)
        at = data.find(needle, at + len(needle))
    return out


def _inside(at: list[int], offsets: np.ndarray) -> set[int]:
    return set((np.searchsorted(offsets, np.array(at, np.int64), "right") - 1).tolist()) if at else set()


def may_match(data: bytes, offsets: np.ndarray) -> set[int]:
    """Texts in which a fixed pattern can match at all; found by plain byte search.

    A byte between texts keeps what is found from reaching into the next one.
    """
    ends = offsets.tolist()
    data = b"\n".join(data[a:b] for a, b in zip(ends, ends[1:]))
    lower, offsets = data.translate(_LOWER), offsets + np.arange(len(offsets))
    out: set[int] = set()
    for needle in (b"passw", b"secret", b"token", b"api"):
        out |= _inside(_places(lower, needle), offsets)
    return out | _inside(_places(data, b"AKIA"), offsets) | _inside(_places(data.translate(_HEX_ONLY), b"x" * MIN_LENGTH["hex"]), offsets)


def token_classes(texts: Texts, data: bytes, lower: bytes):
    """Words, class of each, and file feature of each text (0 to 2)."""
    words = split_words(texts, SPACED)
    raw = texts.data

    def has(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(table[raw], out=total[1:])
        return total[words.ends] - total[words.starts]

    digits, upper, small = (has(byte_table(r)) for r in ((48, 57), (65, 90), (97, 122)))
    size = words.ends - words.starts
    shape = (digits > 0) + 2 * (upper > 0) + 4 * (small > 0) + 8 * (digits + upper + small < size)
    bucket = np.digitize(size, (4, 8, 16, 32))
    named = np.zeros(len(words), bool)
    for name in NAMES:
        at = np.array(_places(lower, name), np.int64)
        if len(at):
            held = np.searchsorted(words.starts, at, "right") - 1
            named[held[at + len(name) <= words.ends[held]]] = True
    classes = (shape * LENGTHS + bucket) * 2 + named
    total = np.concatenate(([0], np.cumsum(named)))[words.first]
    file = np.minimum(np.diff(total), 2)
    return words, classes.astype(np.int64), file


@dataclass
class Field:
    """Weights of the conditional random field."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    file: np.ndarray
    move: np.ndarray

    def scores(self, words, classes: np.ndarray, file: np.ndarray) -> np.ndarray:
        n = len(classes)
        text = words.text
        previous, following = np.full(n, CLASSES - 1), np.full(n, CLASSES - 1)
        same = text[1:] == text[:-1]
        previous[1:][same] = classes[:-1][same]
        following[:-1][same] = classes[1:][same]
        return self.own[classes] + self.before[previous] + self.after[following] + self.file[file[text]]

    def tags(self, words, classes: np.ndarray, file: np.ndarray) -> np.ndarray:
        """Best tags, by Viterbi between tokens that are outside for certain."""
        scores = self.scores(words, classes, file)
        tags = np.zeros(len(classes), np.int8)
        move = self.move
        # What tag s instead of O can gain from the transitions on both sides.
        gain = (move - move[:, :1]).max(0) + (move - move[:1]).max(1)
        edge = np.maximum(0, np.maximum((move - move[:, :1]).max(0), (move - move[:1]).max(1)))
        gain = np.maximum(gain, edge)
        open_ = np.flatnonzero((scores[:, B] + gain[B] >= scores[:, O]) | (scores[:, I] + gain[I] >= scores[:, O]))
        if not len(open_):
            return tags
        # Runs of tokens in doubt, longest first; a step takes the next token of every run.
        text = words.text
        begins = np.concatenate(([0], np.flatnonzero((np.diff(open_) > 1) | (np.diff(text[open_]) > 0)) + 1))
        sizes = np.diff(np.append(begins, len(open_)))
        order = np.argsort(-sizes, kind="stable")
        start, sizes = open_[begins[order]], sizes[order]
        last = start + sizes - 1
        at_first = start == words.first[text[start]]
        at_last = last + 1 == words.first[text[last] + 1]
        best = scores[start] + np.where(at_first[:, None], 0, move[O])
        pointers = np.zeros((len(classes), 3), np.int8)
        alive = [len(sizes)]
        for k in range(1, int(sizes[0])):
            n = int(np.searchsorted(-sizes, -k, "left"))
            alive.append(n)
            step = best[:n, :, None] + move
            pointers[start[:n] + k] = step.argmax(1)
            best[:n] = step.max(1) + scores[start[:n] + k]
        tag = (best + np.where(at_last[:, None], 0, move[:, O])).argmax(1)
        tags[last] = tag
        for k in range(int(sizes[0]) - 1, 0, -1):
            n = alive[k]
            tag[:n] = pointers[start[:n] + k, tag[:n]]
            tags[start[:n] + k - 1] = tag[:n]
        return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def fit(texts: list[str], steps: int = 80, rate: float = 0.2, decay: float = 2e-3) -> Field:
    """Fit on texts tagged by the fixed patterns: the words of a match are B, then I."""
    rng = np.random.default_rng(5)
    whole = list(texts)
    for text in texts:  # the same, with the separator in words
        spans = [m for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_LENGTH["assign"]]
        if spans:
            m = spans[0]
            # And without any value: the name alone is no secret.
            between = BETWEEN[rng.integers(len(BETWEEN))] if rng.random() < 0.5 else ""
            whole.append(text[: m.end(1)] + f" {between} ".replace("  ", " ") + text[m.end() :].lstrip("\"' "))
            letters = ("abcdef0123456789", "ABCDEF0123456789", "abcdefghijkABCDEFGHIJK0123456789", "ABCDEFGH+/=0123456789")[rng.integers(4)]
            value = "".join(letters[i] for i in rng.integers(len(letters), size=rng.integers(12, 48)))
            value = value if rng.random() < 0.5 else f'"{value}"'
            whole.append((text[: m.end(1)] + f" {BETWEEN[rng.integers(len(BETWEEN))]} " + value + " " + text[m.end() :].lstrip("\"'"), m.start()))
    sequences = []
    for item in whole:
        text, planted = item if isinstance(item, tuple) else (item, None)
        raw = text.encode()
        data = Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        words, classes, file = token_classes(data, raw, raw.translate(_LOWER))
        if not len(words):
            continue
        spans = [(a, b) for a, b, k in pattern_spans(text) if k < 2]
        if planted is not None:
            value = re.compile(r"\S+\s+\S+\s+\S+").match(text, planted)
            spans = [(a, b) for a, b in spans if b <= planted or a > value.end()] + [(planted, value.end())]
        spans += [(a, b) for a, b, k in pattern_spans(text) if k == 2 and not any(x < b and a < y for x, y in spans)]
        tags, owner = np.zeros(len(words), int), np.full(len(words), -1)
        at = np.concatenate(([0], np.cumsum(~CONTINUATION[data.data])))
        low, high = at[words.starts], at[words.ends]
        for k, (a, b) in enumerate(sorted(spans)):
            held = np.flatnonzero((low < b) & (high > a))
            owner[held] = k
            tags[held] = I
            tags[held[:1]] = B
        middle = int(np.flatnonzero(tags)[0]) if tags.any() else 0
        begin = max(0, middle - SIDE)
        cut = slice(begin, begin + 2 * SIDE)
        edge = np.full(1, CLASSES - 1)
        before, after = np.concatenate((edge, classes[:-1])), np.concatenate((classes[1:], edge))
        sequences.append((classes[cut], before[cut], after[cut], tags[cut], int(file[0])))
    shapes = {"own": (CLASSES, 3), "before": (CLASSES, 3), "after": (CLASSES, 3), "file": (3, 3), "move": (3, 3)}
    weights = {k: np.zeros(s) for k, s in shapes.items()}
    weights["own"][:, O] = 1.0  # what was never seen is outside
    if not sequences:
        return Field(**weights)
    n, length = len(sequences), max(len(s[0]) for s in sequences)
    own, before, after, tags = (np.full((n, length), fill) for fill in (CLASSES - 1,) * 3 + (0,))
    mask = np.zeros((n, length), bool)
    for i, (a, b, c, t, _) in enumerate(sequences):
        own[i, : len(a)], before[i, : len(a)], after[i, : len(a)], tags[i, : len(a)] = a, b, c, t
        mask[i, : len(a)] = True
    file = np.array([s[4] for s in sequences])
    start = {k: w.copy() for k, w in weights.items()}
    first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    rows = np.arange(n)
    for step in range(1, steps + 1):
        move = weights["move"]
        scores = weights["own"][own] + weights["before"][before] + weights["after"][after] + weights["file"][file][:, None]
        forward, backward = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        forward[:, 0] = scores[:, 0]
        for t in range(1, length):
            new = _log_sum(forward[:, t - 1, :, None] + move, 1) + scores[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            new = _log_sum(move + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0)
        norm = _log_sum(forward[:, -1], 1)
        delta = np.exp(forward + backward - norm[:, None, None])
        delta[rows[:, None], np.arange(length), tags] -= 1
        delta *= mask[:, :, None]
        slope = {k: np.zeros(s) for k, s in shapes.items()}
        for key, index in (("own", own), ("before", before), ("after", after)):
            np.add.at(slope[key], index, delta)
        np.add.at(slope["file"], file, delta.sum(1))
        pair = np.exp(forward[:, :-1, :, None] + move + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - norm[:, None, None, None])
        slope["move"] = (pair * mask[:, 1:, None, None]).sum((0, 1))
        np.subtract.at(slope["move"], (tags[:, :-1][mask[:, 1:]], tags[:, 1:][mask[:, 1:]]), 1)
        for k, w in weights.items():
            g = slope[k] / n + (5 if k == "move" else 1) * decay * (w - start[k])
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Field(**weights)


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Field:
    """Fit on windows of at most ``sample`` texts with a match and as many without, chosen by hash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    pattern = r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]{6}"""
    low = F.lower(text)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    at = F.when(named, F.regexp_instr(text, F.lit(pattern))).otherwise(0)
    seen = docs.select(text.alias("text"), at.alias("at"))
    cut = seen.select(
        F.substring(F.col("text"), F.greatest(F.lit(1), F.col("at") - WINDOW_CHARS), F.lit(2 * WINDOW_CHARS)).alias("cut"), (F.col("at") > 0).alias("hit")
    ).select("cut", "hit", F.xxhash64("cut").alias("order"))
    picked = [r["cut"] for hit in (True, False) for r in cut.where(F.col("hit") == hit).orderBy("order", "cut").limit(sample).collect()]
    return fit(picked)


def uncovered(text: str, start: int, end: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the fixed patterns leave of a span of the field; the whole span where they touch it nowhere.

    A value in quotes ends with the word of its closing quote; of that, what holds no
    letter or digit is no part of a secret.
    """
    inside = sorted((s, e) for s, e, k in spans if k < 3 and s < end and start < e)
    if not inside:
        return [(start, end, 3)]
    out, at, closed = [], start, False
    for s, e in [*inside, (end, end)]:
        piece = text[at:s]
        if closed:
            piece = re.match(r"\S*", piece)[0]
        if piece.strip(ENCLOSING) and (LETTER.search(piece) or piece[0] not in "\"'"):
            out.append((at + len(piece) - len(piece.lstrip()), at + len(piece.rstrip()), 3))
        if e >= at:
            value = m.start(2) if (m := ASSIGN.match(text, s)) else s
            closed = (closed and e == at) or (text[e : e + 1] in ('"', "'") and text[value - 1 : value] == text[e])
            at = e
    return out


def scan(texts: Texts, field: Field) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind) in code points of every text, by start, then kind."""
    data = texts.data.tobytes()
    lower = data.translate(_LOWER)
    offsets = texts.offsets
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    plain = [data[offsets[i] : offsets[i + 1]].decode() if i in some else None for some in [may_match(data, offsets)] for i in range(len(texts))]
    for i, text in enumerate(plain):
        if text is not None:
            out[i] = pattern_spans(text)
    words, classes, file = token_classes(texts, data, lower)
    tags = field.tags(words, classes, file)
    tagged = np.flatnonzero(tags)
    if len(tagged):
        text = words.text
        # A span begins at B, or at I after something else.
        begins = np.ones(len(tagged), bool)
        begins[1:] = (tags[tagged[1:]] == B) | (np.diff(tagged) > 1) | (np.diff(text[tagged]) > 0)
        heads = np.flatnonzero(begins)
        for a, b in zip(tagged[heads].tolist(), tagged[np.append(heads[1:], len(tagged)) - 1].tolist()):
            if not LETTER.search(data[words.starts[a] : words.ends[b]].decode()):
                continue
            i = int(text[a])
            base = int(offsets[i])
            chars = lambda end: int((~CONTINUATION[texts.data[base:end]]).sum())  # noqa: B023, E731
            start = chars(int(words.starts[a]))
            end = start + int((~CONTINUATION[texts.data[words.starts[a] : words.ends[b]]]).sum())
            out[i] += uncovered(plain[i] or "", start, end, out[i])
        for i in set(text[tagged].tolist()):
            out[i].sort(key=lambda s: (s[0], s[2]))
    return out


def _digest_form(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """Counts of the patterns, digest of their spans, and all spans, per text."""
    field = field or train(docs, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1), SLICE_BYTES):
                found = scan(texts_of(batch.column(1).slice(low, high - low)), field)
                fixed = [[s for s in spans if s[2] < 3] for spans in found]
                counts = [pa.array([sum(s[2] == k for s in spans) for spans in fixed], pa.int64()) for k in range(3)]
                digests = pa.array([hashlib.sha256(_digest_form(s).encode()).hexdigest() for s in fixed], pa.string())
                spans = pa.array([_digest_form(s) for s in found], pa.string())
                columns = [batch.column(0).slice(low, high - low), *counts, digests, spans]
                yield pa.record_batch(columns, ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = frame.mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str = "[secret]") -> str:
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", field: Field | None = None) -> DataFrame:
    """The same rows with secrets in the text replaced, and the length column, if any, brought up to date."""
    field = field or train(docs, text_col)
    place = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(place), SLICE_BYTES):
                part = batch.slice(low, high - low)
                found = scan(texts_of(part.column(place)), field)
                texts = part.column(place).to_pylist()
                new = [masked(t, s) if t and s else t for t, s in zip(texts, found)]
                columns = part.columns
                columns[place] = pa.array(new, part.schema.field(place).type)
                if length is not None:
                    old = part.column(length).to_pylist()
                    columns[length] = pa.array([len(n) if s else o for n, s, o in zip(new, found, old)], part.schema.field(length).type)
                yield pa.record_batch(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
