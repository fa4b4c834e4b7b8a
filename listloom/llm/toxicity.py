"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Inputs of a token are vectors of its word (if known), and of its characters: of all
runs of ``GRAM`` bytes of the whole word with its ends marked, hashed and averaged, and
of the ``EDGE`` bytes at either end.  Two
gated recurrent units read every window of ``WINDOW`` words, forth and back; attention
pools their states; a logistic unit scores the window.  Windows begin at every quarter
of a window and cover the whole text, and a text scores as its highest window.

Training, in numpy with gradients written out, uses at most ``SAMPLE`` labelled texts
of each label, of at most ``SAMPLE_CHARS`` characters, chosen by hash of the id.  Only
texts are labelled, so a toxic text stands by its most suspicious window: first by
the words' log odds, then, in later rounds, by these and the network.

Products of vectors and input weights are tables, and characters are summed up once for
each distinct word of a slice, so scoring a token costs two look-ups and one small
product.  One row stays one row: no shuffle but for the sample,
whose ids are copied to the executors.

Missing and empty texts have no window and get the network's score without evidence;
equal texts get equal scores; a missing id counts as an empty one when texts are held
out; labels that are missing are not used, of several for one id the highest counts;
without any the score is constant; an empty table gives an empty one; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listloom.llm.classlm import Lookup, held_out
from listloom.llm.packed import ramp
from listloom.llm.words import ALNUM, mix, slices, split_words, texts_of

WINDOW, STRIDE, GRAM, EDGE, LONG = 32, 8, 3, 5, 32
WIDTH, STATE, CHARS = 8, 8, 4096
SAMPLE, SAMPLE_CHARS, MIN_TEXTS = 1500, 6000, 3
SLICE_BYTES, WINDOWS = 2 << 20, 2048
F32 = np.float32
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


class Tokens:
    """Known-word number (0: unknown) and form of every token; a form is a distinct word with its runs of characters."""

    def __init__(self, column: pa.Array, vocabulary: Lookup | None = None):
        texts = texts_of(column)
        words = split_words(texts, ALNUM, lower=True)
        self.first, self.hashes = words.first, words.hashes
        _, at, self.form = np.unique(words.hashes, return_index=True, return_inverse=True)
        # Of every form its bytes with a mark before and behind, and the runs that begin in it.
        size = (words.ends - words.starts)[at] + 2
        begin = np.cumsum(size) - size
        bytes_ = np.ones(int(size.sum()) + EDGE, np.uint64)
        inside = np.repeat(begin + 1, size - 2) + ramp(size - 2)
        bytes_[inside] = _LOWER[texts.data[np.repeat(words.starts[at], size - 2) + ramp(size - 2)]] + np.uint64(2)
        runs = np.zeros(int(size.sum()), np.uint64)
        for k in range(GRAM):
            runs = runs * np.uint64(0x100000001B3) + bytes_[k : k + len(runs)]
        # A longer run at either end, too: of words of one stem or one ending.
        hashed = lambda at, salt: (mix(sum(bytes_[at + k] << np.uint64(9 * k) for k in range(EDGE)) + np.uint64(salt)) % np.uint64(CHARS)).astype(np.int64)
        self.edges = hashed(begin, 1 << 60), hashed(np.maximum(begin + size - EDGE, 0), 1 << 61)
        self.many = np.maximum(size - GRAM + 1, 1)
        chosen = np.repeat(begin, self.many) + ramp(self.many)
        self.runs = (mix(runs[chosen]) % np.uint64(CHARS)).astype(np.int64)
        self.word = np.zeros(len(words), np.int64)
        if vocabulary is not None:
            number, known = vocabulary.find(words.hashes)
            self.word = np.where(known, number, 0)

    def spelled(self, table: np.ndarray, forms: np.ndarray | None = None) -> np.ndarray:
        """Of each form, or of some, the mean of the rows of its runs."""
        many = self.many if forms is None else self.many[forms]
        begin = np.cumsum(self.many) - self.many
        begin = begin if forms is None else begin[forms]
        out = np.zeros((len(many), table.shape[1]), table.dtype)
        # Run by run of all words that have as many; what long words have beyond is summed up at once.
        left = np.arange(len(many))
        for k in range(LONG):
            left = left[many[left] > k]
            out[left] += np.take(table, self.runs[begin[left] + k], 0)
        for form in left[many[left] > LONG].tolist():
            low = begin[form]
            out[form] += table[self.runs[low + LONG : low + many[form]]].sum(0)
        return out / many[:, None].astype(table.dtype)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and text of all windows."""
        n = np.diff(self.first)
        many = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > 0).astype(np.int64))
        text = np.repeat(np.arange(len(n)), many)
        step = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        start = self.first[text] + step * STRIDE
        return start, np.minimum(WINDOW, self.first[text + 1] - start), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * (np.tanh(F32(0.5) * x) + F32(1))


class Network:
    """Weights, and what is computed with them."""

    def __init__(self, vocabulary: Lookup, odds: np.ndarray, seed: int = 9):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(F32)
        self.vocabulary = vocabulary
        self.w = {"word": draw(len(odds), WIDTH) * F32(0.3), "chars": draw(CHARS, WIDTH) * F32(0.3)}
        self.w |= {k: draw(CHARS, WIDTH) * F32(0.1) for k in ("begin", "end")}
        self.w["word"][:, 0] = odds
        for side in "fb":
            self.w |= {f"in_{side}": draw(WIDTH, 3 * STATE), f"state_{side}": draw(STATE, 3 * STATE), f"bias_{side}": np.zeros(3 * STATE, F32)}
        self.w |= {"attend": draw(2 * STATE, STATE), "query": draw(STATE), "out": draw(2 * STATE), "out_bias": np.full(1, -2, F32)}
        # A way for the words' odds to begin with: one unit of either side carries them to the end.
        for k, side in enumerate("fb"):
            self.w[f"in_{side}"][0, 2 * STATE] = 1.5
            self.w["attend"][k * STATE, 0], self.w["out"][k * STATE] = 1.5, 2
        self.w["query"][0] = 2
        self.tables: dict = {}

    def prepare(self) -> Network:
        """Products of word vectors and input weights, for scoring."""
        for side in "fb":
            self.tables[side] = self.w["word"] @ self.w[f"in_{side}"] + self.w[f"bias_{side}"]
        return self

    def _run(self, inputs: np.ndarray, mask: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """States after each step, in reading order of the text; inputs are (step, window, gates)."""
        steps, n = mask.shape
        weights = self.w[f"state_{side}"]
        h = np.zeros((n, STATE), F32)
        out = np.zeros((steps, n, STATE), F32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            moved = h @ weights
            given = inputs[t]
            gates = _sigmoid(given[:, : 2 * STATE] + moved[:, : 2 * STATE])
            z, r = gates[:, :STATE], gates[:, STATE:]
            new = np.tanh(given[:, 2 * STATE :] + r * moved[:, 2 * STATE :])
            m = mask[t][:, None]
            after = h + m * z * (new - h)
            if keep is not None:
                keep.append((t, h, z, r, new, moved[:, 2 * STATE :], m))
            h = after
            out[t] = h
        return out

    def _pool(self, states: np.ndarray, mask: np.ndarray):
        inner = np.tanh(states @ self.w["attend"])
        score = np.where(mask > 0, inner @ self.w["query"], F32(-1e9))
        share = np.exp(score - score.max(0, keepdims=True)) * mask
        share /= np.maximum(share.sum(0, keepdims=True), F32(1e-9))
        pooled = (share[:, :, None] * states).sum(0)
        return inner, share, pooled, pooled @ self.w["out"] + self.w["out_bias"]

    def _states(self, inputs: np.ndarray, at: np.ndarray, mask: np.ndarray, side: str, out: np.ndarray) -> None:
        """As :meth:`_run`, with windows in the last place, which numpy does in long strokes."""
        weights = np.ascontiguousarray(self.w[f"state_{side}"].T)
        steps, n = mask.shape
        h = np.zeros((STATE, n), F32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            given = np.ascontiguousarray(np.take(inputs, at[t], 0).T)
            moved = weights @ h
            gates = _sigmoid(given[: 2 * STATE] + moved[: 2 * STATE])
            new = np.tanh(given[2 * STATE :] + gates[STATE:] * moved[2 * STATE :])
            h = h + mask[t] * gates[:STATE] * (new - h)
            out[t] = h

    def _spelled(self, tokens: Tokens, forms: np.ndarray | None = None) -> np.ndarray:
        """Vectors of the characters of each form, or of some."""
        begin, end = tokens.edges if forms is None else (e[forms] for e in tokens.edges)
        return tokens.spelled(self.w["chars"], forms) + self.w["begin"][begin] + self.w["end"][end]

    def logits(self, tokens: Tokens, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Logit of each window."""
        out = np.zeros(len(start), F32)
        chars, inputs = self._spelled(tokens), {}
        for side, table in self.tables.items():
            inputs[side] = np.take(table, tokens.word, 0) + np.take(chars @ self.w[f"in_{side}"], tokens.form, 0)
        attend = np.ascontiguousarray(self.w["attend"].T)
        for low in range(0, len(start), WINDOWS):
            s, n = start[low : low + WINDOWS], length[low : low + WINDOWS]
            step = np.arange(int(n.max()))[:, None]
            at = np.minimum(s + step, len(tokens.word) - 1)
            mask = (step < n).astype(F32)
            states = np.empty((len(step), 2 * STATE, len(s)), F32)
            for k, side in enumerate("fb"):
                self._states(inputs[side], at, mask, side, states[:, k * STATE : (k + 1) * STATE])
            score = np.stack([self.w["query"] @ np.tanh(attend @ state) for state in states])
            score = np.where(mask > 0, score, F32(-1e9))
            share = np.exp(score - score.max(0)) * mask
            share /= np.maximum(share.sum(0), F32(1e-9))
            pooled = sum(p * state for p, state in zip(share, states))
            out[low : low + WINDOWS] = self.w["out"] @ pooled + self.w["out_bias"]
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        """Score of each text: that of its highest window."""
        best = np.full(len(column), self.w["out_bias"][0], F32)
        tokens = Tokens(column, self.vocabulary)
        start, length, text = tokens.windows()
        if len(start):
            logits = self.logits(tokens, start, length)
            highest = np.full(len(column), -np.inf, F32)
            np.maximum.at(highest, text, logits)
            best = np.where(np.isfinite(highest), highest, best)
        return 1 / (1 + np.exp(-best.astype(np.float64)))

    def slopes(self, tokens: Tokens, start: np.ndarray, length: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean log loss over some windows."""
        w, n = self.w, len(start)
        step = np.arange(WINDOW)[:, None]
        at = np.minimum(start + step, len(tokens.word) - 1)
        mask = (step < length).astype(F32)
        word = tokens.word[at]
        met, form = np.unique(tokens.form[at], return_inverse=True)
        form = form.reshape(at.shape)
        x = w["word"][word] + self._spelled(tokens, met)[form]
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(x @ w[f"in_{s}"] + w[f"bias_{s}"], mask, s, kept[s]) for s in "fb"], 2)
        inner, share, pooled, logit = self._pool(states, mask)
        g: dict[str, np.ndarray] = {}
        d = ((_sigmoid(logit) - target) / F32(n)).astype(F32)
        g["out"], g["out_bias"] = pooled.T @ d, d.sum(keepdims=True)
        d_pooled = d[:, None] * w["out"]
        d_states = share[:, :, None] * d_pooled
        d_share = (states * d_pooled).sum(2)
        d_score = share * (d_share - (share * d_share).sum(0, keepdims=True))
        g["query"] = (inner * d_score[:, :, None]).sum((0, 1))
        d_inner = d_score[:, :, None] * w["query"] * (1 - inner**2)
        g["attend"] = np.tensordot(states, d_inner, ((0, 1), (0, 1)))
        d_states = d_states + d_inner @ w["attend"].T
        d_x = np.zeros_like(x)
        for k, side in enumerate("fb"):
            d_out = d_states[:, :, k * STATE : (k + 1) * STATE]
            d_h, d_weights = np.zeros((n, STATE), F32), np.zeros_like(w[f"state_{side}"])
            d_in = np.zeros((WINDOW, n, 3 * STATE), F32)
            for t, h, z, r, new, moved, m in reversed(kept[side]):
                d_h = d_h + d_out[t]
                d_new = d_h * m * z * (1 - new**2)
                d_z = d_h * m * (new - h) * z * (1 - z)
                d_r = d_new * moved * r * (1 - r)
                to_state = np.concatenate((d_z, d_r, d_new * r), 1)
                d_in[t] = np.concatenate((d_z, d_r, d_new), 1)
                d_weights += h.T @ to_state
                d_h = d_h * (1 - m * z) + to_state @ w[f"state_{side}"].T
            g[f"state_{side}"], g[f"bias_{side}"] = d_weights, d_in.sum((0, 1))
            g[f"in_{side}"] = np.tensordot(x, d_in, ((0, 1), (0, 1)))
            d_x += d_in @ w[f"in_{side}"].T
        d_x *= mask[:, :, None]
        g["word"], g["chars"] = np.zeros_like(w["word"]), np.zeros_like(w["chars"])
        d_x = d_x.reshape(-1, WIDTH)
        np.add.at(g["word"], word.ravel(), d_x)
        d_form = np.zeros((len(met), WIDTH), d_x.dtype)
        np.add.at(d_form, form.ravel(), d_x)
        for key, edge in zip(("begin", "end"), tokens.edges):
            g[key] = np.zeros_like(w[key])
            np.add.at(g[key], edge[met], d_form)
        begin, many = (np.cumsum(tokens.many) - tokens.many)[met], tokens.many[met]
        runs = tokens.runs[np.repeat(begin, many) + ramp(many)]
        np.add.at(g["chars"], runs, np.repeat(d_form / many[:, None].astype(d_x.dtype), many, axis=0))
        return g


def fit(texts: list[str], labels: list[int], rounds: int = 3, steps: int = 60, batch: int = 256, rate: float = 0.02) -> Network:
    """Train on labelled texts; see the module's text for how windows are chosen."""
    column, label = pa.array(texts, pa.string()), np.array(labels, bool)
    tokens = Tokens(column)
    text = np.repeat(np.arange(len(texts)), np.diff(tokens.first))
    pairs = np.unique(np.stack((tokens.hashes, text.astype(np.uint64))), axis=1) if len(text) else np.zeros((2, 0), np.uint64)
    words, at, count = np.unique(pairs[0], return_inverse=True, return_counts=True)
    toxic = np.bincount(at, label[pairs[1].astype(np.int64)] if len(at) else None, len(words))
    use = count >= MIN_TEXTS
    t, c = toxic[use] + 0.5, (count - toxic)[use] + 0.5
    odds = np.log(t / (label.sum() + 1)) - np.log(c / ((~label).sum() + 1))
    odds *= np.minimum(1, count[use] / 10)
    vocabulary = Lookup(words[use], np.arange(1, use.sum() + 1))
    network = Network(vocabulary, np.concatenate(([0], odds)).astype(F32) / F32(2))
    if not label.any() or label.all() or not len(text):
        return network.prepare()
    tokens = Tokens(column, vocabulary)
    start, length, owner = tokens.windows()
    rng = np.random.default_rng(3)
    total = np.concatenate(([0], np.cumsum(np.maximum(network.w["word"][tokens.word, 0], 0))))
    suspicion = odds_of = total[start + length] - total[start]
    first, second = ({k: np.zeros_like(v) for k, v in network.w.items()} for _ in range(2))
    taken = 0
    for turn in range(rounds):
        if turn:
            suspicion = odds_of + network.prepare().logits(tokens, start, length)
        order = np.lexsort((-suspicion, owner))
        top = order[np.concatenate(([True], owner[order][1:] != owner[order][:-1]))]
        positive, hard = top[label[owner[top]]], top[~label[owner[top]]]
        plain = np.flatnonzero(~label[owner])
        for _ in range(steps):
            some = np.concatenate((rng.choice(positive, batch // 2), rng.choice(hard, batch // 4), rng.choice(plain, batch // 4)))
            g = network.slopes(tokens, start[some], length[some], label[owner[some]].astype(F32))
            taken += 1
            for k, w in network.w.items():
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                w -= (rate * (1.05 - taken / (rounds * steps)) * (first[k] / (1 - 0.9**taken)) / (np.sqrt(second[k] / (1 - 0.99**taken)) + 1e-6)).astype(F32)
    return network.prepare()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Network:
    """Fit on labelled rows outside the held-out fold."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col), 5, 0))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    ids = None
    for value in (1, 0):
        some = known.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(sample)
        ids = some if ids is None else ids.union(some)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(ids), "id")  # at most two samples of ids
    got = rows.select("text", "label", F.xxhash64("text").alias("order")).orderBy("order", "text").limit(4 * sample).collect()
    unique = {r["text"]: r["label"] for r in got}
    return fit(list(unique), list(unique.values()))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", network: Network | None = None) -> DataFrame:
    """Score and prediction of every text."""
    network = network or train(docs, labels, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(2), SLICE_BYTES):
                part = batch.slice(low, high - low)
                scores = network.scores(part.column(2))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    frame = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col), 5, 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return frame.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
