"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A word's input is the sum of its own vector and of the vectors of its character n-grams, so inflected forms of a
toxic stem share its parts. Two gated recurrent layers read a window of words forwards and backwards, attention weighs
their states, and a logistic output scores the window. All overlapping windows of a whole text are scored; the text's
score is that of its worst window. The network is written and trained in numpy.

Training reads a bounded sample: up to `Fit.rows` labelled documents, two fifths of them toxic where there are enough,
taken in order of a hash of their id; of several texts with one id the first in byte order. Of the words and n-grams that
`Fit.min_docs` of its documents hold, the `Fit.most_words` and `Fit.most_grams` that most hold get vectors (None: all); what has no vector of
its own still counts by its n-grams. Documents have labels, windows have not: each epoch a toxic document teaches by its currently worst window,
a clean one by its worst and some random ones. Word and n-gram vectors start with how far their documents are toxic. Only what words and characters say enters a score.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A null or empty text is one empty window and gets the score of that.
Labels with null ids or labels are not used; of several labels of an id the largest counts. Without any training rows, or with one
label only, the network stays untrained and its scores are the bias's. Repeated rows are scored one by one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import trim, trimmed, whole_rows
from .text import ALNUM, Words, mix, slices, split


@dataclass(frozen=True)
class Fit:
    rows: int = 4000
    window: int = 48
    step: int = 36
    inputs: int = 12
    hidden: int = 8
    epochs: int = 6
    least_steps: int = 240
    batch: int = 256
    rate: float = 0.01
    min_docs: int = 3
    most_words: int | None = 1 << 17
    most_grams: int | None = 1 << 18
    seed: int = 7


@dataclass
class Model:
    fit: Fit
    words: np.ndarray
    word_vectors: np.ndarray
    grams: np.ndarray
    gram_vectors: np.ndarray
    weights: dict[str, np.ndarray]


def char_grams(words: Words, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 3- to 5-byte parts of the chosen words, word ends marked, and which of the chosen each is of."""
    size = words.end[index] - words.start[index] + 2
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.full(at[-1], ord("|"), dtype=np.uint64)
    owner = np.repeat(np.arange(len(index)), size)
    place = np.arange(at[-1]) - at[:-1][owner]
    inner = (place > 0) & (place < size[owner] - 1)
    flat[inner] = words.data[(words.start[index][owner] + place - 1)[inner]]
    hashes, owners = [], []
    for n in (3, 4, 5):
        if len(flat) < n:
            continue
        g = np.zeros(len(flat) - n + 1, np.uint64)
        for j in range(n):
            g = (g << np.uint64(8)) | flat[j : len(flat) - n + 1 + j]
        ok = np.flatnonzero(owner[: len(g)] == owner[n - 1 :])
        hashes.append(mix(g[ok] + (np.uint64(n) << np.uint64(56))))
        owners.append(owner[ok])
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted in sorted keys; len(keys) where absent."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, len(keys))


def _windows(rows: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and length of all overlapping windows; a row without words has one of length 0."""
    n = np.diff(rows)
    count = np.maximum(1, 1 + -(-(n - size) // step))
    row = np.repeat(np.arange(len(n)), count)
    first = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * step
    return row, rows[:-1][row] + first, np.minimum(n[row] - first, size)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(w: dict, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict]:
    """Window probabilities from gate inputs x (time, window, direction, 3 hidden); mask (time, window)."""
    steps, n, _, h3 = x.shape
    h = h3 // 3
    state = np.zeros((2, steps, n, h), np.float32)
    saved: dict = {"gates": []}
    for d in (0, 1):
        now = np.zeros((n, h), np.float32)
        order = range(steps) if d == 0 else range(steps - 1, -1, -1)
        trail = []
        u, b = w["u"][d], w["b"][d]
        for t in order:
            m = mask[t][:, None]
            xt = x[t, :, d]
            r_in = now @ u
            rz = _sigmoid(xt[:, : 2 * h] + r_in[:, : 2 * h] + b[: 2 * h])
            r, z = rz[:, :h], rz[:, h:]
            rec = r_in[:, 2 * h :] + b[2 * h :]
            c = np.tanh(xt[:, 2 * h :] + r * rec)
            new = np.where(m, (1 - z) * c + z * now, now)
            trail.append((t, now, r, z, rec, c))
            now = new
            state[d, t] = now
        saved["gates"].append(trail)
    both = np.concatenate([state[0], state[1]], axis=2)
    a = np.tanh(both @ w["wa"])
    e = np.where(mask, a @ w["va"], -1e9)
    e -= e.max(axis=0)
    alpha = np.exp(e)
    alpha /= alpha.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", alpha, both)
    p = _sigmoid(pooled @ w["wo"] + w["bo"])
    saved.update(both=both, a=a, alpha=alpha, pooled=pooled)
    return p, saved


def _backward(w: dict, s: dict, mask: np.ndarray, dout: np.ndarray, x_shape: tuple) -> tuple[dict, np.ndarray]:
    """Gradients of the weights and of the gate inputs, given that of the output's logit."""
    steps, n, _, h3 = x_shape
    h = h3 // 3
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["wo"], g["bo"] = s["pooled"].T @ dout, np.array(dout.sum(), np.float32)
    dpool = dout[:, None] * w["wo"]
    dboth = s["alpha"][:, :, None] * dpool
    dalpha = np.einsum("nh,tnh->tn", dpool, s["both"])
    de = s["alpha"] * (dalpha - (s["alpha"] * dalpha).sum(axis=0))
    g["va"] = np.einsum("tn,tnk->k", de, s["a"])
    da = de[:, :, None] * w["va"] * (1 - s["a"] ** 2)
    g["wa"] = np.einsum("tnh,tnk->hk", s["both"], da)
    dboth = dboth + da @ w["wa"].T
    dx = np.zeros(x_shape, np.float32)
    for d in (0, 1):
        dh = np.zeros((n, h), np.float32)
        u = w["u"][d]
        for t, before, r, z, rec, c in reversed(s["gates"][d]):
            m = mask[t][:, None]
            dh = dh + dboth[t, :, d * h : (d + 1) * h]
            dn = np.where(m, dh, 0)
            dz = dn * (before - c) * z * (1 - z)
            dc = dn * (1 - z) * (1 - c**2)
            dr = dc * rec * r * (1 - r)
            dxt = np.concatenate([dr, dz, dc], axis=1)
            drec = np.concatenate([dr, dz, dc * r], axis=1)
            dx[t, :, d] = dxt
            g["u"][d] += before.T @ drec
            g["b"][d] += drec.sum(axis=0)
            dh = np.where(m, dn * z, dh) + drec @ u.T
    return g, dx


def _start(fit: Fit, rng: np.random.Generator) -> dict[str, np.ndarray]:
    h, i = fit.hidden, fit.inputs
    make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else shape[0])).astype(np.float32)
    return {"wx": make(i, 6 * h), "u": make(2, h, 3 * h), "b": np.zeros((2, 3 * h), np.float32), "wa": make(2 * h, h), "va": make(h), "wo": make(2 * h), "bo": np.array(-1.0, np.float32)}


def _grouped(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct owners (owner is sorted), the sums and the counts of their rows."""
    new = np.flatnonzero(np.diff(owner, prepend=-1))
    return owner[new], np.add.reduceat(values, new, axis=0), np.diff(np.append(new, len(owner)))[:, None].astype(np.float32)


def _inputs(model: Model, word: np.ndarray, gram: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Input vectors of distinct words: own vector and the mean of those of known character n-grams, sorted by owner."""
    x = model.word_vectors[word]
    if len(owner):
        whose, total, n = _grouped(model.gram_vectors[gram], owner)
        x[whose] += total / n
    return x


def _scatter(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by place."""
    return np.stack([np.bincount(at, weights=values[:, j], minlength=n) for j in range(values.shape[1])], axis=1).astype(np.float32)


class Features:
    """The distinct words of some texts, by number; number 0 stands beyond a window's end."""

    def __init__(self, column: pa.Array) -> None:
        self.words = split(column, ALNUM)
        self.keys, self.first, inverse = np.unique(self.words.hashes(), return_index=True, return_inverse=True)
        self.inverse = (inverse + 1).astype(np.int32)

    def grams(self, words: int = 8_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Character n-grams of the distinct words and the words' numbers from 0, some words at a time, in their order."""
        for i in range(0, len(self.first), words):
            gram, owner = char_grams(self.words, self.first[i : i + words])
            order = np.argsort(owner, kind="stable")
            yield gram[order], owner[order] + i

    def known_grams(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in sorted keys of the n-grams that are there, and their words, in the words' order."""
        found = [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
        for gram, owner in self.grams():
            at = _find(keys, gram)
            found.append((at[at < len(keys)].astype(np.int32), owner[at < len(keys)].astype(np.int32)))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def window(self, first: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        at = first + np.arange(length)[:, None]
        mask = np.arange(length)[:, None] < size
        numbers = np.append(self.inverse, 0)[np.where(mask, at, len(self.inverse))]
        mask[0] |= size == 0  # an empty window is one step without input
        return numbers, mask


class Scorer:
    """A trained network with the gate inputs of the words it has met, kept for the next texts."""

    def __init__(self, model: Model, most_words: int = 100_000) -> None:
        self.model, self.most = model, most_words
        h = model.fit.hidden
        # sigmoid(x) = (tanh(x / 2) + 1) / 2: the halves go into the weights of the two gates
        self.half = np.concatenate([np.full(2 * h, 0.5), np.ones(h)]).astype(np.float32)
        self.u = [u * self.half for u in model.weights["u"]]
        self.b = [b * self.half for b in model.weights["b"]]
        self.wx = model.weights["wx"] * np.tile(self.half, 2)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.gates = np.zeros(0, np.uint64), np.zeros((0, 6 * self.model.fit.hidden), np.float32)

    def _learn(self, words: Words, keys: np.ndarray, first: np.ndarray, part: int = 8_000) -> None:
        if len(self.keys) > self.most:
            self._clear()
        new = np.flatnonzero(_find(self.keys, keys) == len(self.keys))
        gates = [self.gates]
        for i in range(0, len(new), part):
            own = new[i : i + part]
            gram, owner = char_grams(words, first[own])
            gram = _find(self.model.grams, gram)
            known = np.flatnonzero(gram < len(self.model.grams))
            known = known[np.argsort(owner[known], kind="stable")]
            gates.append(_inputs(self.model, _find(self.model.words, keys[own]), gram[known], owner[known]) @ self.wx)
        both = np.concatenate([self.keys, keys[new]])
        order = np.argsort(both, kind="stable")
        self.keys, self.gates = both[order], np.concatenate(gates)[order]

    def _run(self, numbers: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Probabilities of windows of words (time, window); number -1 has no input. mask is None where all are full."""
        w, (steps, n), h = self.model.weights, numbers.shape, self.model.fit.hidden
        both = np.zeros((steps, n, 2 * h), np.float32)
        for d in (0, 1):
            gates = self.padded[d]
            now = np.zeros((n, h), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                x, rec = gates[numbers[t]], now @ self.u[d]
                rec += self.b[d]
                gate = x[:, : 2 * h]
                gate += rec[:, : 2 * h]
                np.tanh(gate, out=gate)
                gate *= 0.5
                gate += 0.5
                c = rec[:, 2 * h :]
                c *= gate[:, :h]
                c += x[:, 2 * h :]
                np.tanh(c, out=c)
                new = now - c
                new *= gate[:, h:]
                new += c
                now = new if mask is None else np.where(mask[t][:, None], new, now)
                both[t, :, d * h : (d + 1) * h] = now
        e = np.tanh(both.reshape(-1, 2 * h) @ w["wa"]).reshape(steps, n, -1) @ w["va"]
        if mask is not None:
            e = np.where(mask, e, -1e9)
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        return _sigmoid((e * (both @ w["wo"])).sum(axis=0) + w["bo"])

    def __call__(self, column: pa.Array, most: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, first word, length and probability of every window of the texts."""
        fit, words = self.model.fit, split(column, ALNUM)
        keys, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self._learn(words, keys, first)
        gates = np.concatenate([self.gates[_find(self.keys, keys)], np.zeros((1, 6 * fit.hidden), np.float32)])
        self.padded = [np.ascontiguousarray(x) for x in np.split(gates, 2, axis=1)]
        number = np.append(inverse, -1).astype(np.int32)
        row, start, size = _windows(words.rows, fit.window, fit.step)
        score = np.zeros(len(row), np.float32)
        order = np.argsort(size, kind="stable")
        for i in range(0, len(row), most):
            part = order[i : i + most]
            length = max(1, int(size[part].max()))
            at = start[part] + np.arange(length)[:, None]
            mask = None
            if size[part].min() < length:
                mask = np.arange(length)[:, None] < size[part]
                at = np.where(mask, at, len(number) - 1)
                mask[0] |= size[part] == 0  # an empty window is one step without input
            score[part] = self._run(number[at], mask)
        return row, start, size, score

    def worst(self, column: pa.Array) -> np.ndarray:
        """The greatest window score of each row."""
        row, _, _, p = self(column)
        return np.maximum.reduceat(p, np.searchsorted(row, np.arange(len(column)))) if len(column) else np.zeros(0, np.float32)


def _evidence(toxic: np.ndarray, clean: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How far the documents that hold something are toxic, in standard errors of the log odds."""
    odds = np.log((toxic + 0.5) / ((y > 0).sum() + 1)) - np.log((clean + 0.5) / ((y == 0).sum() + 1))
    return np.clip(odds / np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)), -3, 6).astype(np.float32)


def _kept(n: np.ndarray, least: int, most: int | None) -> np.ndarray:
    """Places of what at least so many documents hold; of more than `most`, of that which most hold."""
    kept = np.flatnonzero(n >= least)
    return np.sort(kept[np.argsort(-n[kept], kind="stable")[:most]])


def train(texts: list[str | None] | pa.Array, labels: list[int] | np.ndarray, fit: Fit = Fit()) -> Model:
    """Fits the network to whole-text labels."""
    rng = np.random.default_rng(fit.seed)
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    f, y = Features(column), np.array(labels, np.float32)
    trim()
    pair = np.unique((f.inverse - 1).astype(np.int64) * max(1, len(y)) + f.words.row)
    word, doc = pair // max(1, len(y)), pair % max(1, len(y))
    toxic, clean = (np.bincount(word, weights=side[doc], minlength=len(f.keys)) for side in (y, 1 - y))
    gram_keys, gram_toxic, gram_clean = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for gram, owner in f.grams():
        gram_keys, gram_of = np.unique(np.concatenate([gram_keys, gram]), return_inverse=True)
        gram_toxic, gram_clean = (np.bincount(gram_of, weights=np.concatenate([x, side[owner]]), minlength=len(gram_keys)) for x, side in ((gram_toxic, toxic), (gram_clean, clean)))
    own = _kept(toxic + clean, fit.min_docs, fit.most_words)
    part = _kept(gram_toxic + gram_clean, fit.min_docs, fit.most_grams)
    words, grams, weights = f.keys[own], gram_keys[part], _start(fit, rng)
    model = Model(fit, words, np.zeros((len(words) + 1, fit.inputs), np.float32), grams, (rng.standard_normal((len(grams) + 1, fit.inputs)) * 0.02).astype(np.float32), weights)
    model.word_vectors[:-1, 0] = _evidence(toxic[own], clean[own], y) / 4
    model.gram_vectors[:-1, 1] = _evidence(gram_toxic[part], gram_clean[part], y) / 4
    model.gram_vectors[-1] = 0
    del pair, word, doc, gram_keys, gram_toxic, gram_clean, toxic, clean
    trim()
    if not len(y) or y.min() == y.max():
        return model
    word_at, (gram_at, owner) = _find(words, f.keys), f.known_grams(grams)
    rows = f.words.rows
    f.words = None  # from here on words are numbers
    gram_rows = np.searchsorted(owner, np.arange(len(f.keys) + 1))
    n_grams = np.maximum(1, np.diff(gram_rows)).astype(np.float32)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in weights.items()}
    square = {"w": np.full(len(words) + 1, 1e-6, np.float32), "g": np.full(len(grams) + 1, 1e-6, np.float32)}
    time = 0
    row, first, size = _windows(rows, fit.window, fit.step)
    evidence = np.zeros(len(f.keys))
    for i in range(0, len(owner), 1 << 18):
        evidence += np.bincount(owner[i : i + (1 << 18)], weights=model.gram_vectors[gram_at[i : i + (1 << 18)], 1], minlength=len(f.keys))
    evidence = np.append(-1, model.word_vectors[word_at, 0] + evidence / n_grams)
    del owner
    trim()
    weight = np.where(y > 0, 0.35 / max(1, (y > 0).sum()), 0.65 / max(1, (y == 0).sum())) * len(y)
    epoch = -1
    while (epoch := epoch + 1) < fit.epochs or time < fit.least_steps:
        draw = rng.random(len(row))
        if not epoch:
            first_guess = np.concatenate([evidence[f.window(first[i : i + 4096], size[i : i + 4096], fit.window)[0]].max(axis=0) for i in range(0, len(row), 4096)])
            draw = np.where((y[row] > 0) | (draw >= 0.5), -first_guess, draw)
        else:
            scorer = Scorer(model, 50_000)
            now = np.concatenate([scorer(column[i : i + 200])[3] for i in range(0, len(column), 200)])
            del scorer
            trim()
            draw = np.where((y[row] > 0) | (draw >= 0.5), -now, draw)
        order = np.lexsort((draw, row))
        rank = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        most = np.where(y[row[order]] > 0, 1, 10)
        chosen = rng.permutation(order[rank < most])
        for i in range(0, len(chosen), fit.batch):
            part = chosen[i : i + fit.batch]
            numbers, mask = f.window(first[part], size[part], max(1, int(size[part].max())))
            distinct, inverse = np.unique(numbers, return_inverse=True)
            inverse = inverse.reshape(numbers.shape)
            real = distinct[distinct > 0] - 1
            lo = 1 if len(distinct) and distinct[0] == 0 else 0
            # n-grams of these words, flat
            count = gram_rows[real + 1] - gram_rows[real]
            flat = np.repeat(gram_rows[real] - np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64), count) + np.arange(count.sum())
            own = np.repeat(np.arange(len(real)), count)
            x = np.zeros((len(distinct), fit.inputs), np.float32)
            x[lo:] = model.word_vectors[word_at[real]]
            x[lo:] += _scatter(own, model.gram_vectors[gram_at[flat]], len(real)) / n_grams[real][:, None]
            gates = (x @ weights["wx"]).reshape(-1, 2, 3 * fit.hidden)[inverse]
            p, saved = _forward(weights, gates, mask)
            target = y[row[part]]
            dout = ((p - target) * weight[row[part]] / len(part)).astype(np.float32)
            g, dgates = _backward(weights, saved, mask, dout, gates.shape)
            dflat = _scatter(inverse.ravel(), dgates.reshape(-1, 6 * fit.hidden), len(distinct))
            g["wx"] = x.T @ dflat
            dx = (dflat @ weights["wx"].T)[lo:]
            time += 1
            for k, v in weights.items():
                a, b = moments[k]
                a += 0.1 * (g[k] - a)
                b += 0.01 * (g[k] ** 2 - b)
                v -= fit.rate * (a / (1 - 0.9**time)) / (np.sqrt(b / (1 - 0.99**time)) + 1e-6)
            for table, at, grad, total in ((model.word_vectors, word_at[real], dx, square["w"]), (model.gram_vectors, gram_at[flat], dx[own] / n_grams[real][own][:, None], square["g"])):
                keys, inv = np.unique(at, return_inverse=True)
                step = _scatter(inv, grad, len(keys))
                total[keys] += (step**2).mean(axis=1)
                table[keys] -= 10 * fit.rate * step / np.sqrt(total[keys])[:, None]
            model.word_vectors[-1] = 0
            model.gram_vectors[-1] = 0
    return model


def sampled(docs: DataFrame, labels: DataFrame, held: str | None = None, rows: int = Fit.rows, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, text and y of the training rows. held: SQL condition on doc_id of rows that are not to be learned from."""
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = (known.where(f"not ({held})") if held else known).groupBy("doc_id").agg(F.max("y").alias("y"))
    halves = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows * share // 5) for y, share in ((0, 3), (1, 2))]
    chosen = halves[0].unionByName(halves[1])
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def sample(docs: DataFrame, labels: DataFrame, held: str | None = None, rows: int = Fit.rows, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list, list]:
    """Texts and labels of the training rows, in order of their ids."""
    found = sampled(docs, labels, held, rows, doc_id, text, label).toArrow().sort_by("doc_id")
    return found.column("text").to_pylist(), found.column("y").to_pylist()


def fitted(rows: DataFrame, fit: Fit = Fit()) -> Model:
    """The network trained on sampled rows. One task holds the bounded sample, so the driver receives the model alone."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches), _ROWS).sort_by("doc_id").combine_chunks()
        model = train(pa.concat_arrays(found.column("text").chunks or [pa.array([], pa.string())]), found.column("y").to_numpy(), fit)
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    learned = rows.select("doc_id", "text", "y").repartition(1).mapInArrow(trimmed(learn), "model binary").first()
    return pickle.loads(learned["model"]) if learned else train([], [], fit)


_ROWS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("y", pa.int32())])
#: bytes of text that a scorer takes at a time
_SLICE = 1 << 20


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row of docs: the greatest of all its windows' scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, "text", _SLICE):
            yield pa.record_batch([batch.column("doc_id"), pa.array(scorer.worst(batch.column("text")).astype(np.float64))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(score), "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, text: str = "text", at: float = 0.7) -> DataFrame:
    """The rows whose score is below the threshold, all columns kept, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, ("_doc", text), _SLICE):
            yield batch.filter(pa.array(scorer.worst(pc.struct_field(batch.column("_doc"), text)) < at))

    packed = whole_rows(docs)
    return packed.mapInArrow(trimmed(keep), packed.schema).select(*[F.col("_doc")[c].alias(c) for c in columns])
