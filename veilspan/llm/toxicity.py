"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the embedding of its hash beside the mean embedding of its character n-grams. Texts
are read in windows of ``WINDOW`` words, one every ``STRIDE`` words and one that ends with the text, so
every word lies in a window, most in two. Each window runs through a gated unit in both directions;
attention pools its states into one, which a logistic unit scores. A document's score is that of its
most toxic window, so a remark counts the same in a long text as in a short one.

Labels stand for whole documents, so a toxic document teaches by the windows that score highest and a
clean one by all windows drawn and those that score highest. The fit uses a bounded sample: of each label at most
``MAX_TOXIC`` or ``MAX_CLEAN`` documents of at most ``MAX_BYTES`` bytes, those of the least hash of their
id, none held out. Everything else runs over all documents, whole.

Defined cases: null and empty texts have one window of a single empty word; words without a column in the
tables share it with others; label rows without a ``toxic`` or a document are ignored; several labels
of one document count by their mean, and of several texts of one id the fit sees that of the least
hash; repeated documents are scored once each; without usable labels of both kinds every score is 0;
other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .quality import held_out

WINDOW, STRIDE = 32, 16
WORD_ROWS, GRAM_ROWS = 1 << 14, 1 << 15
GRAMS = (3, 4, 5)
WIDE, HIDDEN = 12, 12
MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 1_500, 3_000, 16_384
CUTOFF = 0.3
EPOCHS, BATCH, RATE = 7, 128, 0.01
#: Text whose windows are scored at once; a longer text's windows run in parts.
CHUNK_BYTES, LANES = 4 << 20, 4096

_SHAPES = {
    "word": (WORD_ROWS, WIDE), "gram": (GRAM_ROWS, WIDE),
    "wx": (2, 2 * WIDE, 3 * HIDDEN), "wh": (2, HIDDEN, 3 * HIDDEN), "b": (2, 3 * HIDDEN),
    "wa": (2 * HIDDEN, HIDDEN), "ba": (HIDDEN,), "va": (HIDDEN,), "wo": (2 * HIDDEN,), "bo": (1,),
}
Weights = dict[str, np.ndarray]
_ODD = np.uint64(0x9E3779B97F4A7C15)


# ---- inputs -----------------------------------------------------------------------------------


class Texts:
    """Some texts as windows: distinct words with their rows in the tables, and the word of each place of each window."""

    def __init__(self, texts: list[str | None]):
        index: dict[bytes, int] = defaultdict(count().__next__)
        ids, sizes = [], []
        for t in texts:
            words = (t or "").lower().encode().split() or [b""]
            ids.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
            sizes.append(len(words))
        self.ids = np.concatenate([*ids, np.zeros(0, np.int32)])
        sizes_, first = np.array(sizes, np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n = 1 + np.maximum(0, -(-(sizes_ - WINDOW) // STRIDE))
        self.doc = np.repeat(np.arange(len(texts)), n)
        at = np.arange(len(self.doc)) - (np.cumsum(n) - n)[self.doc]
        start = np.minimum(at * STRIDE, np.maximum(sizes_ - WINDOW, 0)[self.doc])
        self.start = first[:-1][self.doc] + start
        self.size = np.minimum(sizes_, WINDOW)[self.doc]
        self.first_window = np.cumsum(n) - n
        words = list(index)
        self.word_row = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).astype(np.int64) % WORD_ROWS
        raw = b"".join(b"<%b>" % w for w in words)
        arr = np.frombuffer(raw, np.uint8).astype(np.uint64)
        length = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        left = np.repeat(np.cumsum(length), length) - np.arange(len(arr))  # bytes to the word's end
        mine = np.repeat(np.arange(len(words)), length)
        rows, own = [], []
        for g in GRAMS:
            at = np.flatnonzero(left >= g)
            code = np.full(len(at), g, np.uint64)
            for j in range(g):
                code = (code ^ arr[at + j]) * _ODD
                code ^= code >> np.uint64(29)
            rows.append((code % np.uint64(GRAM_ROWS)).astype(np.int32))
            own.append(mine[at])
        own_, rows_ = np.concatenate([*own, [] if words else []]).astype(np.int64), np.concatenate(rows)
        order = np.argsort(own_, kind="stable")
        self.gram_row, self.gram_word = rows_[order], own_[order]
        grams = np.bincount(self.gram_word, minlength=len(words))
        self.gram_end = np.cumsum(grams)
        self.gram_share = (1 / np.maximum(grams, 1)).astype(np.float32)

    def places(self, windows: np.ndarray) -> np.ndarray:
        """Word of each place of windows, as rows; places past a window's end repeat its last word."""
        return self.ids[self.start[windows][:, None] + np.minimum(np.arange(WINDOW), self.size[windows][:, None] - 1)]

    def inputs(self, w: Weights, step: int = 1 << 14) -> np.ndarray:
        """What enters for each distinct word."""
        out = np.zeros((len(self.word_row), 2 * WIDE), np.float32)
        out[:, :WIDE] = w["word"][self.word_row]
        for at in range(0, len(out), step):
            end = min(at + step, len(out))
            lo = self.gram_end[at - 1] if at else 0
            begin = np.concatenate([[lo], self.gram_end[at : end - 1]]) - lo
            grams = w["gram"][self.gram_row[lo : self.gram_end[end - 1]]]
            some = np.flatnonzero(self.gram_end[at:end] - lo > begin)
            if len(some):
                out[at + some, WIDE:] = np.add.reduceat(grams, begin[some], axis=0) * self.gram_share[at + some, None]
        return out


# ---- the network ------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def initial(seed: int = 5) -> Weights:
    rng = np.random.default_rng(seed)
    return {k: (rng.normal(0, 0.3, s) if k not in ("b", "ba", "bo") else np.zeros(s)).astype(np.float32) for k, s in _SHAPES.items()}


def forward(w: Weights, gates: np.ndarray, place: np.ndarray, size: np.ndarray, kept: dict | None = None) -> np.ndarray:
    """The logit of each window. ``gates[d]`` has each word's part of the gates in direction ``d``.

    The forward direction runs on past a window's end, where attention does not look; the backward
    one starts there anew.
    """
    n = len(place)
    states = np.empty((WINDOW, n, 2 * HIDDEN), np.float32)
    short = size < WINDOW
    any_short = short.any()
    for d in (0, 1):
        h, wh = np.zeros((n, HIDDEN), np.float32), w["wh"][d]
        steps = range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1)
        for t in steps:
            g, a = gates[d][place[:, t]], h @ wh
            zr = _sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            new = c + z * (h - c)
            if d and any_short:
                new *= (t < size)[:, None]
            if kept is not None:
                kept[d, t] = (h, z, r, a[:, 2 * HIDDEN :], c)
            h = new
            states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
    u = np.tanh(states @ w["wa"] + w["ba"])
    e = u @ w["va"]
    if any_short:
        e = np.where(np.arange(WINDOW)[:, None] < size, e, np.float32(-1e9))
    p = np.exp(e - e.max(0))
    p /= p.sum(0)
    pooled = np.einsum("tn,tnk->nk", p, states)
    if kept is not None:
        kept["top"] = (states, u, p, pooled)
    return pooled @ w["wo"] + w["bo"]


def _backward(w: Weights, kept: dict, size: np.ndarray, slope: np.ndarray, grads: Weights) -> np.ndarray:
    """Adds the slopes of the loss to ``grads``; returns those of the gates, by direction, place and window."""
    states, u, p, pooled = kept["top"]
    grads["wo"] += pooled.T @ slope
    grads["bo"] += slope.sum()
    dpooled = slope[:, None] * w["wo"]
    ds = p[:, :, None] * dpooled
    dp = np.einsum("nk,tnk->tn", dpooled, states)
    de = p * (dp - (p * dp).sum(0))
    du = de[:, :, None] * w["va"] * (1 - u * u)
    grads["va"] += np.einsum("tn,tnk->k", de, u)
    grads["ba"] += du.sum((0, 1))
    grads["wa"] += np.einsum("tnk,tnj->kj", states, du)
    ds += du @ w["wa"].T
    dgates = np.empty((2, WINDOW, len(size), 3 * HIDDEN), np.float32)
    for d in (0, 1):
        back, wh = np.zeros((len(size), HIDDEN), np.float32), w["wh"][d]
        for t in range(WINDOW - 1, -1, -1) if d == 0 else range(WINDOW):
            h, z, r, ah, c = kept[d, t]
            dh = ds[t, :, d * HIDDEN : (d + 1) * HIDDEN] + back
            if d:
                dh = dh * (t < size)[:, None]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * ah * r * (1 - r)
            da = np.concatenate([dz, dr, dc * r], 1)
            back = da @ wh.T + dh * z
            grads["wh"][d] += h.T @ da
            dgates[d, t] = np.concatenate([dz, dr, dc], 1)
    return dgates


def _sum_rows(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(rows, values[:, j], n) for j in range(values.shape[1])], 1).astype(np.float32)


def _step(w: Weights, texts: Texts, windows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Weights:
    """Gradients of the logistic loss over some windows."""
    place, size = texts.places(windows), texts.size[windows]
    words, at = np.unique(place, return_inverse=True)
    place = at.reshape(place.shape)
    # the words' inputs, and the n-grams that made them
    lo, hi = np.concatenate([[0], texts.gram_end])[words], texts.gram_end[words]
    many = hi - lo
    gram = texts.gram_row[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    of = np.repeat(np.arange(len(words)), many)
    x = np.concatenate([w["word"][texts.word_row[words]], _sum_rows(w["gram"][gram], of, len(words)) * texts.gram_share[words, None]], 1)
    kept: dict = {}
    logits = forward(w, [x @ w["wx"][d] + w["b"][d] for d in (0, 1)], place, size, kept)
    slope = ((_sigmoid(logits) - y) * weight / len(y)).astype(np.float32)
    grads = {k: np.zeros(s, np.float32) for k, s in _SHAPES.items()}
    dgates = _backward(w, kept, size, slope, grads)
    dx = np.zeros_like(x)
    for d in (0, 1):
        flat = dgates[d].reshape(-1, 3 * HIDDEN)
        per = _sum_rows(flat, place.T.ravel(), len(words))
        grads["wx"][d] += x.T @ per
        grads["b"][d] += per.sum(0)
        dx += per @ w["wx"][d].T
    np.add.at(grads["word"], texts.word_row[words], dx[:, :WIDE])
    grads["gram"] += _sum_rows((dx[:, WIDE:] * texts.gram_share[words, None])[of], gram, GRAM_ROWS)
    return grads


def logits(w: Weights, texts: Texts, lanes: int = LANES) -> np.ndarray:
    """The logit of every window."""
    x = texts.inputs(w)
    gates = [x @ w["wx"][d] + w["b"][d] for d in (0, 1)]
    out = np.empty(len(texts.doc), np.float32)
    for at in range(0, len(out), lanes):
        some = np.arange(at, min(at + lanes, len(out)))
        out[some] = forward(w, gates, texts.places(some), texts.size[some])
    return out


def fit(given: list[str | None], y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Weights | None:
    """Weights learned from texts and their labels; none without labels of both kinds."""
    if not len(y) or y.min() == y.max():
        return None
    rng, w = np.random.default_rng(seed), initial()
    texts = Texts(given)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    order_by_doc = lambda score: np.lexsort((-score, texts.doc))
    toxic = y[texts.doc] > 0.5
    place = np.arange(len(texts.doc)) - texts.first_window[texts.doc]  # of a window among those of its document, in whatever order
    step, ranked = 0, np.zeros(0, np.int64)
    for epoch in range(epochs):
        # of each document a few windows at random; then, ranked anew in every other pass, its highest
        drawn = order_by_doc(rng.random(len(texts.doc)))
        if epoch % 2:
            ranked = order_by_doc(logits(w, texts))
        if epoch == 0:
            chosen = drawn[place < 4]
        else:
            chosen = np.unique(np.concatenate([ranked[place < 1], ranked[(place < 2) & ~toxic[ranked]], drawn[(place < 1) & ~toxic[drawn]]]))
        chosen = rng.permutation(chosen)
        target = y[texts.doc[chosen]].astype(np.float32)
        share = np.float32(target.mean())
        weight = np.where(target > 0.5, np.float32(0.35) / share, np.float32(0.65) / (1 - share)).astype(np.float32)
        for a in range(0, len(chosen), BATCH):
            part = slice(a, a + BATCH)
            grads = _step(w, texts, chosen[part], target[part], weight[part])
            step += 1
            scale = np.float32(RATE * (1 - epoch / (epochs + 1)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step))
            for k, g in grads.items():
                m[k] += np.float32(0.1) * (g - m[k])
                v[k] += np.float32(0.01) * (g * g - v[k])
                w[k] -= scale * m[k] / (np.sqrt(v[k]) + np.float32(1e-7))
    return w


def scores(w: Weights | None, texts: list[str | None]) -> np.ndarray:
    """Score of each text: the probability of its most toxic window."""
    if w is None or not texts:
        return np.zeros(len(texts))
    t = Texts(texts)
    best = np.maximum.reduceat(logits(w, t), t.first_window)
    return 1 / (1 + np.exp(-np.clip(best.astype(np.float64), -50, 50)))


# ---- jobs -------------------------------------------------------------------------------------


def training_sample(docs: DataFrame, labels: DataFrame, toxic: int = MAX_TOXIC, clean: int = MAX_CLEAN, size: int = MAX_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``toxic`` + ``clean`` documents of at most ``size`` bytes, none held out."""
    mean = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg((F.avg("toxic") > 0.5).alias("y"))
    fit_size = docs.where("text is not null").where(F.octet_length("text") <= size).select("doc_id", "text")
    known = fit_size.select("doc_id").distinct().join(mean, "doc_id")
    some = [known.where(y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((F.col("y"), toxic), (~F.col("y"), clean))]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # at most ``toxic`` + ``clean`` ids
    once = fit_size.join(chosen, "doc_id").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("y").alias("y"))
    rows = once.toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    texts, y = rows.column("text").to_pylist(), rows.column("y").to_numpy().astype(np.float32)
    return [texts[i] for i in order], y[order]


def train(docs: DataFrame, labels: DataFrame, **bounds) -> Weights | None:
    return fit(*training_sample(docs, labels, **bounds))


def _chunks(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    at = total = 0
    for i, t in enumerate(texts):
        if i > at and total + len(t or "") > limit:
            yield at, i
            at, total = i, 0
        total += len(t or "")
    if at < len(texts):
        yield at, len(texts)


def score(docs: DataFrame, w: Weights | None, cutoff: float = CUTOFF) -> DataFrame:
    """Rows ``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    given = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            parts = [scores(given.value, texts[lo:hi]) for lo, hi in _chunks(texts, CHUNK_BYTES)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate([*parts, np.zeros(0)]), pa.float64())], ["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
