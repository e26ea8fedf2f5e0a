"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are binned into histograms; each tree grows level by level on summed
gradients per bin; the finished trees are flattened into arrays (feature, threshold, children,
value) that numpy walks for a batch of documents at once.

The fit uses a bounded sample: at most ``MAX_TRAIN`` labelled documents, those with the smallest
hash of their id. Everything else runs over all documents.

Defined cases: null and empty texts have all statistics zero and are scored like any other; label
rows without a quality or without a document are ignored; several labels of one document count
as their mean, and of several texts of one id the fit sees that of the least hash; repeated documents are scored once each; without a usable label of both kinds
every score is 0.5; other columns are ignored and may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The largest number of labelled documents that the trees are fitted on.
MAX_TRAIN = 20_000
CUTOFF = 0.7

FEATURES = (
    "log_chars log_words word_len word_len_std upper digit space punct pipe mark bang other "
    "distinct_words top_word repeat_next short_words line_words distinct_lines symbol_words upper_words "
    "entropy stops"
).split()

_CLASS = np.zeros((256, 8), np.float64)
_CLASS[65:91, 0] = 1
_CLASS[48:58, 1] = 1
_CLASS[[9, 10, 11, 12, 13, 32], 2] = 1
_CLASS[[44, 46, 58, 59, 39, 34, 40, 41], 3] = 1
_CLASS[124, 4] = 1
_CLASS[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126], 5] = 1
_CLASS[[33, 63], 6] = 1
_CLASS[128:, 7] = 1
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of ``FEATURES``."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, m = len(raw), len(words)
    share = counts @ _CLASS / n
    lengths = np.fromiter(map(len, words), np.int64, m)
    kinds = Counter(words)
    p = counts[counts > 0] / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    stripped = [w.strip(b".,;:") for w in kinds]
    symbol = sum(c for w, c in zip(stripped, kinds.values(), strict=True) if w.translate(None, _LETTERS))
    upper = sum(c for w, c in kinds.items() if len(w) > 1 and w.isupper())
    same = sum(map(bytes.__eq__, words, words[1:]))
    top = kinds.most_common(10)
    return [
        math.log1p(n), math.log1p(m), lengths.mean(), lengths.std(), *share,
        len(kinds) / m, top[0][1] / m, same / m, float((lengths <= 3).mean()), m / len(lines), len(set(lines)) / len(lines),
        symbol / m, upper / m, float(-(p * np.log2(p)).sum()), sum(c for _, c in top) / m,
    ]


@dataclass
class Forest:
    """Flattened trees; node 0 of each tree is its root, leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 8, shrink: float = 1.0
) -> Forest:
    """Boost ``trees`` trees on rows ``x`` with targets ``y`` in 0..1 under logistic loss."""
    features = x.shape[1]
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = math.log(mean / (1 - mean))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf() -> int:
        k = len(feature)
        for a, v in ((feature, 0), (threshold, math.inf), (left, k), (right, k), (value, 0.0)):
            a.append(v)
        return k

    both = len(y) and y.min() < y.max()
    if both:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(features)]
        binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1)  # x <= cuts[b] for bins up to b
        flat = binned + np.arange(features) * bins
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            root = leaf()
            roots.append(root)
            node = np.full(len(y), root)
            open_nodes = [root]
            for _ in range(depth):
                following = []
                for k in open_nodes:
                    own = np.flatnonzero(node == k)
                    if len(own) < 2 * least:
                        continue
                    g, h, c = (
                        np.bincount(flat[own].ravel(), np.repeat(w[own], features), features * bins).reshape(features, bins).cumsum(1)
                        for w in (grad, hess, np.ones(len(y)))
                    )
                    gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                    gain = g**2 / (h + shrink) + (gt - g) ** 2 / (ht - h + shrink) - gt**2 / (ht + shrink)
                    gain[(c < least) | (ct - c < least)] = -1
                    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, b] <= 1e-6 or b >= len(cuts[j]):
                        continue
                    feature[k], threshold[k], left[k], right[k] = int(j), float(cuts[j][b]), leaf(), leaf()
                    node[own] = np.where(binned[own, j] <= b, left[k], right[k])
                    following += [left[k], right[k]]
                open_nodes = following
            for k in range(root, len(feature)):
                own = node == k
                if left[k] == k and own.any():
                    value[k] = float(-rate * grad[own].sum() / (hess[own].sum() + shrink))
                    margin[own] += value[k]
    if not roots:
        roots.append(leaf())
        base = base if both else 0.0
    return Forest(*(np.array(a) for a in (feature, threshold, left, right, value, roots)), depth if both else 0, base)


def training_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and targets of at most ``limit`` labelled documents, none of them held out."""
    chosen = (
        labels.where("quality is not null and doc_id is not null")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )

    def run(batches):
        for b in batches:
            texts, y = b.column("text").to_pylist(), b.column("y")
            yield pa.RecordBatch.from_arrays([pa.array([statistics(t) for t in texts], pa.list_(pa.float64())), y], ["x", "y"])

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``limit`` small rows
    # one text of each id, so that repeated ids keep within the limit
    joined = joined.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("y").alias("y"))
    rows = joined.select("text", "y").mapInArrow(run, "x array<double>, y double").toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = rows.column("y").to_numpy()
    order = np.lexsort([*x.T, y])  # the same trees in whatever order the rows arrive
    return x[order], y[order]


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, **params) -> Forest:
    return fit(*training_sample(docs, labels), **params)


def score(docs: DataFrame, forest: Forest, cutoff: float = CUTOFF) -> DataFrame:
    """Rows ``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(forest.predict(x), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, forest: Forest, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns; all of them where there were no labels to learn from."""
    if not forest.depth:
        return docs
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(forest.predict(x) >= cutoff))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
