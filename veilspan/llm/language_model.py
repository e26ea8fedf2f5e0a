"""Gated recurrent language model with a class-factored softmax, and whole-document scores.

Counts of all training tokens come from one grouped pass over the corpus. The ``CLASSES`` x
``SIZE`` most frequent tokens are the model's words, in classes by rank; all others share one more
class, within which a token has its smoothed corpus frequency. So every text has a probability.

Weights are trained on all training documents by truncated backpropagation through ``STEPS``
steps: in each of ``ROUNDS`` rounds, every task passes once over its share of the round's
documents and the tasks' weights are averaged, weighted by tokens, in a grouped sum. Documents
run in lanes side by side, the state carried from one window of steps to the next and reset
where a document begins; scoring carries it through whole documents of any length.

Tokens stand as 64-bit hashes of their bytes. Scoring looks up at most ``TABLE`` frequent tokens
in a broadcast table; the rest meet their counts in a join.

Defined cases: null and empty texts have the end token only; rows without an id count as
training documents; repeated rows count and are scored each; without training tokens all counts
are zero and the score is that of the untrained model; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .rolling import Words, blocks

CLASSES, SIZE = 32, 64
HIDDEN = 16
STEPS = 16
LANES = 512
ROUNDS = 2
RATE = 0.01
#: Most tokens in the broadcast table of counts, 16 bytes each.
TABLE = 262_144
#: Bound of the softmax's inputs, so that their exponentials stay finite in 32 bits.
CLIP = np.float32(40)
#: The end token's key.
END = np.uint64(1)
#: Text gathered before its documents are put in lanes.
CHUNK_BYTES = 16 << 20

VOCAB = CLASSES * SIZE
REST = VOCAB  # a token that is none of the model's words


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1


def tokens(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of documents: first, one past the last, the keys of their tokens, and the document of each."""
    raw = [(t or "").encode().lower() for t in texts]
    for lo, hi in blocks([len(t) for t in raw]):
        w = Words(raw[lo:hi])
        n = len(w.doc) + hi - lo
        keys, doc = np.empty(n, np.uint64), np.empty(n, np.int64)
        ends = np.cumsum(w.count + 1) - 1
        at = np.arange(len(w.doc)) + w.doc
        keys[at], doc[at] = w.hash, w.doc
        keys[ends], doc[ends] = END, np.arange(hi - lo)
        yield lo, hi, keys, doc


# ---- counts -----------------------------------------------------------------------------------


def token_counts(docs: DataFrame) -> DataFrame:
    """Rows ``(h, c)``: how often each token occurs in the training documents."""

    def run(batches):
        for b in batches:
            for _, _, keys, _ in tokens(b.column("text").to_pylist()):
                h, c = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    return docs.where(~held_out()).select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Sorted keys of frequent tokens, their counts and model ids, and totals of all tokens."""

    keys: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    total: int
    distinct: int

    def __post_init__(self):
        #: where keys of each leading bits begin; keys are hashes, so few share them
        self.shift = np.uint64(64 - max(1, len(self.keys)).bit_length() - 2)
        tops = np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)
        self.begin = np.searchsorted(self.keys >> self.shift, tops).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key in the table, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        top = (keys >> self.shift).astype(np.int32)
        at, end = self.begin[top], self.begin[top + 1]
        out = np.full(len(keys), -1)
        open_ = np.flatnonzero(at < end)
        place, end = at[open_], end[open_]
        while len(open_):
            hit = self.keys[place] == keys[open_]
            out[open_[hit]] = place[hit]
            place += 1
            more = ~hit & (place < end)
            open_, place, end = open_[more], place[more], end[more]
        return out

    @property
    def rest(self) -> float:
        """The smoothing denominator among tokens that are none of the model's words."""
        own = self.ids < VOCAB
        return float(self.total - self.counts[own].sum() + 0.5 * (self.distinct - own.sum() + 1))

    @property
    def whole(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


def lexicon(counts: DataFrame, limit: int = TABLE) -> Lexicon:
    """The frequent tokens: those of a count that at most ``limit`` tokens reach."""
    levels = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).limit(limit).collect()
    totals = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    cut, kept = None, 0
    for r in levels:
        kept += r.n
        if kept > limit:
            break
        cut = r.c
    found = counts.where(F.col("c") >= cut).toArrow() if cut is not None else None
    h = found.column("h").to_numpy().view(np.uint64) if found else np.zeros(0, np.uint64)
    c = found.column("c").to_numpy() if found else np.zeros(0, np.int64)
    order = np.lexsort((h, -c))
    ids = np.full(len(h), REST, np.int64)
    ids[order[:VOCAB]] = np.arange(min(VOCAB, len(h)))
    by_key = np.argsort(h)
    return Lexicon(h[by_key], c[by_key], ids[by_key], int(totals[0] or 0), int(totals[1]))


# ---- the network ------------------------------------------------------------------------------

_SHAPES = {
    "embed": (VOCAB + 1, HIDDEN),
    "wx": (HIDDEN, 3 * HIDDEN),
    "wh": (HIDDEN, 3 * HIDDEN),
    "b": (3 * HIDDEN,),
    "wc": (HIDDEN, CLASSES + 1),
    "bc": (CLASSES + 1,),
    "wo": (CLASSES, HIDDEN, SIZE),
    "bo": (CLASSES, SIZE),
}
Weights = dict[str, np.ndarray]


def initial(lex: Lexicon, seed: int = 7) -> Weights:
    """Small random weights; the output biases start at the corpus frequencies."""
    rng = np.random.default_rng(seed)
    w = {k: (rng.normal(0, 0.3 if k in ("wx", "wh", "embed") else 0.02, s)).astype(np.float32) for k, s in _SHAPES.items()}
    own = lex.ids < VOCAB
    counts = np.zeros(VOCAB)
    counts[lex.ids[own]] = lex.counts[own]
    by_class = (counts + 0.5).reshape(CLASSES, SIZE)
    w["b"][:] = 0
    w["bo"] = np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32)
    mass = np.concatenate([by_class.sum(1), [max(lex.rest, 0.5)]])
    w["bc"] = np.log(mass / mass.sum()).astype(np.float32)
    return w


def flatten(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in _SHAPES])


def unflatten(flat: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def lanes(sizes: np.ndarray, count: int) -> list[list[int]]:
    """Documents dealt to at most ``count`` lanes of about equal length, the longest lane first."""
    heap = [(0, i) for i in range(min(count, len(sizes)))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-sizes, kind="stable").tolist():
        total, i = heapq.heappop(heap)
        out[i].append(d)
        heapq.heappush(heap, (total + int(sizes[d]), i))
    return sorted(out, key=lambda lane: -int(sizes[lane].sum()))


class Streams:
    """Documents in lanes: the places of their tokens by step and lane, without a table of steps times lanes.

    Lanes are ragged: their tokens stand one lane after another, so that a long document beside
    short ones takes no more than its own tokens.
    """

    def __init__(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, count: int, end_id: int):
        dealt = lanes(sizes, count)
        self.lengths = np.array([int(sizes[lane].sum()) for lane in dealt], np.int64)  # the longest first
        self.steps = int(self.lengths.max(initial=0))
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.place = np.concatenate([np.arange(starts[d], starts[d] + sizes[d], dtype=np.int32) for lane in dealt for d in lane] or [np.zeros(0, np.int32)])
        self.first = np.zeros(len(ids), bool)
        self.first[starts] = True
        self.before = np.empty(len(ids), ids.dtype)
        self.before[1:] = ids[:-1]
        self.before[starts] = end_id

    def running(self, step: int) -> int:
        """Lanes that have a token at a step."""
        return int(np.searchsorted(-self.lengths, -step))

    def window(self, at: int) -> tuple[np.ndarray, list[int]]:
        """Places of ``STEPS`` steps by lane, -1 where a lane has ended, and how many lanes run at each step."""
        n, steps = self.running(at), np.arange(at, min(at + STEPS, self.steps))[:, None]
        inside = steps < self.lengths[:n]
        place = self.place[np.minimum(self.begin[:n] + steps, len(self.place) - 1)]
        return np.where(inside, place, -1), inside.sum(1).tolist()


def _forward(w: Weights, gates_in: np.ndarray, reset: np.ndarray | None, h: np.ndarray, keep: list | None) -> np.ndarray:
    """One step of the gated unit for the running lanes."""
    if reset is not None:
        h = np.where(reset[:, None], np.float32(0), h)
    a = h @ w["wh"]
    zr = _sigmoid(gates_in[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    ah = a[:, 2 * HIDDEN :]
    n = np.tanh(gates_in[:, 2 * HIDDEN :] + r * ah)
    new = n + z * (h - n)
    if keep is not None:
        keep.append((h, z, r, ah, n))
    return new


def _softmax(x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The softmax of each row, and the log-probability of its target. Overwrites ``x``.

    Values are held within ``CLIP``, so no row needs its greatest value taken off first.
    """
    np.clip(x, -CLIP, CLIP, out=x)
    hit = x[np.arange(len(x)), target]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], np.float32)
    x *= (1 / total)[:, None]
    return x, hit - np.log(total)


def _outputs(w: Weights, hs: np.ndarray, target: np.ndarray, grads: Weights | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability of each target; with ``grads``, also the loss's slope in ``hs``."""
    cls = np.where(target == REST, CLASSES, target // SIZE)
    g, out = _softmax(hs @ w["wc"] + w["bc"], cls)
    slope = None
    if grads is not None:
        g[np.arange(len(target)), cls] -= 1
        grads["wc"] += hs.T @ g
        grads["bc"] += np.ones(len(g), np.float32) @ g
        slope = g @ w["wc"].T
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    edge = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    inner = order[: edge[CLASSES]]
    xs, ts = hs[inner], target[inner] % SIZE
    lps = np.empty(len(inner), np.float32)
    back = np.empty((len(inner), HIDDEN), np.float32) if grads is not None else None
    for k in range(CLASSES):
        a, b = edge[k], edge[k + 1]
        if a == b:
            continue
        x, t = xs[a:b], ts[a:b]
        g, lps[a:b] = _softmax(x @ w["wo"][k] + w["bo"][k], t)
        if grads is not None:
            g[np.arange(b - a), t] -= 1
            grads["wo"][k] += x.T @ g
            grads["bo"][k] += np.ones(b - a, np.float32) @ g
            np.matmul(g, w["wo"][k].T, out=back[a:b])
    out[inner] += lps
    if grads is not None:
        slope[inner] += back
    return out, slope


def _gradients(w: Weights, prev: list, target: list, reset: list, h0: np.ndarray) -> tuple[Weights, np.ndarray]:
    """Gradients over one window of steps, and the state after it. Lanes that end drop off at the right."""
    grads = {k: np.zeros(s, np.float32) for k, s in _SHAPES.items()}
    kept: list = []
    states, h = [], h0
    given = w["embed"][np.concatenate(prev)]
    gates, at = given @ w["wx"] + w["b"], 0
    for p, r in zip(prev, reset, strict=True):
        h = _forward(w, gates[at : at + len(p)], r if r.any() else None, h[: len(p)], kept)
        at += len(p)
        states.append(h)
    hs, ts = np.concatenate(states), np.concatenate(target)
    _, slope = _outputs(w, hs, ts, grads)
    assert slope is not None
    # what does not depend on later steps, for all steps at once
    olds, z, r, ah, n = (np.concatenate([k[i] for k in kept]) for i in range(5))
    to_z, to_n, to_r = (olds - n) * z * (1 - z), (1 - z) * (1 - n * n), ah * r * (1 - r)
    da = np.empty((at, 3 * HIDDEN), np.float32)
    dns = np.empty((at, HIDDEN), np.float32)
    back, wh_t = np.zeros((0, HIDDEN), np.float32), np.ascontiguousarray(w["wh"].T)
    for t in reversed(range(len(prev))):
        own = slice(at - len(prev[t]), at)
        at = own.start
        dh = slope[own]
        dh[: len(back)] += back
        dn = np.multiply(dh, to_n[own], out=dns[own])
        some = da[own]
        np.multiply(dh, to_z[own], out=some[:, :HIDDEN])
        np.multiply(dn, to_r[own], out=some[:, HIDDEN : 2 * HIDDEN])
        np.multiply(dn, r[own], out=some[:, 2 * HIDDEN :])
        back = some @ wh_t
        back += dh * z[own]
        if reset[t].any():
            back[reset[t]] = 0
    p = np.concatenate(prev)
    grads["wh"] += olds.T @ da
    da[:, 2 * HIDDEN :] = dns
    dg = da
    grads["b"] += np.ones(len(dg), np.float32) @ dg
    grads["wx"] += given.T @ dg
    de = dg @ w["wx"].T
    order = np.argsort(p, kind="stable")
    s = p[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    grads["embed"][s[first]] = np.add.reduceat(de[order], first, axis=0)
    return {k: g / np.float32(len(ts)) for k, g in grads.items()}, states[-1]


class Trainer:
    """Adam over windows of the documents that come in."""

    def __init__(self, w: Weights, rate: float = RATE):
        self.w, self.rate, self.seen, self.step = {k: v.copy() for k, v in w.items()}, rate, 0, 0
        self.m = {k: np.zeros_like(v) for k, v in w.items()}
        self.v = {k: np.zeros_like(v) for k, v in w.items()}

    def learn(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, end_id: int) -> None:
        s = Streams(ids, starts, sizes, LANES, end_id)
        h = np.zeros((len(s.lengths), HIDDEN), np.float32)
        for at in range(0, s.steps, STEPS):
            place, running = s.window(at)
            some = [row[:n] for row, n in zip(place, running, strict=True)]
            grads, h = _gradients(self.w, [s.before[p] for p in some], [ids[p] for p in some], [s.first[p] for p in some], h)
            self.step += 1
            scale = self.rate * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
            for k, g in grads.items():
                self.m[k] += np.float32(0.1) * (g - self.m[k])
                self.v[k] += np.float32(0.01) * (g * g - self.v[k])
                self.w[k] -= np.float32(scale) * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-7))
        self.seen += len(ids)


def log_probabilities(w: Weights, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, end_id: int, lane_count: int = LANES) -> np.ndarray:
    """Natural log-probability of every token, each document from its start with the state carried through."""
    s = Streams(ids, starts, sizes, lane_count, end_id)
    gates = w["embed"] @ w["wx"] + w["b"]
    out = np.zeros(len(ids))
    h = np.zeros((len(s.lengths), HIDDEN), np.float32)
    states, places, waiting = [], [], 0
    for at in range(0, s.steps, STEPS):
        some, running = s.window(at)
        given, fresh = gates[s.before[some]], s.first[some] & (some >= 0)
        any_fresh = fresh.any(1)
        for t, n in enumerate(running):
            h = _forward(w, given[t, :n], fresh[t, :n] if any_fresh[t] else None, h[:n], None)
            states.append(h)
            places.append(some[t, :n])
            waiting += n
        if waiting >= 1 << 15 or at + STEPS >= s.steps:
            all_p = np.concatenate(places)
            out[all_p] = _outputs(w, np.concatenate(states), ids[all_p], None)[0]
            states, places, waiting = [], [], 0
    return out


# ---- jobs -------------------------------------------------------------------------------------


def _chunks(batches, *names: str):
    """Documents of about ``CHUNK_BYTES``: texts, and the other columns, of consecutive batches."""
    for b in batches:
        texts = b.column("text").to_pylist()
        sizes = [len(t or "") for t in texts]
        for lo, hi in blocks(sizes, CHUNK_BYTES):
            yield texts[lo:hi], [b.column(n).slice(lo, hi - lo) for n in names]


def _ids(lex: Lexicon, texts: list[str | None]):
    """Per block: model ids and table places of its tokens, their keys, and the document of each."""
    for lo, _, keys, doc in tokens(texts):
        at = lex.find(keys)
        ids = np.where(at >= 0, lex.ids[at] if len(lex.ids) else REST, REST)
        yield ids.astype(np.int32), at, keys, (doc + lo).astype(np.int32)


def _end_id(lex: Lexicon) -> int:
    at = lex.find(np.array([END]))[0]
    return int(lex.ids[at]) if at >= 0 else REST


def train(docs: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> Weights:
    """Weights learned from all training documents of ``docs``."""
    spark = docs.sparkSession
    w = initial(lex)
    own = lex.ids < VOCAB
    words = Lexicon(lex.keys[own], lex.counts[own], lex.ids[own], lex.total, lex.distinct)
    end = _end_id(words)
    share = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(rounds))
    for i in range(rounds):
        given = spark.sparkContext.broadcast((w, words))

        def run(batches, given=given):
            start, lex = given.value
            trainer = Trainer(start)
            for texts, _ in _chunks(batches):
                parts = [(ids, doc) for ids, _, _, doc in _ids(lex, texts)]
                ids = np.concatenate([p[0] for p in parts])
                sizes = np.bincount(np.concatenate([p[1] for p in parts]), minlength=len(texts))
                trainer.learn(ids, np.cumsum(sizes) - sizes, sizes, end)
            if trainer.seen:
                flat = flatten(trainer.w).astype(np.float64) * trainer.seen
                at = pa.array(np.arange(len(flat) + 1))
                yield pa.RecordBatch.from_arrays([at, pa.array(np.concatenate([flat, [trainer.seen]]))], ["i", "x"])

        part = docs.where(~held_out()).where(share == i).select("text")
        sums = part.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()  # one row for each weight
        if sums.num_rows:
            flat = sums.column("x").to_numpy()[np.argsort(sums.column("i").to_numpy())]
            w = unflatten(flat[:-1] / flat[-1])
    return w


def score(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``."""
    spark = docs.sparkSession
    counts = materialize(token_counts(docs))
    lex = lexicon(counts)
    w = train(docs, lex)
    end = _end_id(lex)
    given = spark.sparkContext.broadcast((w, lex))

    def run(batches):
        w, lex = given.value
        logs = np.log10(lex.counts + 0.5)
        for texts, (ids_col,) in _chunks(batches, "doc_id"):
            n = len(texts)
            known, sure, model_rest, own_rest = (np.zeros(n) for _ in range(4))
            parts, tails, times, tail_sizes = [], [], [], np.zeros(n, np.int64)
            for ids, at, keys, doc in _ids(lex, texts):
                parts.append((ids, doc))
                begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))  # every document has a token
                own = doc[begin]
                found, other = at >= 0, ids == REST
                value = np.where(found, logs[at] if len(logs) else 0, 0)
                known[own] = np.add.reduceat(found, begin, dtype=np.int64)
                sure[own] = np.add.reduceat(value, begin)
                model_rest[own] = np.add.reduceat(np.where(other, value, 0), begin)
                own_rest[own] = np.add.reduceat(other, begin, dtype=np.int64)
                lost = np.flatnonzero(~found)
                d, k = doc[lost], keys[lost]
                order = np.lexsort((k, d))
                d, k = d[order], k[order]
                new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])])) if len(d) else lost
                tails.append(k[new].view(np.int64))
                times.append(np.diff(np.concatenate([new, [len(d)]])))
                tail_sizes += np.bincount(d[new], minlength=n)
            offsets = pa.array(np.concatenate([[0], np.cumsum(tail_sizes)]).astype(np.int32))
            listed = lambda x: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int64)))
            ids, doc = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            sizes = np.bincount(doc, minlength=n)
            lp = log_probabilities(w, ids, np.cumsum(sizes) - sizes, sizes, end)
            yield pa.RecordBatch.from_arrays(
                [
                    ids_col,
                    pa.array(sizes.astype(np.int64)),
                    *(pa.array(x.astype(np.int64)) for x in (known, own_rest)),
                    *(pa.array(x) for x in (sure, model_rest, np.add.reduceat(lp, np.cumsum(sizes) - sizes) / np.log(10))),
                    listed(tails),
                    listed(times),
                ],
                ["doc_id", "n", "known", "n_rest", "sure", "rest", "lp", "tail", "times"],
            )

    kind = "doc_id long, n long, known long, n_rest long, sure double, rest double, lp double, tail array<long>, times array<long>"
    part = materialize(docs.select("doc_id", "text").mapInArrow(run, kind).withColumn("row", F.monotonically_increasing_id()))
    each = part.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("h"), F.col("x.times").alias("times"))
    met = each.join(counts, "h", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("far"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("far_known"),
    )
    far = F.coalesce("far", F.lit(0.0))
    return part.drop("tail", "times").join(met, "row", "left").select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("sure") + far - F.col("n") * float(np.log10(lex.whole))).alias("base_score"),
        (F.col("lp") + F.col("rest") + far - F.col("n_rest") * float(np.log10(lex.rest))).alias("score"),
    )


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
