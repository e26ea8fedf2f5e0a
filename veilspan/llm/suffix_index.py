"""Long repeats of bytes by a logarithmic family of indexes of hashed suffix anchors, which stand for suffix arrays.

A suffix is kept where a text has an anchor: of the ``LENGTH`` - ``SEED`` + 1 seeds (strings of
``SEED`` bytes) in a window of ``LENGTH`` bytes, the one of least hash, the last of equals. Each
window has one anchor, equal windows have it at the same place, and an anchor owns the windows
around it. An entry is an anchor with the context that its windows span. A batch's array lists
its entries in the order of the seed's hash and the context's hash, then of document and place,
so equal suffixes stand together and the earliest comes first.

Batches come in document order, ``FEWEST`` of them and one more each time that the corpus doubles
from ``BATCH_BYTES`` on. Each new array is merge-scanned, in that order, with the levels that exist:
an entry whose context stands earlier is a repeat with all its windows; different contexts of one
seed are contested. A level keeps the first entry of each context; levels of equal rank merge into
one of the next, so there are at most as many as the logarithm of the batches.

Contested contexts are read again from the texts and their windows compared by content, seed by
seed. A seed with over ``CROWD`` contexts is compared window by window instead, so that no task
gathers it.

Defined cases: a null text is empty; rows of equal id and text count as one document, so none repeats
another, and get equal results, rows of equal id and different text are ordered by the text's hash; a row without an id
precedes all others; texts shorter than ``LENGTH`` keep all; contexts of one seed are told apart by
hashes modulo 2**61 - 1; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .rolling import Prefix, _SYMBOL, blocks, byte_prefix

LENGTH = 100
SEED = 28
FEWEST = 4
BATCH_BYTES = 1 << 30
CROWD = 1000
#: Bytes of text that anchors are sought in at once; about a hundred bytes of memory each.
BLOCK = 1 << 20


def batch_count(size: int) -> int:
    """Batches for a corpus of ``size`` bytes."""
    return FEWEST + max(0, int(np.log2(max(1, size) / BATCH_BYTES)))


_ENTRY = "key long, ctx long, k long, tb long, lo int, n int"


def keyed(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with the order of rows: the id, then the text's hash."""
    return docs.select(
        "doc_id",
        "text",
        F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("k"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tb"),
    )


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of the least, the last of equals."""
    at, best, span = np.arange(len(values), dtype=np.int32), values, 1
    while span < width:
        step = min(span, width - span)
        right = best[step:] <= best[:-step]
        at = np.where(right, at[step:], at[:-step])
        best = np.where(right, best[step:], best[:-step])
        span += step
    return at


class Block:
    """Texts of a block, end to end, and the entries of their anchors."""

    def __init__(self, texts: list[bytes], length: int, seed: int):
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(sizes) - sizes
        self.prefix = byte_prefix(self.raw)
        total = len(self.raw)
        empty = np.zeros(0, np.int64)
        if total < length:
            self.doc = self.lo = self.n = empty
            self.key = self.context = np.zeros(0, np.uint64)
            return
        doc = np.repeat(np.arange(len(texts)), sizes)
        seeds = np.arange(total - seed + 1)
        hashed = self.prefix.runs(seeds, seeds + seed)
        anchor = _least(hashed, length - seed + 1)
        whole = np.flatnonzero(np.arange(len(anchor)) + length <= (self.first + sizes)[doc[: len(anchor)]])
        a = anchor[whole]
        new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else empty
        lo = whole[new]
        self.n = np.diff(np.concatenate([new, [len(a)]]))
        self.doc, self.key = doc[lo], hashed[a[new]]
        self.context = self.prefix.runs(lo, lo + self.n + length - 1)
        self.lo = lo - self.first[self.doc]


def _split(b: pa.RecordBatch, *names: str):
    raw = [(t or "").encode() for t in b.column("text").to_pylist()]
    for lo, hi in blocks([len(t) for t in raw], BLOCK):
        yield raw[lo:hi], *(b.column(n).slice(lo, hi - lo) for n in names)


def _once(b: pa.RecordBatch) -> pa.RecordBatch:
    """The first of the rows of each (k, tb) in ``b``."""
    first = {x: i for i, x in reversed(list(enumerate(zip(b.column("k").to_pylist(), b.column("tb").to_pylist(), strict=True))))}
    return b if len(first) == len(b) else b.take(pa.array(sorted(first.values())))


def _spread(*parts: np.ndarray) -> np.ndarray:
    """Keys of their own for rows that need not meet others."""
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h + p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def suffix_array(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Entries of the anchors of ``docs``, see :func:`keyed`; n < 0 for one that repeats another of its block."""

    def run(batches):
        for b in batches:
            for raw, k_col, tb_col in _split(_once(b), "k", "tb"):
                e = Block(raw, length, seed)
                k, tb = k_col.to_numpy()[e.doc], tb_col.to_numpy()[e.doc]
                order = np.lexsort((e.lo, tb, k, e.context, e.key))
                same = np.zeros(len(order), bool)
                same[1:] = (e.key[order][1:] == e.key[order][:-1]) & (e.context[order][1:] == e.context[order][:-1])
                later = np.zeros(len(order), bool)
                later[order] = same
                key = np.where(later, _spread(k, tb, e.lo), e.key.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key),
                        pa.array(e.context.view(np.int64)),
                        pa.array(k),
                        pa.array(tb),
                        pa.array(e.lo.astype(np.int32)),
                        pa.array(np.where(later, -e.n, e.n).astype(np.int32)),
                    ],
                    ["key", "ctx", "k", "tb", "lo", "n"],
                )

    return docs.mapInArrow(run, _ENTRY)


class Family:
    """Levels of the index: (rank, first entries of contexts), largest first."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, array: DataFrame, last: bool = False) -> DataFrame:
        """Scan a new array against itself and all levels; the entries that repeat or are contested.

        Columns of an entry, and what: 1 its windows stand earlier, 2 contested; crowd: over
        ``CROWD`` entries share the seed. The array becomes a level, unless it is the last.
        """
        stored = [level.select(*array.columns, F.lit(True).alias("old")) for _, level in self.levels]
        merged = array.withColumn("old", F.lit(False))
        for level in stored:
            merged = merged.union(level)
        seed = Window.partitionBy("key")
        # rows of equal id and text in different blocks give equal entries, which have the same rank
        order = Window.partitionBy("key", "ctx", "n").orderBy("k", "tb", "lo")
        told = merged.select(
            "*",
            (F.rank().over(order) > 1).alias("again"),
            ((F.min(F.struct("ctx", "n")).over(seed) != F.max(F.struct("ctx", "n")).over(seed))).alias("several"),
            (F.count(F.lit(1)).over(seed) > CROWD).alias("crowd"),
        )
        what = F.when((F.col("n") < 0) | F.col("again"), 1).when(F.col("several"), 2).otherwise(0)
        scanned = told.select(*array.columns, "old", "crowd", what.alias("what")).where(~F.col("old") | (F.col("what") == 2))
        scan = materialize(scanned.where("what > 0") if last else scanned)
        if not last:
            rank, fresh = 0, scan.where("not old and what <> 1").select(*array.columns)
            while self.levels and self.levels[-1][0] == rank:
                fresh = fresh.union(self.levels.pop()[1])
                rank += 1
            self.levels.append((rank, materialize(fresh.repartition("key").sortWithinPartitions("key", "ctx")) if rank else fresh))
        return scan.where("what > 0")


def _contexts(docs: DataFrame, contested: DataFrame, length: int) -> DataFrame:
    """Rows ``(route, k, tb, lo, n, single, said)``: contested contexts by seed, or single windows of crowded ones by their hash.

    ``said`` holds a context's bytes or a window's second hash; rows with n < 0 repeat another of their block.
    """
    packed = F.struct("key", "lo", "n", "crowd")
    wanted = contested.groupBy("k", "tb").agg(F.collect_list(packed).alias("wanted"))

    def run(batches):
        for b in batches:
            for raw, k_col, tb_col, wanted_col in _split(_once(b), "k", "tb", "wanted"):
                route, k, tb, lo, n, single, said = [], [], [], [], [], [], []
                crowded = []
                for text, kk, tt, some in zip(raw, k_col.to_pylist(), tb_col.to_pylist(), wanted_col.to_pylist(), strict=True):
                    for e in some:
                        piece = text[e["lo"] : e["lo"] + e["n"] + length - 1]
                        if e["crowd"]:
                            crowded.append((kk, tt, e["lo"], e["n"], piece))
                            continue
                        route.append(e["key"]), k.append(kk), tb.append(tt), lo.append(e["lo"]), n.append(e["n"]), single.append(False), said.append(piece)
                if crowded:
                    crowded.sort()
                    ck, ct, cl, h, g = _window_hashes(crowded, length, True)
                    order = np.lexsort((np.arange(len(h)), g, h))
                    later = np.zeros(len(h), bool)
                    later[order[1:]] = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
                    route += np.where(later, _spread(ck, ct, cl), h.view(np.int64)).tolist()
                    k, tb, lo = k + ck.tolist(), tb + ct.tolist(), lo + cl.tolist()
                    n += np.where(later, -1, 1).tolist()
                    single += [True] * len(h)
                    said += [x.tobytes() for x in g]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(route, pa.int64()), pa.array(k, pa.int64()), pa.array(tb, pa.int64()),
                        pa.array(lo, pa.int32()), pa.array(n, pa.int32()), pa.array(single, pa.bool_()), pa.array(said, pa.binary()),
                    ],
                    ["route", "k", "tb", "lo", "n", "single", "said"],
                )

    return docs.join(wanted, ["k", "tb"]).select("doc_id", "text", "k", "tb", "wanted").mapInArrow(run, "route long, k long, tb long, lo int, n int, single boolean, said binary")


def _window_hashes(entries: list[tuple], length: int, second: bool = False):
    """Document, place and hash of every window of contexts (k, tb, lo, n, bytes); with ``second`` another hash too."""
    symbols = _SYMBOL[np.frombuffer(b"".join(e[4] for e in entries), np.uint8)]
    n = np.array([e[3] for e in entries], np.int64)
    base = np.cumsum(n + length - 1) - (n + length - 1)
    own = np.repeat(np.arange(len(entries)), n)
    step = np.arange(len(own)) - (np.cumsum(n) - n)[own]
    at = base[own] + step
    k, tb, lo = (np.array([e[i] for e in entries], np.int64) for i in range(3))
    return k[own], tb[own], lo[own] + step, *(Prefix(symbols, other).runs(at, at + length) for other in (False, True)[: 1 + second])


def _resolve(rows: DataFrame, length: int) -> DataFrame:
    """Runs ``(k, tb, lo, n)`` of contested windows that stand earlier under the same route."""

    def settle(table: list[tuple]) -> pa.RecordBatch:
        """Whole groups of rows (route, k, tb, lo, n, said) of contexts, in order."""
        # rows of equal id and text in different blocks say the same
        table = table[:1] + [r for before, r in zip(table, table[1:]) if before[:4] != r[:4]]
        out, plain = [], [r[1:] for r in table]
        if plain:
            k, tb, lo, h = _window_hashes(plain, length)
            order = np.lexsort((np.arange(len(h)), h))
            later = np.zeros(len(h), bool)
            later[order[1:]] = h[order][1:] == h[order][:-1]
            i = np.flatnonzero(later)
            if len(i):
                new = np.concatenate([[True], (np.diff(i) != 1) | (np.diff(lo[i]) != 1) | (np.diff(k[i]) != 0) | (np.diff(tb[i]) != 0)])
                first = np.flatnonzero(new)
                size = np.diff(np.concatenate([first, [len(i)]]))
                out += zip(k[i[first]].tolist(), tb[i[first]].tolist(), lo[i[first]].tolist(), size.tolist(), strict=True)
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["k", "tb", "lo", "n"])

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            for at in range(0, len(b), 4096):
                held += zip(*(c.to_pylist() for c in b.slice(at, 4096).columns), strict=True)
                cut = len(held)
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                if cut:
                    yield settle(held[:cut])
                    held = held[cut:]
        if held:
            yield settle(held)

    ordered = rows.where("not single").drop("single").repartition("route").sortWithinPartitions("route", "k", "tb", "lo")
    # of equal single windows all but the first; rows of equal id and text have one rank
    rank = F.rank().over(Window.partitionBy("route", "said").orderBy("k", "tb", "lo"))
    single = rows.where("single").select("k", "tb", "lo", "n", rank.alias("rank")).where("n < 0 or rank > 1")
    return ordered.mapInArrow(run, "k long, tb long, lo int, n int").union(single.select("k", "tb", "lo", F.lit(1).alias("n")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, batches: int | None = None) -> DataFrame:
    """Rows ``(doc_id, n_bytes, n_removed, n_spans, kept)`` for every row of ``docs``."""
    own = keyed(docs)
    family, scans = Family(), []
    if batches is None:
        batches = batch_count(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    inner = [i / batches for i in range(1, batches)]
    bounds = docs.where("doc_id is not null").stat.approxQuantile("doc_id", inner, 0.001) if inner else []
    edges = [None, *sorted({int(x) for x in bounds}), None]
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        part = own  # filters on the id itself, which reach the files
        if lo is not None:
            part = part.where(F.col("doc_id") >= lo)
        if hi is not None:
            part = part.where((F.col("doc_id") < hi) if lo is not None else F.col("doc_id").isNull() | (F.col("doc_id") < hi))
        scans.append(family.add(suffix_array(part.select("text", "k", "tb"), length, seed), last=i == len(edges) - 2))
    found = scans[0]
    for s in scans[1:]:
        found = found.union(s)
    contested = found.where("what = 2").groupBy("key", "k", "tb", "lo", "n").agg(F.max("crowd").alias("crowd"))
    # a seed that is crowded for one scan is so for all
    crowds = found.where("what = 2 and crowd").select("key").distinct().withColumn("all", F.lit(True))
    contested = contested.join(crowds, "key", "left").select("key", "k", "tb", "lo", "n", F.coalesce("all", F.lit(False)).alias("crowd"))
    resolved = _resolve(materialize(_contexts(own, contested, length)), length)
    runs = found.where("what = 1").select("k", "tb", "lo", F.abs("n").alias("n")).union(resolved)
    packed = F.col("lo").cast("long") * F.lit(1 << 31) + F.col("n")
    gone = runs.groupBy("k", "tb").agg(F.collect_set(packed).alias("gone"))

    def cut(batches):
        for b in batches:
            for raw, ids, gone_col in _split(b, "doc_id", "gone"):
                n_removed, n_spans, kept = [], [], []
                for text, some in zip(raw, gone_col, strict=True):
                    if not some.is_valid:
                        n_removed.append(0), n_spans.append(0), kept.append(text)
                        continue
                    p = some.values.to_numpy()
                    edge = np.zeros(len(text) + 1, np.int32)
                    np.add.at(edge, p >> 31, 1)
                    np.add.at(edge, (p >> 31) + (p & ((1 << 31) - 1)) + length - 1, -1)
                    off = np.cumsum(edge[:-1]) > 0
                    n_removed.append(int(off.sum()))
                    n_spans.append(int((off & ~np.concatenate([[False], off[:-1]])).sum()))
                    kept.append(np.frombuffer(text, np.uint8)[~off].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(x, pa.int64()) for x in ([len(t) for t in raw], n_removed, n_spans)), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    joined = own.join(gone, ["k", "tb"], "left").select("doc_id", "text", "k", "tb", "gone")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
