"""Substring dedup by difference-cover anchors.

Only the word positions of a document whose remainder modulo ``PERIOD`` lies in a difference
cover are hashed: for any two alignments some offset below the period is covered in both. So two
occurrences of a run of ``LENGTH`` words share an anchor, a window of LENGTH - PERIOD + 1 words
that starts at a covered position of both. Anchors that occur once are dropped; a run that holds a
shared anchor extends to its full length and is judged on the hash of all its words.

Both rounds, of anchors and of runs, find which hashes occur more than once: each block of texts
settles those that repeat within it and announces such a hash to the others in a single row. So a
window over one hash sees at most a row for each block, which it spills where they are many.

Anchors only nominate, by 48 bits. A run is judged by two independent hashes modulo 2**61 - 1 of
its words' XXH64, 122 bits, so that no run falls to chance even where positions are counted in
trillions.

Defined cases: a null text has no words; texts of fewer words than a run keep all; repeated rows,
whether of one id or several, repeat each other's runs; null ids are kept; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, table
from .rolling import Prefix, Words, blocks

LENGTH = 35
PERIOD = 21
#: A perfect difference set: its differences give each remainder modulo 21.
COVER = (0, 1, 4, 14, 16)
_ROWS = "h long, g long, k long, th long, pos int, n int"


def _keys() -> tuple:
    """The id, and a hash of the text."""
    return F.coalesce("doc_id", F.lit(-(2**63)).cast("long")), F.xxhash64(F.coalesce("text", F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with a key that tells different rows apart: the id, and a hash of the text."""
    k, th = _keys()
    return docs.select("doc_id", "text", k.alias("k"), th.alias("th"))


def with_keys(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with all its columns and the key of :func:`keyed`, and the key's names, which no column of ``docs`` has."""
    names = [free_name(docs.columns, c) for c in ("k", "th")]
    return docs.withColumns(dict(zip(names, _keys(), strict=True))), *names


def _report(h: np.ndarray, g: np.ndarray, doc: np.ndarray, pos: np.ndarray, k: np.ndarray, th: np.ndarray) -> pa.RecordBatch:
    """Rows for hashes ``h`` and ``g`` at ``pos`` of ``doc``, which are in document and position order.

    n = 0: occurs once here, to be counted; n > 0: the n positions from pos on are known to
    repeat; pos = -1: announces a hash that repeats here.
    """
    order = np.lexsort((g, h))
    s, t = h[order], g[order]
    edge = np.concatenate([[True], (s[1:] != s[:-1]) | (t[1:] != t[:-1]), [True]]) if len(s) else np.array([True])
    at = np.flatnonzero(edge)
    size = np.diff(at)
    many = np.zeros(len(h), bool)
    many[order] = np.repeat(size > 1, size)
    once, told = np.flatnonzero(~many), order[at[:-1][size > 1]]
    own = np.flatnonzero(many)
    if len(own):
        new = np.concatenate([[True], (pos[own][1:] != pos[own][:-1] + 1) | (doc[own][1:] != doc[own][:-1])])
        first = np.flatnonzero(new)
        runs, lengths = own[first], np.diff(np.concatenate([first, [len(own)]]))
    else:
        runs, lengths = own, np.zeros(0, np.int64)
    none = np.zeros(len(told), np.int64)
    # known runs travel under a key of their own, so that they spread
    spread = (th[doc[runs]].astype(np.uint64) + pos[runs].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([h[once].view(np.int64), spread, h[told].view(np.int64)])),
            pa.array(np.concatenate([g[once], np.zeros(len(runs), np.uint64), g[told]]).view(np.int64)),
            pa.array(np.concatenate([k[doc[once]], k[doc[runs]], none])),
            pa.array(np.concatenate([th[doc[once]], th[doc[runs]], none])),
            pa.array(np.concatenate([pos[once], pos[runs], none - 1]).astype(np.int32)),
            pa.array(np.concatenate([np.zeros(len(once)), lengths, none]).astype(np.int32)),
        ],
        ["h", "g", "k", "th", "pos", "n"],
    )


def _repeated(reports: DataFrame) -> DataFrame:
    """Per document ``(k, th, runs)``: what repeats, as an array of pos * 2**31 + n."""
    seen = reports.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("h", "g")))
    run = F.col("pos").cast("long") * F.lit(1 << 31) + F.greatest("n", F.lit(1))  # one number is half of a struct's bytes
    found = seen.where("pos >= 0 and (n > 0 or c > 1)").select("k", "th", run.alias("run"))
    return found.groupBy("k", "th").agg(F.collect_set("run").alias("runs"))


def _unpacked(runs: list | None) -> tuple[np.ndarray, np.ndarray]:
    """First positions and lengths of packed runs."""
    packed = np.array(runs or [], np.int64)
    return packed >> 31, packed & ((1 << 31) - 1)


def _marks(runs: list | None, size: int, stretch: int) -> np.ndarray:
    """Which of ``size`` positions the runs cover, each run going on for ``stretch`` more."""
    edge = np.zeros(size + 1, np.int32)
    pos, n = _unpacked(runs)
    np.add.at(edge, pos, 1)
    np.add.at(edge, np.minimum(pos + n + stretch, size), -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, cover: tuple = COVER) -> DataFrame:
    """Rows ``(doc_id, n_words, n_removed, kept)`` for every row of ``docs``; kept: words joined by a space."""
    if length <= period:
        raise ValueError("a run must be longer than the period")
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("not a difference cover of the period")
    width = length - period + 1
    covered = np.zeros(period, bool)
    covered[list(cover)] = True

    def spread(batches, *names):
        for b in batches:
            raw = [(t or "").encode() for t in b.column("text").to_pylist()]
            for lo, hi in blocks([len(t) for t in raw]):
                yield raw[lo:hi], *(b.column(n).slice(lo, hi - lo) for n in names)

    def anchors(batches):
        for raw, k, th in spread(batches, "k", "th"):
            w = Words(raw)
            i = np.flatnonzero(covered[w.pos % period] & (w.count[w.doc] - w.pos >= width)) if len(w.doc) else np.zeros(0, np.int64)
            h = Prefix(w.hash).runs(i, i + width) & np.uint64((1 << 48) - 1)
            yield _report(h, np.zeros(len(h), np.uint64), w.doc[i], w.pos[i], k.to_numpy(), th.to_numpy())

    def extend(batches):
        for raw, k, th, runs in spread(batches, "k", "th", "runs"):
            w = Words(raw)
            has = np.zeros(len(w.doc) + 1, np.int64)
            for d, found in enumerate(runs.to_pylist()):
                has[w.first[d] : w.first[d] + w.count[d]] = _marks(found, int(w.count[d]), 0)
            upto = np.concatenate([[0], np.cumsum(has)])
            i = np.flatnonzero(w.count[w.doc] - w.pos >= length) if len(w.doc) else np.zeros(0, np.int64)
            i = i[upto[i + period] > upto[i]]
            h, g = (Prefix(w.hash, second).runs(i, i + length) for second in (False, True))
            yield _report(h, g, w.doc[i], w.pos[i], k.to_numpy(), th.to_numpy())

    def cut(batches):
        for raw, ids, runs in spread(batches, "doc_id", "runs"):
            w = Words(raw)
            n_words, n_removed, kept = [], [], []
            for d, found in enumerate(runs.to_pylist()):
                n = int(w.count[d])
                gone = _marks(found, n, length - 1)
                at = w.first[d] + np.flatnonzero(~gone)
                n_words.append(n)
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w.raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    own = keyed(docs)
    shared = materialize(_repeated(own.mapInArrow(anchors, _ROWS)))
    # a whole row that repeats settles itself: its runs are counted once for each of the rows
    candidates = own.join(shared, ["k", "th"]).select("doc_id", "text", "k", "th", "runs")
    repeats = materialize(_repeated(candidates.mapInArrow(extend, _ROWS)))
    joined = own.join(repeats, ["k", "th"], "left").select("doc_id", "text", "k", "th", "runs")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
