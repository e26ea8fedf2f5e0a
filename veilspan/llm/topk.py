"""Exact top-k inner-product search in three phases with a uniform threshold.

The components of a vector are split into ``PARTS`` lists; a vector's score is the sum of its
partial scores in the lists. Phase one gathers, from the first ``FIRST`` rows of each shard, the
best entries of each list and resolves just their scores: the k-th best of any rows is a safe
cutoff for all. Phase two broadcasts it; an entry can only reach the cutoff c if one of its
partial scores is at least c / PARTS, so each shard goes through the lists of all its rows and
collects just these entries. Phase three resolves them: it adds up their partial scores exactly.
So every list of every row is worked out once, and totals only of the entries collected.

Equal vectors share their scores, so they are searched once and carry the k + 1 smallest ids,
which is all that a query can need of them. Queries of equal id and vector are searched once too,
and their results joined back to the rows. Different ones come in blocks of about ``BLOCK``, each
small enough to broadcast; every block is searched against all rows.

Defined cases: vectors that are null, or hold null or non-finite components, and rows without an
id take no part; a vector is compared with those of its own length only, and one of length zero
scores 0; each repeated query row gets its own result rows, and leaves out itself once; ties go
to the smaller id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

PARTS = 4
BLOCK = 4096
#: Rows of a shard that the cutoff is drawn from; any number gives the same results.
FIRST = 1024


def quantize(vectors: DataFrame, scale: float = 1024.0) -> DataFrame:
    """Rows ``(vec_id, v array<long>)`` of the vectors that take part: floor(scale * component)."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v")
    )


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """Rows ``(v, ids)``: each different vector with its k + 1 smallest ids, ascending."""
    order = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _lists(m: np.ndarray) -> list[np.ndarray]:
    """A matrix of vectors as a matrix for each list of components."""
    return np.array_split(m, PARTS, axis=1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integers: as doubles or 64-bit integers while these hold the sums of all lists, else as Python's."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) * PARTS
    if bound < 2**52:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    if bound < 2**62:
        return a @ b.T
    return a.astype(object) @ b.T.astype(object)


class _Shard:
    """Rows of a batch: vectors by length, and their ids."""

    def __init__(self, batch: pa.RecordBatch):
        v, ids = batch.column("v"), batch.column("ids")
        at, values = v.offsets.to_numpy() - v.offsets[0].as_py(), v.flatten().to_numpy()
        self.id_at, self.ids = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten().to_numpy()
        size = np.diff(at)
        self.by_length = {int(n): np.flatnonzero(size == n) for n in np.unique(size)}
        self.vectors = {n: values[at[rows][:, None] + np.arange(n)] for n, rows in self.by_length.items()}

    def members(self, row: int) -> list[int]:
        return self.ids[self.id_at[row] : self.id_at[row + 1]].tolist()


class _Block:
    """The queries of one block, by the length of their vectors; broadcast to the shards."""

    def __init__(self, queries: list[tuple[int, list[int]]]):
        self.ids = np.array([q for q, _ in queries], np.int64)
        by_length: dict[int, list[int]] = {}
        for i, (_, v) in enumerate(queries):
            by_length.setdefault(len(v), []).append(i)
        self.by_length = {n: np.array(own) for n, own in by_length.items()}
        self.vectors = {n: np.array([queries[i][1] for i in own], np.int64).reshape(len(own), n) for n, own in by_length.items()}

    def pieces(self, shard: _Shard, step: int = 4096):
        """For each length and slice of a shard: queries, rows of the shard, partial scores by list."""
        for n, rows in shard.by_length.items():
            if n not in self.by_length:
                continue
            own, asked = self.by_length[n], _lists(self.vectors[n])
            for at in range(0, len(rows), step):
                mine = _lists(shard.vectors[n][at : at + step])
                for q in range(0, len(own), 256):
                    yield own[q : q + 256], rows[at : at + step], [_product(w[q : q + 256], m) for w, m in zip(asked, mine, strict=True)]


def _total(partial: list[np.ndarray], i: int, entries: np.ndarray) -> np.ndarray:
    """The scores of some entries of query ``i``, within 64 bits."""
    total = sum(p[i][entries] for p in partial)
    return np.clip(total, -(2**63), 2**63 - 1).astype(np.int64) if total.dtype == object else total.astype(np.int64)


def _expand(query: int, scores: np.ndarray, rows: np.ndarray, shard: _Shard, k: int) -> list[tuple[int, int]]:
    """The k best (-score, id) of the members of ``rows``, without the query's own row."""
    if len(rows) > k + 1:  # k + 1 rows, and ties: one may be the query's own
        good = scores >= np.partition(scores, -k - 1)[-k - 1]
        scores, rows = scores[good], rows[good]
    found = []
    for s, row in zip(scores.tolist(), rows.tolist(), strict=True):
        ids = shard.members(row)
        if query in ids:
            ids.remove(query)
        found += [(-s, i) for i in ids]
    return sorted(found)[:k]


def search_block(classes: DataFrame, queries: list[tuple[int, list[int]]], k: int) -> DataFrame:
    """Rows ``(q, vec_id, score)``: the k best of each query, which is ``queries[q]``, and maybe more."""
    spark = classes.sparkSession
    block = spark.sparkContext.broadcast(_Block(queries))

    def emit(rows: list) -> pa.RecordBatch:
        cols = np.array(rows, np.int64).reshape(-1, 3).T
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["q", "vec_id", "score"])

    def gather(batches):
        b, left = block.value, FIRST
        for batch in batches:
            shard, out = _Shard(batch.slice(0, left)), []
            left -= min(left, len(batch))
            for own, rows, partial in b.pieces(shard):
                few = min(k + 1, len(rows))
                tops = [np.argpartition(p, -few, axis=1)[:, -few:] for p in partial]
                for i, q in enumerate(own):
                    entries = np.unique(np.concatenate([t[i] for t in tops]))
                    out += [(q, i2, -s) for s, i2 in _expand(int(b.ids[q]), _total(partial, i, entries), rows[entries], shard, k)]
            yield emit(out)
            if not left:
                return

    def resolve(batches):
        b, cut = block.value, cutoff.value
        for batch in batches:
            shard, out = _Shard(batch), []
            for own, rows, partial in b.pieces(shard):
                share = (cut[own] // PARTS + (cut[own] % PARTS != 0))[:, None]
                enough = np.logical_or.reduce([p >= share for p in partial])
                for i, q in enumerate(own):
                    entries = np.flatnonzero(enough[i])
                    scores = _total(partial, i, entries)
                    good = scores >= cut[q]
                    out += [(q, i2, -s) for s, i2 in _expand(int(b.ids[q]), scores[good], rows[entries[good]], shard, k)]
            yield emit(out)

    kind = "q long, vec_id long, score long"
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    lists = classes.mapInArrow(gather, kind).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    cut = np.full(len(queries), -(2**63), np.int64)
    for row in lists.where(F.col("n") == k).select("q", "score").collect():  # one row for each query of the block
        cut[row.q] = row.score
    cutoff = spark.sparkContext.broadcast(cut)
    return classes.mapInArrow(resolve, kind)


def search(vectors: DataFrame, k: int = 10, every: int = 100, block: int = BLOCK) -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)``: for each row whose id ``every`` divides, its k best other rows."""
    own = quantize(vectors)
    classes = materialize(distinct_vectors(own, k))
    queries = materialize(own.where(F.col("vec_id") % every == 0))
    different = materialize(queries.distinct())
    n_blocks = max(1, -(-different.count() // block))
    out = None
    for i in range(n_blocks):
        asked = different.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)) == i).orderBy("vec_id", "v").collect()
        rows = [(r.vec_id, r.v) for r in asked]
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        best = search_block(classes, rows, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ids = queries.sparkSession.createDataFrame(
            pa.table(
                {
                    "q": pa.array(range(len(rows)), pa.int64()),
                    "query_id": pa.array([r[0] for r in rows], pa.int64()),
                    "v": pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                }
            )
        )
        lists = best.groupBy("q").agg(F.collect_list(F.struct("rank", "vec_id", "score")).alias("best")).join(F.broadcast(ids), "q")  # of one block
        each = queries.withColumnRenamed("vec_id", "query_id").join(F.broadcast(lists), ["query_id", "v"])
        found = each.select("query_id", F.inline("best"))
        out = found if out is None else out.union(materialize(found) if n_blocks > 1 else found)
    return out


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
