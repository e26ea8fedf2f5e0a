"""SimHash near-duplicates by multi-index hashing.

A fingerprint bit is 1 if it is set in over half of the hashes of the word shingles. Two
fingerprints link at ``RADIUS`` = 2 or fewer differing bits. Each is cut into two segments of 32
bits; a pair that links either differs in at most one bit of the first segment, or agrees on the
second. So the first table is probed with the ball of radius one around a segment, the second
with the segment itself, and the table's matches are verified on the complete fingerprint. A
probe clears a set bit only: of two segments that differ in one bit, one finds the other.

A segment value that more than ``BUCKET`` different fingerprints share would yield too many
pairs. Its fingerprints are linked exactly another way: two fingerprints differ in at most two
bits if and only if some word lies within one bit of both, so each is listed under the 65 words of
its ball, and each word links its at most 65 fingerprints to the smallest.

Equal fingerprints are merged before any of this, so copies cost nothing.

Defined cases: null and empty texts have no words and the fingerprint zero, which links like any
other; fewer words than a shingle form one shingle; rows without an id get a fingerprint but
never name a component unless no linked row has an id (then null); repeated rows stay repeated;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialize, table
from .substrings import keyed, with_keys

BUCKET = 64


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint of a whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(width, len(words)) - 1
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts[: len(starts) - last].tolist(), ends[last:].tolist(), strict=True)], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 13):  # pieces keep the unpacked bits small
        piece = hashes[at : at + (1 << 13)].astype("<u8").view(np.uint8).reshape(-1, 8)
        # eight rows of bits at a time add up in one byte, bit by bit
        set_bits += np.unpackbits(piece, axis=1, bitorder="little").sum(0, dtype=np.int64)
    on = np.flatnonzero(2 * set_bits > len(hashes))
    return int(sum(1 << int(i) for i in on))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """Rows ``(doc_id, k, th, fp long)``: row keys, and the fingerprint as a signed number of the same bits."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "k", "th")), pa.array(fp.view(np.int64))], ["doc_id", "k", "th", "fp"])

    return keyed(docs).mapInArrow(run, "doc_id long, k long, th long, fp long")


def ball(x, bits: int):
    """The values that ``x`` and a cleared bit of it give."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    return F.transform(F.filter(F.concat(F.array(F.lit(0).cast("long")), flips), lambda m: x.bitwiseAND(m) == m), lambda m: x.bitwiseXOR(m))


def links(found: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Pairs ``(a, b)`` that connect what links among the distinct fingerprints ``found(fp)``."""
    if radius != 2:
        raise ValueError("the segments and balls here are those of radius 2")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    high = F.shiftrightunsigned("fp", 32)
    probe = found.select(
        "fp",
        F.explode(
            F.concat(
                F.transform(ball(high, 32), lambda k: F.struct(F.lit(0).alias("t"), k.alias("k"))),
                F.array(F.struct(F.lit(1).alias("t"), low.alias("k"))),
            )
        ).alias("p"),
    ).select(F.col("fp").alias("a"), "p.t", "p.k")
    stored = found.select(
        "fp", F.explode(F.array(F.struct(F.lit(0).alias("t"), high.alias("k")), F.struct(F.lit(1).alias("t"), low.alias("k")))).alias("p")
    ).select(F.col("fp").alias("b"), "p.t", "p.k")
    full = materialize(stored.groupBy("t", "k").count().where(F.col("count") > bucket).select("t", "k"))
    small = stored.join(full, ["t", "k"], "left_anti")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = probe.join(small, ["t", "k"]).where("a <> b").where(near).select("a", "b")
    # all that touch a full bucket, as stored or as probing
    crowded = probe.join(full, ["t", "k"], "left_semi").select(F.col("a").alias("fp")).union(
        stored.join(full, ["t", "k"], "left_semi").select(F.col("b").alias("fp"))
    ).distinct()
    words = F.concat(
        F.array(F.col("fp")),
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))),
    )
    listed = crowded.select("fp", F.explode(words).alias("word"))
    least = listed.groupBy("word").agg(F.min("fp").alias("b"), F.max("fp").alias("z")).where("b < z").select("word", "b")
    stars = listed.join(least, "word").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(stars)


def classes(prints: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Rows ``(fp, component, component_id)``: for each different fingerprint its group, and the smallest doc_id in it."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    grouped = components(links(distinct.select("fp"), radius, bucket)).withColumnRenamed("node", "fp")
    tagged = distinct.join(grouped, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = tagged.groupBy("component").agg(F.min("least").alias("component_id"))
    return tagged.join(ids, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """Rows ``(doc_id, fingerprint, component_id)`` for every row of ``docs``."""
    prints = materialize(fingerprints(docs, width))
    joined = prints.join(classes(prints), "fp")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3) -> DataFrame:
    """The row of smallest id, then smallest hash of its text, of each group of linked rows, with all columns."""
    prints = materialize(fingerprints(docs, width))
    tagged = prints.join(classes(prints), "fp")
    first = tagged.groupBy("component").agg(F.min(F.struct("k", "th")).alias("x"))
    mine, k, th = with_keys(docs)
    return mine.join(first.select(F.col("x.k").alias(k), F.col("x.th").alias(th)), [k, th], "left_semi").dropDuplicates([k, th]).drop(k, th)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
