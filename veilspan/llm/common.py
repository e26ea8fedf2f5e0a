"""Shared helpers of the training-data operators: input, scratch tables, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word contracts: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: Given names, a default gazetteer; operators take another as a parameter.
GIVEN_NAMES = (
    "Alice Anna Ben Bob Carlos Charlie Clara Daniel David Diana Emily Emma Eva Frank George Grace Hannah Henry Jack James Jane John "
    "Julia Kate Laura Leo Liam Linda Lisa Lucas Maria Mark Mary Michael Mike Nina Noah Olivia Paul Peter Rachel Robert Sam Sara Sarah "
    "Sofia Sophie Susan Thomas Tim Tom William"
).split()

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def free_name(taken: list[str], name: str) -> str:
    """``name``, or with underscores before it, so that no column of ``taken`` has it, whatever its case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only on a local master that has none (as in tests) a temporary folder is made and set; on a
    cluster its executors could not read each other's, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='scratch-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, which cuts its lineage.

    The files survive the loss of any executor; the folder is the cluster's to clean. The job's
    own shuffle files are removed when it ends, since nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/scratch-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of a side that :func:`sized` broadcasts; each is two numbers and, at most, a short list.
SMALL_ROWS = 500_000


def sized(df: DataFrame, size=None) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``SMALL_ROWS`` rows, or that sum of ``size``; else joined by a shuffle."""
    n = df.agg(F.count(F.lit(1)) if size is None else F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= SMALL_ROWS else df


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: rows ``(node, component)``.

    Every node of an edge gets the smallest node that it can reach. Alternating large-star and
    small-star steps; both only group by a node after repeated edges are merged, and the number
    of rounds grows with the logarithm of the longest path. Convergence is exact: the loop ends
    when a round changes no edge. The result has a row for each node that is in an edge between
    different nodes. Edges with a null end or equal ends are ignored.
    """
    e = materialize(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        # large star: link each larger neighbour of a node to the node's smallest neighbour
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: link each smaller neighbour, and the node itself, to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        e = materialize(small.where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
