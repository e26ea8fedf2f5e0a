"""WARC fixity audit with Merkle trees.

Each page becomes a WARC record. The records of a file, in the order of id, url and hash, cover
ordered offset ranges. A tree node hashes its children's ranges and hashes, ``FANOUT`` of them at
most; above the files' roots further nodes join files up to one root. Two replicas are compared
from the root down, and only children of mismatching nodes are read further, down to records.

Identical rows of a page count as copies of one record entry. The entries are sorted by range over
all tasks and numbered within each range; the ranges' totals, of which a file has one for each
range that it reaches into, then give the places within files. So a file of any size, also one of
an id that repeats in a third of the rows, is spread over many tasks; what is gathered is the
children of one node.

Defined cases: a null url or html counts as empty; rows without an id are spread over ``ODD_FILES``
files of their own, by hash; repeated rows are one entry with its number of copies; an entry that a replica lacks is missing,
one that only the replica has is extra, two different ones of the same id are altered (without an
id they are missing and extra); other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

FILE_IDS = 4096
FANOUT = 16
#: Files of rows without an id, and the number of the first, below those of all ids.
ODD_FILES = 1024
_NO_FILE = -(2**53)


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of the page's WARC record, as text."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def entries(pages: DataFrame, name: str) -> DataFrame:
    """Record entries of one replica: (replica, file, idx, page_id, hash, start, end, copies)."""
    rec = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("r"))
    each = rec.select("page_id", "url", F.sha2("r", 256).alias("hash"), F.octet_length("r").cast("long").alias("size"))
    one = each.groupBy("page_id", "url", "hash", "size").agg(F.count(F.lit(1)).alias("copies"))
    odd = F.lit(_NO_FILE).cast("long") + F.pmod(F.xxhash64("url", "hash"), F.lit(ODD_FILES))
    placed = one.withColumn("file", F.coalesce(F.floor(F.col("page_id") / FILE_IDS), odd))
    order = ["file", "page_id", "url", "hash"]
    ranged = materialize(placed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    bytes_ = F.col("size") * F.col("copies")
    within = Window.partitionBy("file", "part").orderBy(*order)
    local = ranged.withColumns({"i": F.row_number().over(within), "upto": F.sum(bytes_).over(within.rowsBetween(Window.unboundedPreceding, 0))})
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("file", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(bytes_).alias("s"))
    starts = totals.select("file", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"))
    end = F.col("s0") + F.col("upto")
    return local.join(starts, ["file", "part"]).select(
        F.lit(name).alias("replica"), "file", (F.col("n0") + F.col("i") - 1).cast("long").alias("idx"), "page_id", "hash",
        (end - bytes_).alias("start"), end.alias("end"), "copies",
    )


def _parents(level: DataFrame, file: Column, idx: Column) -> DataFrame:
    child = F.struct("file", "idx", F.concat_ws(":", "start", "end", "hash").alias("said"))
    return (
        level.groupBy("replica", file.alias("pf"), idx.alias("pi"))
        .agg(F.sort_array(F.collect_list(child)).alias("c"), F.min("start").alias("start"), F.max("end").alias("end"))
        .select("replica", F.col("pf").alias("file"), F.col("pi").alias("idx"), F.sha2(F.concat_ws(",", "c.said"), 256).alias("hash"), "start", "end")
    )


def _steps(leaves: DataFrame) -> list[tuple[Column, Column]]:
    """For each level above the leaves, a node's parent: first within files, then of files."""
    top = leaves.agg(F.max("idx"), F.max("file")).first()
    steps, most, files = [], top[0] or 0, max(0, top[1] or 0)
    while most > 0:
        steps.append((F.col("file"), F.floor(F.col("idx") / FANOUT)))
        most //= FANOUT
    while True:
        steps.append((F.floor(F.col("file") / FANOUT), F.lit(0).cast("long")))
        if files == 0:
            return steps
        files //= FANOUT


def build(leaves: DataFrame) -> tuple[list[DataFrame], list[tuple[Column, Column]]]:
    """Node tables by level, leaves first, and the parent step of each."""
    steps, levels = _steps(leaves), [leaves]
    for file, idx in steps:
        levels.append(materialize(_parents(levels[-1], file, idx)))
    return levels, steps


def _differing(nodes: DataFrame) -> DataFrame:
    side = lambda name: F.max(F.when(F.col("replica") == name, F.concat_ws(":", "start", "end", "hash")))
    return nodes.groupBy("file", "idx").agg(side("a").alias("a"), side("b").alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "idx")


def descend(levels: list[DataFrame], steps: list[tuple[Column, Column]]) -> DataFrame:
    """The leaves, of both replicas, below nodes that mismatch on every level."""
    open_nodes = _differing(levels[-1])
    for level, (file, idx) in zip(reversed(levels[:-1]), reversed(steps), strict=True):
        below = level.withColumn("pf", file).withColumn("pi", idx)
        nodes = below.join(open_nodes.select(F.col("file").alias("pf"), F.col("idx").alias("pi")), ["pf", "pi"], "left_semi").drop("pf", "pi")
        if level is levels[0]:
            return nodes.join(_differing(nodes), ["file", "idx"], "left_semi")
        open_nodes = materialize(_differing(nodes))
    raise AssertionError("a tree has leaves")


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """Rows ``(page_id, file, start, end, sha256, copies, state)``, one for each entry of either side.

    Positions are those of ``pages``, or of the replica for extra entries. The state is intact,
    altered, missing or extra.
    """
    leaves = materialize(entries(pages, "a").union(entries(replica, "b")))
    odd = materialize(descend(*build(leaves)))
    # shifted entries are equal but for their place: what is left after they cancel out is damage
    ident = [F.coalesce("page_id", F.lit(0)).alias("id"), F.col("page_id").isNull().alias("no_id")]
    kept = odd.groupBy(*ident, "hash").agg(F.sum(F.when(F.col("replica") == "a", F.col("copies")).otherwise(-F.col("copies"))).alias("surplus"))
    damaged = kept.where("surplus <> 0")
    sides = damaged.where("not no_id").groupBy("id", "no_id").agg(F.max(F.col("surplus") > 0).alias("lost"), F.max(F.col("surplus") < 0).alias("found"))
    state = (
        F.when(F.col("no_id"), F.when(F.col("surplus") > 0, "missing").otherwise("extra"))
        .when(F.col("lost") & F.col("found"), "altered")
        .when(F.col("lost"), "missing")
        .otherwise("extra")
    )
    marked = damaged.join(sides, ["id", "no_id"], "left").select("id", "no_id", "hash", "surplus", state.alias("state"))
    own = leaves.select("*", *ident).join(marked, ["id", "no_id", "hash"], "left")
    shown = own.where("replica = 'a' or (state = 'extra' and surplus < 0)").withColumn(
        "n", F.row_number().over(Window.partitionBy("id", "no_id", "hash").orderBy("replica"))
    )
    return shown.where("n = 1").select(
        "page_id", "file", "start", "end", F.col("hash").alias("sha256"), "copies", F.coalesce("state", F.lit("intact")).alias("state")
    )


def damaged_replica(pages: DataFrame) -> DataFrame:
    """A second copy of ``pages`` with known damage, by remainders of the id: a changed first letter, a cut end, a lost row."""
    html = (
        F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("~"), F.substr("html", F.lit(2))))
        .when(F.col("page_id") % 211 == 7, F.substr("html", F.lit(1), F.greatest(F.length("html") - 9, F.lit(0))))
        .otherwise(F.col("html"))
    )
    return pages.where("page_id is null or page_id % 503 <> 11").select("page_id", "url", html.alias("html"))


def op9_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return audit(pages, damaged_replica(pages))


_RECORD = (
    "'WARC/1.0' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '')"
    " || e || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') || e || e"
)
OP9_SQL = f"""
WITH r AS (
  SELECT page_id, url, html, chr(13) || chr(10) AS e FROM pages
), h AS (
  SELECT page_id, coalesce(url, '') AS url, sha256({_RECORD}) AS sha256, strlen({_RECORD}) AS size, count(*) AS copies
  FROM r GROUP BY ALL
), placed AS (
  SELECT *, page_id // {FILE_IDS} AS file,
    CAST(sum(size * copies) OVER (PARTITION BY page_id // {FILE_IDS} ORDER BY page_id, url, sha256 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end"
  FROM h
)
SELECT page_id, file, "end" - size * copies AS start, "end", sha256, copies,
  CASE WHEN page_id % 503 = 11 THEN 'missing'
       WHEN page_id % 97 = 5 OR page_id % 211 = 7 THEN 'altered' ELSE 'intact' END AS state
FROM placed
"""
