"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so that a re-parameterised question has the
template of the original. Windows of ``WIDTH`` template words of the benchmark are hash-joined
with those of the documents. Matched windows of one item at one alignment fill the item's slots;
a slot value of the item must stand for the same value of the document throughout, and the other
way round, else the windows that hold it do not count. A document leaks an item if at least
``COVERAGE`` of the item's windows are found in it.

The benchmark's windows are broadcast if there are at most ``BROADCAST_ROWS``; beyond that both
sides are shuffled by the hash. So are, by their keys, the documents that leak when they are taken out.

Defined cases: null and empty texts leak nothing; an item of fewer words than a window is one
window of all its words and is compared with whole documents of as many words; an item without a
literal word matches nothing; repeated rows of a document give one result row each pair of id and
text; null ids are kept; repeated items each report; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GIVEN_NAMES, materialize, sized, table
from .substrings import keyed, with_keys

WIDTH = 5
COVERAGE = 0.8
BROADCAST_ROWS = 200_000

UNITS = (
    "kg g mg lb lbs oz t km m cm mm mi miles mile feet foot ft inches inch meters metres meter metre l ml litres liters gallons "
    "hours hour hrs h minutes minute min seconds second s days day weeks week months month years year "
    "dollars dollar cents euros euro pounds pound percent degrees degree mph kmh"
).split()
_NUMBER = r"(?<![^\s(\[\"'])[$€£+-]*[0-9](?:[0-9.,:/]*[0-9])?"
_TAIL = r"(?<=[\p{L}\p{N}>])[.,;:!?\"')]+(?=\s|$)"
_BLANK = r"[\x20\x09-\x0D]+"


def name_pattern(names: Sequence[str]) -> str:
    """A given name of the gazetteer, or any capitalised word in the middle of a sentence."""
    return rf"(?=\p{{Lu}})(?:(?<=[\p{{Ll}}\d,;] )\p{{Lu}}\p{{Ll}}+|\b(?:{'|'.join(names)})\b)"


def unit_pattern(units: Sequence[str]) -> str:
    return rf"(?<=<num> |<num>)(?:{'|'.join(sorted(units, key=len, reverse=True))}|%)(?![\p{{L}}\d])"


def template(text: Column, names: Sequence[str] = GIVEN_NAMES, units: Sequence[str] = UNITS) -> Column:
    """The text with typed placeholders, lower-cased, without closing punctuation; white space is kept."""
    named = F.lower(F.regexp_replace(text, name_pattern(names), "<name>"))
    counted = F.regexp_replace(F.regexp_replace(named, _NUMBER, "<num>"), unit_pattern(units), "<unit>")
    return F.regexp_replace(counted, _TAIL, "")


def windows(rows: DataFrame, width: int, names: Sequence[str] = GIVEN_NAMES, units: Sequence[str] = UNITS) -> DataFrame:
    """Each window of ``rows(..., text)``: h, its position, its template words t0.. and raw words r0..

    A text of fewer words yields one window, padded with nulls.
    """
    words = rows.withColumn("_t", F.split(template(F.trim("text"), names, units), _BLANK)).withColumn("_r", F.split(F.trim("text"), _BLANK))
    n = F.greatest(F.size("_t") - (width - 1), F.lit(1))
    parts = [F.slice("_t", i + 1, n) for i in range(width)] + [F.slice("_r", i + 1, n) for i in range(width)]
    columns = [f"t{i}" for i in range(width)] + [f"r{i}" for i in range(width)]
    zipped = F.arrays_zip(*parts)
    keep = [c for c in rows.columns if c != "text"]
    each = words.where("text is not null").select(*keep, F.posexplode(zipped).alias("pos", "w"))
    out = each.select(*keep, "pos", *[F.col("w").getField(str(i)).alias(x) for i, x in enumerate(columns)])
    return out.withColumn("h", F.xxhash64(*[F.col(f"t{i}") for i in range(width)]))


def _is_slot(x: Column) -> Column:
    return x.contains("<num>") | x.contains("<name>") | x.contains("<unit>")


def leaks(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE, broadcast_rows: int = BROADCAST_ROWS,
    names: Sequence[str] = GIVEN_NAMES, units: Sequence[str] = UNITS,
) -> DataFrame:
    """Rows ``(doc_id, th, item_id, n_windows, n_matched)``: documents, by id and hash of the text, and the items they leak.

    A capitalised first word of an item stands as it is where the item opens a sentence, and as a
    name where it follows other words; its window is asked for both ways and counts once.
    """
    words = [f"t{i}" for i in range(width)]
    literal = sum((F.when(F.col(t).isNotNull() & ~_is_slot(F.col(t)) & (F.col(t) != ""), 1).otherwise(0) for t in words), F.lit(0))
    asked = windows(benchmark.select("item_id", F.xxhash64("text").alias("ih"), "text"), width, names, units).where(literal > 0)
    ik = F.coalesce("item_id", F.lit(-(2**63)).cast("long")).alias("ik")
    opens = (F.col("pos") == 0) & F.col("r0").rlike(r"^\p{Lu}\p{Ll}+[.,;:!?\"')]*$") & ~_is_slot(F.col("t0"))
    as_name = F.when(opens, F.xxhash64(F.lit("<name>"), *[F.col(t) for t in words[1:]]))
    forms = F.array_compact(F.array(F.col("h"), as_name))
    asked = asked.select("item_id", ik, "ih", F.col("pos").alias("at"), F.col("h").alias("own"), F.explode(forms).alias("h"), *[F.col(f"r{i}").alias(f"b{i}") for i in range(width)])
    # equal windows of an item count once: a document's one passage covers them all
    sizes = asked.groupBy("ik", "ih").agg(F.count_distinct("own").alias("n_windows"))
    if asked.limit(broadcast_rows + 1).count() <= broadcast_rows:
        asked = F.broadcast(asked)
    found = windows(keyed(docs).select("doc_id", "k", "th", "text"), width, names, units).join(asked, "h")
    pairs = F.filter(
        F.array(
            *[
                F.when(_is_slot(F.col(f"t{i}")), F.struct(F.col(f"t{i}").alias("kind"), F.lower(f"b{i}").alias("said"), F.lower(f"r{i}").alias("here")))
                for i in range(width)
            ]
        ),
        lambda x: x.isNotNull(),
    )
    group = ["k", "th", "ik", "ih", "shift"]
    bare = lambda x: F.regexp_replace(x, r"^[\"'(\[]+|[.,;:!?\"')\]]+$", "")
    matched = found.select(
        "doc_id", "k", "th", "item_id", "ik", "ih", (F.col("pos") - F.col("at")).alias("shift"), "at", "own",
        F.transform(pairs, lambda p: F.struct(p.kind.alias("kind"), bare(p.said).alias("said"), bare(p.here).alias("here"))).alias("slots"),
    ).distinct()
    matched = materialize(matched)  # few rows; the texts are read once
    # within an alignment, slot values that stand for several others
    slot = matched.where(F.size("slots") > 0).select(*group, F.explode("slots").alias("s")).select(*group, "s.*").distinct()
    ambiguous = slot.groupBy(*group, "kind", "said").agg(F.count_distinct("here").alias("n")).where("n > 1").select(*group, "kind", F.col("said").alias("x"), F.lit(0).alias("side"))
    ambiguous = ambiguous.union(
        slot.groupBy(*group, "kind", "here").agg(F.count_distinct("said").alias("n")).where("n > 1").select(*group, "kind", F.col("here").alias("x"), F.lit(1).alias("side"))
    )
    wrong = ambiguous.groupBy(*group).agg(F.collect_set(F.struct("kind", "x", "side")).alias("wrong"))
    checked = matched.join(wrong, group, "left")
    breaks = F.exists(
        "slots",
        lambda p: F.array_contains("wrong", F.struct(p.kind.alias("kind"), p.said.alias("x"), F.lit(0).alias("side")))
        | F.array_contains("wrong", F.struct(p.kind.alias("kind"), p.here.alias("x"), F.lit(1).alias("side"))),
    )
    good = checked.where(F.col("wrong").isNull() | ~breaks)
    hits = good.groupBy("k", "th", "ik", "ih").agg(
        F.count_distinct("own").alias("n_matched"), F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id")
    )
    joined = hits.join(sizes, ["ik", "ih"])
    return joined.where(F.col("n_matched") >= coverage * F.col("n_windows")).select("doc_id", "k", "th", "item_id", "n_windows", "n_matched")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that leak no item, with their columns."""
    mine, k, th = with_keys(docs)
    bad = materialize(leaks(docs, benchmark, **params).select(F.col("k").alias(k), F.col("th").alias(th)).distinct())
    return mine.join(sized(bad), [k, th], "left_anti").drop(k, th)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "n_matched")
