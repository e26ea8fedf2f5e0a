"""Grading of found spans against known ones.

A truth is covered if one found span contains it, and then has the label of the first such span by
place; a span that only touches it makes it partial. Protected spans must neither be touched nor be
missing from the output. Null keys meet nothing; a truth without a category counts as UNKNOWN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dates import using
from .spans import overlaps

FAILURE = {"missed": "missed-phi-span", "partial": "partial-phi-redaction", "mislabelled": "category-mismatch"}


def category(label: Column) -> Column:
    """A label as a category: upper case, words joined by underscores; an IP address is an IP."""
    name = F.regexp_replace(F.upper(F.trim(F.coalesce(F.nullif(label, F.lit("")), F.lit("UNKNOWN")))), r"[\s-]+", "_")
    return F.when(name == "IP_ADDRESS", "IP").otherwise(name)


def grade(truth: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each true span with the state missed, partial, mislabelled or exact, and the label that covers it."""
    met = overlaps(truth.select(key, "start", "end", "category", "key"), found.select(key, "start", "end", "label"), key)
    covers = (F.col("start_b") <= F.col("start_a")) & (F.col("end_b") >= F.col("end_a"))
    best = met.groupBy(key, F.col("start_a").alias("start"), F.col("end_a").alias("end"), F.col("category_a").alias("category"), F.col("key_a").alias("key")).agg(
        F.min(F.when(covers, F.struct("start_b", "end_b", "label_b"))).alias("c"), F.lit(True).alias("touched")
    )
    label = F.col("c.label_b")
    state = (
        F.when(F.col("touched").isNull(), "missed")
        .when(F.col("c").isNull(), "partial")
        .when(category(label) != category(F.col("category")), "mislabelled")
        .otherwise("exact")
    )
    return truth.join(best, [key, "start", "end", "category", "key"], "left").withColumns({"state": state, "label": label}).drop("c", "touched")


def grade_row(truth: Column, found: Column) -> Column:
    """:func:`grade` of spans that lie in one row: the true spans with ``state`` and ``label`` added. Nothing is shuffled."""

    def judged(t: Column, met: Column, best: Column) -> Column:
        state = (
            F.when(F.coalesce(F.size(met), F.lit(0)) <= 0, "missed")
            .when(best.isNull(), "partial")
            .when(category(best.label) != category(t.category), "mislabelled")
            .otherwise("exact")
        )
        return t.withField("state", state).withField("label", best.label)

    def one(t: Column, all_: Column) -> Column:
        met = F.filter(all_, lambda f: (f.start < t.end) & (t.start < f.end))
        covers = lambda m: F.array_min(F.transform(F.filter(m, lambda f: (f.start <= t.start) & (f.end >= t.end)), lambda f: F.struct(f.start, f.end, f.label)))
        return using(met, lambda m: using(covers(m), lambda best: judged(t, m, best)))

    return using(found, lambda all_: F.transform(truth, lambda t: one(t, all_)))


def protected_failures(protected: DataFrame, found: DataFrame, outputs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, type, start, end, value)`` of protected spans that a found span touches, or whose text the output lacks.

    ``protected(key, start, end, value)``, ``outputs(key, output)``.
    """
    touched = overlaps(protected.select(key, "start", "end"), found.select(key, "start", "end"), key).select(key, F.col("start_a").alias("start"), F.col("end_a").alias("end"), F.lit(True).alias("hit")).distinct()
    each = protected.join(touched, [key, "start", "end"], "left").join(outputs.select(key, "output"), key)
    kind = F.when(F.col("hit"), "protected-span-redacted").when(~F.contains("output", "value"), "protected-text-corrupted")
    return each.withColumn("type", kind).where("type is not null").select(key, "type", "start", "end", "value")


def failures(graded: DataFrame, protected: DataFrame, missing: DataFrame, key: str = "doc_id") -> DataFrame:
    """All failures: ``(key, type, category, annotation, start, value)`` of the six types.

    ``graded`` of :func:`grade`, ``protected`` of :func:`protected_failures`, ``missing(key)`` of runs without a result.
    """
    state = F.create_map(*[F.lit(x) for kv in FAILURE.items() for x in kv])[F.col("state")]
    bad = graded.where("state <> 'exact'").select(key, state.alias("type"), category(F.col("category")).alias("category"), F.col("key").alias("annotation"), "start", F.col("value" if "value" in graded.columns else "key").alias("value"))
    kept = protected.select(key, "type", F.lit("CLINICAL_NON_PHI").alias("category"), F.lit("guard").alias("annotation"), "start", "value")
    none = missing.select(key, F.lit("missing-run-result").alias("type"), F.lit("UNKNOWN").alias("category"), F.lit("").alias("annotation"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("string").alias("value"))
    return bad.unionByName(kept).unionByName(none)


def metrics(graded: DataFrame) -> DataFrame:
    """By category: spans, detected, exact, recall and accuracy; null where nothing is to divide by."""
    seen = F.count_if(F.col("state").isin("exact", "mislabelled"))
    exact = F.count_if(F.col("state") == "exact")
    return graded.groupBy("category").agg(
        F.count(F.lit(1)).alias("truth"), seen.alias("detected"), exact.alias("exact"),
        F.round(seen / F.count(F.lit(1)), 6).alias("recall"), F.round(F.try_divide(exact, seen), 6).alias("accuracy"),
    )


def failure_clusters(failed: DataFrame, key: str = "doc_id", examples: int = 3) -> DataFrame:
    """By type, category and annotation: how often, in how many documents, and the first ``examples`` by document and place.

    The failures are numbered per cluster and only the first ones are kept as rows, so no cluster is gathered.
    """
    by = ["type", "category", "annotation"]
    counted = failed.groupBy(*by).agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct(key).alias("cases"))
    first = failed.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(key, "start"))).where(F.col("n") <= examples)
    shown = first.groupBy(*by).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("n", F.col(key).cast("string").alias("k")))), lambda x: x.k)).alias("examples"))
    return counted.join(shown, by)
