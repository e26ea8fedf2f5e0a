"""Records: normalisation, catalogs with overrides, upserts, checklists, assembled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def or_default(value: Column, default: str) -> Column:
    """The trimmed text, or the default where it is null or blank."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default))


def one_of(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def clean_choices(choices: Column) -> Column:
    """Trimmed, without blanks, the first of equals kept in order."""
    return F.array_distinct(F.filter(F.transform(choices, lambda c: F.trim(c)), lambda c: c != ""))


def override(base: DataFrame, changes: DataFrame, hidden: DataFrame, key: str) -> DataFrame:
    """Base rows that are not hidden, each replaced by a change of its id; changes of new ids are added."""
    seen = base.join(hidden.select(key), key, "left_anti").join(changes.select(key), key, "left_anti")
    return seen.unionByName(changes.join(hidden.select(key), key, "left_anti"))


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Of each id the row that is first in ``order``."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with those of ``changes`` in place of theirs."""
    return rows.join(changes.select(key), key, "left_anti").unionByName(changes)


def assemble(rows: DataFrame, key: str, order: str, text: Column, sep: str = "\n", name: str = "text") -> DataFrame:
    """One text for each key, of its rows' texts in order."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x.t), sep).alias(name))


def carry_decisions(before: DataFrame, after: DataFrame, keys: list[str], order: str, decision: str) -> DataFrame:
    """``after`` with the decisions of ``before``: the n-th of a key takes that of the n-th, else pending."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    old = before.withColumn("rn", number).select(*keys, "rn", decision)
    new = after.withColumn("rn", number)
    return new.join(old, [*keys, "rn"], "left").withColumn(decision, F.coalesce(decision, F.lit("pending"))).drop("rn")


def problems(item_id: Column, kind: Column, choices: Column, kinds: list[str]) -> Column:
    """All that is wrong with a workup item, joined; empty if it is valid."""
    return F.concat_ws(
        "; ",
        F.when(~F.coalesce(item_id.rlike("^[a-z0-9][a-z0-9-]*$"), F.lit(False)), "bad id"),
        F.when(~F.coalesce(kind.isin(*kinds), F.lit(False)), "bad kind"),
        F.when(F.coalesce(F.size(choices), F.lit(0)) < 2, "too few choices"),
        F.when(F.size(F.array_distinct(choices)) < F.size(choices), "repeated choice"),
    )


def incremental_plan(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """``(key, order, mode, suffix)`` against the row before: unchanged, append with the suffix, or full."""
    before = F.lag(text).over(Window.partitionBy(key).orderBy(order))
    t = F.col(text)
    append = (before != "") & t.startswith(before)
    mode = F.when(t == before, "unchanged").when(append, "append").otherwise("full")
    return rows.select(key, order, F.coalesce(mode, F.lit("full")).alias("mode"), F.when(append & (t != before), F.substr(t, F.length(before) + 1)).otherwise("").alias("suffix"))
