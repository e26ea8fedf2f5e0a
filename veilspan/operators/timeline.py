"""Dates on a relative timeline: parsing, years that are missing, anchors, hospital days, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """An ISO or M/D/YYYY date; null if there is no such day."""
    iso = F.regexp_extract(text, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})$", 1)
    us = F.regexp_replace(text, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", "$3-$1-$2")
    return F.try_to_date(F.when(iso != "", iso).when(text.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), us), "yyyy-M-d")


def parse_clock(text: Column) -> Column:
    """HH:MM of 3:07 PM or 1507; null if there is no such time."""
    h12 = F.regexp_extract(text, r"^([0-9]{1,2}):([0-9]{2}) ?([AaPp])[Mm]$", 1)
    ok12 = text.rlike(r"^(?:0?[1-9]|1[0-2]):[0-5][0-9] ?[AaPp][Mm]$")
    hour12 = F.try_to_number(h12, F.lit("99")).cast("int") % 12 + F.when(F.lower(text).endswith("pm"), 12).otherwise(0)
    m12 = F.regexp_extract(text, r":([0-9]{2})", 1)
    ok24 = text.rlike(r"^(?:[01]?[0-9]|2[0-3]):?[0-5][0-9]$")
    bare = F.lpad(F.regexp_replace(text, ":", ""), 4, "0")
    return F.when(ok12, F.concat(F.lpad(hour12.cast("string"), 2, "0"), F.lit(":"), m12)).when(
        ok24, F.concat(F.substr(bare, F.lit(1), F.lit(2)), F.lit(":"), F.substr(bare, F.lit(3), F.lit(2)))
    )


def nearest_year(month: Column, day: Column, anchor: Column, future_days: Column | int = 30) -> Column:
    """The date of month and day nearest to the anchor: of the year before, the same, and the next; not over ``future_days`` after it; the earlier of two as near."""
    years = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.try_to_date(F.concat_ws("-", F.year(anchor) + d, month, day), "yyyy-M-d"))
    allowed = F.filter(years, lambda d: d.isNotNull() & (F.datediff(d, anchor) <= future_days))
    best = F.array_min(F.transform(allowed, lambda d: F.struct(F.abs(F.datediff(d, anchor)).alias("a"), d.alias("d"))))
    return best.getField("d")


def duration(start: Column, end: Column) -> Column:
    """Whole years, months and days from start to end, as a phrase."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    fix = F.when(F.add_months(start, months) > end, months - 1).otherwise(months)
    days = F.datediff(end, F.add_months(start, fix))
    unit = lambda n, w: F.when(n == 1, f"1 {w}").when(n > 1, F.concat(n.cast("string"), F.lit(f" {w}s")))
    parts = F.array_compact(F.array(unit(F.floor(fix / 12), "year"), unit(fix % 12, "month"), unit(days, "day")))
    return (
        F.when(F.size(parts) == 0, "less than a day")
        .when(F.size(parts) == 1, parts[0])
        .when(F.size(parts) == 2, F.array_join(parts, " and "))
        .otherwise(F.concat(F.array_join(F.slice(parts, 1, 2), ", "), F.lit(", and "), F.element_at(parts, -1)))
    )


def placement(date: Column, anchor: Column) -> Column:
    """[Hospital Day n] from the anchor on, else how long before it."""
    n = F.datediff(date, anchor) + 1
    return (
        F.when(date.isNull() | anchor.isNull(), "[Historical date]")
        .when(n >= 1, F.concat(F.lit("[Hospital Day "), n.cast("string"), F.lit("]")))
        .otherwise(F.concat(F.lit("["), duration(date, anchor), F.lit(" prior to hospital admission]")))
    )


def choose_anchor(rows: DataFrame, key: str, date: str, context: str) -> DataFrame:
    """``(key, anchor)``: the latest date in current context, else the earliest of admission, else the earliest within 14 days of the latest."""
    last = F.max(date).over(Window.partitionBy(key))
    near = rows.withColumn("_near", F.when(F.datediff(last, date) <= 14, F.col(date)))
    return near.groupBy(key).agg(
        F.coalesce(F.max(F.when(F.col(context) == "current", F.col(date))), F.min(F.when(F.col(context) == "admission", F.col(date))), F.min("_near")).alias("anchor")
    )


def ordinals(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Adds n, of and latest for groups of two rows or more: the marker of a repeated result."""
    w = Window.partitionBy(*keys)
    n = rows.withColumn("n", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("of", F.count(F.lit(1)).over(w))
    return n.where("of >= 2").withColumn("latest", F.col("n") == F.col("of"))
