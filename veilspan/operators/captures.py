"""Source captures, libraries of workups, and the day that a stay's timeline starts from, each brought to one form.

Defined cases: null and blank values take their default; captures of a kind that is not known are other
text; a library that breaks a rule keeps its row, with all that is wrong in ``problems``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import or_default

#: Kinds of captures and their labels (fixed values).
KINDS = {
    "primary_note": "Primary team note", "results": "Results", "medication_activity": "Medication activity", "consult_note": "Consult note", "prior_physical_exam": "Physical exam (admission)",
    "pre_round_physical_exam": "Physical exam (selected day)", "physical_exam": "Physical exam (selected day)", "bedside_update": "Bedside update", "other_chart_text": "Other chart text",
}
OTHER = "other_chart_text"
#: Kinds that a scope knows under another name (fixed values).
BY_SCOPE = {("context", "physical_exam"): "prior_physical_exam", ("daily", "pre_round_physical_exam"): "physical_exam"}
#: Roles of earlier versions' daily sections and the kinds that they became (fixed values).
ROLES = {
    "interval_events": "primary_note", "patient_report": "bedside_update", "current_support": "results", "focused_exam": "bedside_update", "key_results": "results",
    "medication_order_events": "medication_activity", "consultant_decisions": "consult_note", "problem_plan_updates": "primary_note", "disposition_questions": "primary_note",
    "additional_daily_source": "other_chart_text",
}
#: The schema that a library names; another family of files has another.
LIBRARY = "workup_library_v1"


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[key]


def kind(scope: Column, given: Column) -> Column:
    """The kind of a capture in a scope, other text if it is not known."""
    moved = _lookup({f"{s}/{k}": v for (s, k), v in BY_SCOPE.items()}, F.concat_ws("/", scope, given))
    return F.coalesce(moved, F.when(given.isin(*KINDS), given), F.lit(OTHER))


def captures(rows: DataFrame, now: Column, scope: str = "daily") -> DataFrame:
    """``rows(id, kind, label, text, captured, created, updated)`` in one form; the times stand in for one another, last of all ``now``.

    A row without an id gets one of its content, so that it has the same one whenever it is brought to form.
    """
    k = kind(F.lit(scope), F.col("kind"))
    label = F.coalesce(F.nullif(F.trim("label"), F.lit("")), _lookup(KINDS, k))
    text = F.coalesce("text", F.lit(""))
    made = F.concat(F.lit("capture_"), F.substring(F.sha2(F.concat_ws("\x1f", k, label, text), 256), 1, 16))
    return rows.select(
        F.coalesce(F.nullif("id", F.lit("")), made).alias("id"), k.alias("kind"), label.alias("label"), text.alias("text"), F.coalesce("captured", "created", now).alias("captured"),
        F.coalesce("created", "captured", now).alias("created"), F.coalesce("updated", "created", "captured", now).alias("updated"),
    )


def migrated(sections: DataFrame) -> DataFrame:
    """Captures' rows of earlier versions' ``sections(id, role, label, text, warned, created, updated)``; those without text and warnings go.

    A role becomes a kind by the map alone; labels are never guessed from.
    """
    said = (F.trim(F.coalesce("text", F.lit(""))) != "") | (F.coalesce("warned", F.lit(0)) > 0)
    return sections.where(said).select("id", F.coalesce(_lookup(ROLES, F.col("role")), F.lit(OTHER)).alias("kind"), "label", "text", F.coalesce("updated", "created").alias("captured"), "created", "updated")


def libraries(rows: DataFrame, schema: str = LIBRARY) -> DataFrame:
    """``(id, title, version, description, workups, problems)`` of ``rows(schema, id, title, version, description, workups)``, workups being ids; all problems, not the first."""
    id_, title = F.trim(F.coalesce("id", F.lit(""))), F.trim(F.coalesce("title", F.lit("")))
    workups = F.coalesce("workups", F.array().cast("array<string>"))
    wrong = {
        f"schema must be {schema}": ~F.coalesce(F.col("schema") == schema, F.lit(False)), "id is required": id_ == "", "id must be URL-safe": ~id_.rlike("(?i)^[a-z0-9][a-z0-9._-]*$"),
        "title is required": title == "", "workups must contain at least one workup": F.size(workups) == 0,
        "workup ids must be unique within a library": F.size(F.array_distinct(workups)) < F.size(workups),
    }
    said = F.concat_ws("; ", *[F.when(test, text) for text, test in wrong.items()])
    version = or_default(F.col("version"), "1.0.0")
    return rows.select(id_.alias("id"), title.alias("title"), version.alias("version"), F.trim(F.coalesce("description", F.lit(""))).alias("description"), workups.alias("workups"), said.alias("problems"))


def local_day(at: Column, zone: Column | str) -> Column:
    """The calendar day of a moment (in UTC) where the clock shows ``zone``."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def anchored(stays: DataFrame, given: DataFrame, days: DataFrame) -> DataFrame:
    """``(id, anchor, source)``: the day that each of ``stays(id)``'s timeline starts from.

    The last valid day that was given, of ``given(id, at, text)``, else the earliest of ``days(id, date)``,
    else none, which a run has to refuse: ``source`` is given, days or missing. A given day is valid
    if it is an ISO date.
    """
    day = F.try_to_date("text", "yyyy-MM-dd")
    last = given.where(F.col("text").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & day.isNotNull()).groupBy("id").agg(F.max_by(day, F.struct("at", "text")).alias("_g"))
    first = days.groupBy("id").agg(F.min("date").alias("_d"))
    source = F.when(F.col("_g").isNotNull(), "given").when(F.col("_d").isNotNull(), "days").otherwise("missing")
    return stays.join(last, "id", "left").join(first, "id", "left").select("id", F.coalesce("_g", "_d").alias("anchor"), source.alias("source"))


def remembered(events: DataFrame) -> DataFrame:
    """``events(id, at, text)`` with ``day``: the valid day that was given last until then."""
    day = F.when(F.col("text").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date("text", "yyyy-MM-dd"))
    until = Window.partitionBy("id").orderBy("at", "text").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("day", F.last(day, ignorenulls=True).over(until))
