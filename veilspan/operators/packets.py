"""Records brought to one form, and the texts assembled from them.

Each function takes and gives plain tables or columns; where a value is null or blank, the default
stands, and rows that say nothing are left out of texts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import or_default

#: Roles of sections by scope, in their order, and whether they carry forward (fixed values).
CONTEXT_ROLES = ["admission_reason", "procedures_devices", "admission_results", "additional_admission_source"]
DAILY_ROLES = ["interval_events", "key_results", "medication_order_events", "patient_report", "focused_exam", "additional_daily_source"]
#: Labels of earlier versions and the roles that they stand for (fixed values).
LEGACY_ROLES = {
    ("context", "admission context"): "admission_reason", ("context", "medications"): "procedures_devices", ("context", "labs"): "admission_results", ("context", "other"): "additional_admission_source",
    ("daily", "interval events"): "interval_events", ("daily", "new labs/results"): "key_results", ("daily", "medication changes"): "medication_order_events",
    ("daily", "patient-reported symptoms"): "patient_report", ("daily", "other"): "additional_daily_source", ("daily", "physical exam findings"): "focused_exam",
}


def role(scope: Column, given: Column, label: Column, index: Column) -> Column:
    """A known role as it is; else the role of an earlier version's label; else additional for a label of one's own; else by place."""
    by = lambda f: F.when(scope == "daily", f("daily", DAILY_ROLES)).otherwise(f("context", CONTEXT_ROLES))
    known = by(lambda _, roles: given.isin(*roles))
    plain = F.lower(F.trim(label))
    old = F.create_map(*[F.lit(x) for (s, name), r in LEGACY_ROLES.items() for x in (f"{s}/{name}", r)])[F.concat_ws("/", F.when(scope == "daily", "daily").otherwise("context"), plain)]
    rest = by(lambda s, roles: F.lit(roles[-1]))
    placed = by(lambda s, roles: F.coalesce(F.get(F.array(*[F.lit(r) for r in roles]), index.cast("int")), F.lit(roles[-1])))
    return F.when(F.coalesce(known, F.lit(False)), given).otherwise(F.coalesce(old, F.when(F.coalesce(plain, F.lit("")) != "", rest), placed))


def warnings(found: Column) -> Column:
    """Warnings as (severity, type, reason) only, without those of a possible full name; one that says nothing is generic."""
    each = F.transform(found, lambda w: F.struct(or_default(w.severity, "review").alias("severity"), or_default(w.type, "warning").alias("type"), F.coalesce(w.reason, F.lit("")).alias("reason")))
    return F.filter(each, lambda w: F.lower(F.trim(w.type)) != "possible full name")


def sections(rows: DataFrame, scope: str, default: str = "Section") -> DataFrame:
    """``rows(id, idx, label, role, text)`` in one form: labels trimmed, roles known, texts not null."""
    label = or_default(F.col("label"), default)
    return rows.select("id", "idx", label.alias("label"), role(F.lit(scope), F.col("role"), F.coalesce("label", F.lit(default)), F.col("idx")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def patients(rows: DataFrame, sections_of: DataFrame, default_labels: Sequence[str]) -> DataFrame:
    """``(id, label, sections)`` of ``rows(id, idx, label)``: those without sections get the default ones; numbered where unnamed."""
    own = sections_of.groupBy(F.col("id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("idx", "label", "role", "text"))).alias("_s"))
    blank = F.array(*[F.struct(F.lit(i).cast("int").alias("idx"), F.lit(x).alias("label"), F.lit(CONTEXT_ROLES[min(i, len(CONTEXT_ROLES) - 1)]).alias("role"), F.lit("").alias("text")) for i, x in enumerate(default_labels)])
    joined = rows.join(own, F.col("id") == F.col("_id"), "left")
    kind = "array<struct<idx:int,label:string,role:string,text:string>>"
    return joined.select("id", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.concat(F.lit("Patient "), (F.col("idx") + 1).cast("string"))).alias("label"), F.coalesce(F.col("_s").cast(kind), blank.cast(kind)).alias("sections"))


def migrate_state(states: DataFrame) -> DataFrame:
    """``states(state, active, patients, hidden, selected)``: archived patients go, the active one is one that stays, hidden ids once each."""
    stay = F.filter("patients", lambda p: F.coalesce(p.archived, F.lit("")) == "")
    active = F.when(F.exists(stay, lambda p: p.id == F.col("active")), F.col("active")).otherwise(F.coalesce(F.get(stay, 0)["id"], F.lit("")))
    return states.select(
        "state", active.alias("active"), F.transform(stay, lambda p: p.id).alias("patients"), F.array_distinct(F.transform("hidden", lambda x: x.cast("string"))).alias("hidden"),
        F.transform("selected", lambda x: x.cast("string")).alias("selected"),
    )


def draft(name: Column, aliases: Column, items: Column) -> Column:
    """A workup of an editor's draft: (id, title, aliases, items); ids are slugs, items without a text go, choices are split at line ends and commas."""
    slug = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    split = lambda x, by: F.array_distinct(F.filter(F.transform(F.split(x, by), lambda w: F.trim(w)), lambda w: w != ""))
    kept = F.filter(items, lambda i: F.trim(F.coalesce(i.text, F.lit(""))) != "")
    made = F.transform(kept, lambda i: F.struct(slug(i.text).alias("id"), F.trim(i.text).alias("text"), split(i.choices, r"[\n,]").alias("choices")))
    return F.struct(slug(name).alias("id"), F.trim(name).alias("title"), split(aliases, ",").alias("aliases"), made.alias("items"))


def assemble(rows: DataFrame, key: str, order: Sequence[str], limit: int, head: float = 0.55, tail: float = 0.35) -> DataFrame:
    """``(key, text)``: blocks ``title`` over ``text``, in the order of ``order``, blank ones left out, long ones shortened to ``limit``."""
    from .text import compact

    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("role"))
    body = compact(F.trim("text"), limit, head, tail)
    each = rows.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("_r", F.when(rank > 0, rank).otherwise(len(order) + 1))
    parts = F.sort_array(F.collect_list(F.struct("_r", "idx", F.concat(F.lit("## "), "title", F.lit("\n"), body).alias("t"))))
    return each.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p.t), "\n\n").alias("text"))


def packet(context: DataFrame, daily: DataFrame, exam: DataFrame, key: str = "id") -> DataFrame:
    """A progress packet: ``(key, text, missing, warnings)``.

    Context that carries forward, then the day's sections in role order, then the exam: the checklist's
    text or else the saved note. Missing lists the expected roles that say nothing.
    """
    carried = context.where(F.col("role") != CONTEXT_ROLES[-1]).withColumn("part", F.lit(0))
    rows = carried.unionByName(daily.withColumn("part", F.lit(1)))
    rank = F.array_position(F.array(*[F.lit(r) for r in CONTEXT_ROLES + DAILY_ROLES]), F.col("role"))
    said = F.trim(F.coalesce("text", F.lit(""))) != ""
    parts = F.sort_array(F.collect_list(F.when(said, F.struct("part", rank.alias("r"), "idx", F.concat("role", F.lit(": "), F.trim("text")).alias("t")))))
    made = rows.groupBy(key).agg(
        F.array_join(F.transform(parts, lambda p: p.t), "\n").alias("body"),
        F.array_join(F.array_except(F.array(*[F.lit(r) for r in DAILY_ROLES[:-1]]), F.collect_set(F.when(said, F.col("role")))), ",").alias("missing"),
        F.sum("warned").alias("warnings"),
    )
    shown = exam.select(key, F.coalesce(F.nullif(F.trim("checklist"), F.lit("")), F.nullif(F.trim("note"), F.lit(""))).alias("exam"))
    return made.join(shown, key, "left").select(key, F.concat_ws("\n", "body", F.concat(F.lit("exam: "), "exam")).alias("text"), "missing", "warnings")


def variables(sources: Mapping[str, DataFrame], key: str = "id") -> DataFrame:
    """``(key, token, text)`` of all sources ``(key, name, text)``: the token is the source's name and the row's, blank texts left out, repeats numbered."""
    out = None
    for name, rows in sources.items():
        slug = F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
        each = rows.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(key, F.concat(F.lit(name + "."), slug).alias("token"), "text", F.col("name").alias("_n"))
        out = each if out is None else out.unionByName(each)
    n = F.row_number().over(Window.partitionBy(key, "token").orderBy("_n", "text"))
    return out.withColumn("_i", n).select(key, F.when(F.col("_i") > 1, F.concat_ws("_", "token", "_i")).otherwise(F.col("token")).alias("token"), "text")


def template(saved: Column, default: Column, guideline: Column, token: Column) -> Column:
    """A saved override, else the default, else the guideline's text; the token stands in front unless the text has it."""
    text = F.coalesce(F.nullif(F.trim(saved), F.lit("")), F.nullif(F.trim(default), F.lit("")), guideline, F.lit(""))
    mark = F.concat(F.lit("{{"), token, F.lit("}}"))
    return F.when(F.contains(text, mark), text).otherwise(F.concat_ws("\n", mark, F.nullif(text, F.lit(""))))


def set_output(outputs: Column, name: Column, text: Column) -> Column:
    """A day's saved outputs with one set, or taken out where its text is blank."""
    others = F.map_filter(outputs, lambda k, _: k != name)
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", others).otherwise(F.map_concat(others, F.create_map(name, text)))


def imported(choices: Column, many: Column, values: Column, note: Column) -> Column:
    """(selected, note, counted) of an answer that came from outside: choices matched whatever their case, the rest added to the note."""
    match = lambda v: F.get(F.filter(choices, lambda c: F.lower(F.trim(c)) == F.lower(F.trim(v))), 0)
    hits = F.array_distinct(F.filter(F.transform(values, match), lambda c: c.isNotNull()))
    chosen = F.when(many, hits).otherwise(F.slice(hits, 1, 1))
    rest = F.filter(values, lambda v: match(v).isNull() & (F.trim(v) != ""))
    said = F.concat_ws("; ", F.filter(F.concat(F.array(F.trim(F.coalesce(note, F.lit("")))), rest), lambda x: x != ""))
    return F.struct(chosen.alias("selected"), said.alias("note"), ((F.size(chosen) > 0) | (said != "")).alias("counted"))


def meaningful(answers: Column) -> Column:
    """Answers (item, selected, note) without the choice "not assessed"; those that then say nothing go."""
    bare = F.transform(answers, lambda a: a.withField("selected", F.filter(a.selected, lambda c: F.lower(F.trim(c)) != "not assessed")))
    return F.filter(bare, lambda a: (F.size(a.selected) > 0) | (F.trim(F.coalesce(a.note, F.lit(""))) != ""))


def local_id(prefix: str, *natural: Column) -> Column:
    """A stable id of a row's natural key; the same rows get the same id in every run."""
    return F.concat(F.lit(prefix + "_"), F.substr(F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in natural]), 256), F.lit(1), F.lit(16)))


def fuzzy(query: str, fields: Mapping[str, float], least: float = 0.65) -> tuple[Column, Column]:
    """(score, hit) of rows against a query: the weighted sum of each field's likeness, an array of texts counting by its best.

    A field that contains the query is fully alike; else what counts is the best word's edit distance.
    """
    q = F.lit(query.strip().lower())

    def like(x: Column) -> Column:
        t = F.lower(F.coalesce(x, F.lit("")))
        word = lambda w: 1 - F.levenshtein(w, q) / F.greatest(F.length(w), F.length(q), F.lit(1))
        best = F.array_max(F.transform(F.split(t, "[^a-z0-9]+"), word))
        return F.when(F.contains(t, q), 1.0).otherwise(F.greatest(best, F.lit(0.0)))

    top = F.greatest(*[like(F.col(f)) for f in fields]) if len(fields) > 1 else like(F.col(next(iter(fields))))
    score = sum((like(F.col(f)) * w for f, w in fields.items()), F.lit(0.0))
    return F.round(score, 6), top >= least
