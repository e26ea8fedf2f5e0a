"""Queries over the guards: facts of spans, what becomes of them and why, and labels of names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import DIRECT_RULES, FIELD_RULES, PRIORITY, Rule
from ..operators import clinical, spans, vocabulary
from .base import merged_sql, query, spans_sql, table
from .corpus_queries import _CASES, cases
from .guard_sql import KEPT, NAMED_VOCABULARY, TRIMMED, facts_sql, judged_sql, named_vocabulary, text

#: What a model would offer: runs of capitalised words. One that the rules found too is theirs.
OFFERED = Rule("offered", "NAME", r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\b")
_ALL = [*FIELD_RULES, *DIRECT_RULES, OFFERED]

#: Offered spans, one for each way that a verdict can go and some that stay: (label, source, before, value, after).
OFFERS = [
    ("ROOM", "model", "moved to ", "{n} Heart Hospital", " today"),
    ("ROOM", "structured", "in ", "Room {i}", " now"),
    ("AGE", "structured", "age ", "9{i}", "."),
    ("AGE", "structured", "age ", "4{i}", "."),
    ("ORGANIZATION", "structured", "Isolates grew.\n", "Ostrow Lab", " 2 S\nsusceptibility"),
    ("LOCATION", "model", "rests at ", "home", " again"),
    ("PATIENT NAME", "structured", "Patient: ", "{n}", "\nslept"),
    ("NAME", "model", "has ", "Graves", " disease today"),
    ("NAME", "model", "\n", "Physical Exam", ":\nclear"),
    ("NAME", "model", "ref to ", "Cardiology Clinic", " soon"),
    ("NAME", "model", "shows ", "Heart Failure", " now"),
    ("NAME", "model", "item ", "Kit{i} Box", " left"),
    ("NAME", "model", "took ", "Lisinopril", " 10 mg daily"),
    ("NAME", "model", "took ", "Zemopril", " 10 mg daily"),
    ("NAME", "model", "by ", "Xu", " alone"),
    ("NAME", "model", "BP 128/76 HR 7{i} ", "{n}", ""),
    ("NAME", "model", "sent to ", "{l} Hospice", " then"),
    ("NAME", "model", "wrote ", "some of it", " then"),
    ("DATE", "structured", "in ", "May", " or so"),
    ("DATE", "structured", "range ", "3-5", " of it"),
    ("DATE", "structured", "seen on ", "3-5", " of it"),
    ("ADDRESS", "structured", "", "12 glucose Rd", " x"),
    ("ADDRESS", "structured", "ECG lead ", "12 Elm St", " x"),
    ("ADDRESS", "structured", "Address: ", "12 Elm St", " x"),
    ("ID", "structured", "Serum value: 4.{i} mg/dL ", "AB{i}99", ""),
    ("ID", "structured", "Serum value: 4.{i} mg/dL ", "SN-{i}99", ""),
    ("LOCATION", "structured", "in ", "hospital stay", " two"),
    ("ORGANIZATION", "structured", "on ", "CT chest", " with contrast image"),
    ("FACILITY", "structured", "the ", "{l} Hospital", " course was short"),
    ("NAME", "model", "Dr. ", "{n}", ", MD"),
    ("NAME", "structured", "mother ", "{n}", " called"),
    ("NAME", "structured", "", "{n}", ", 44 year old, slept"),
    ("NAME", "model", "met ", "{n}", " there"),
]
_I = "c_custkey"


def _fill(x: str) -> str:
    from ..sources.corpus import FIRST, LAST

    pick = lambda v, by: f"[{', '.join(map(text, v))}][CAST({by} % {len(v)} + 1 AS BIGINT)]"
    first, last = pick(FIRST, _I), pick(LAST, f"({_I} // 7)")
    return f"replace(replace(replace({text(x).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}, '{{n}}', {first} || ' ' || {last}), '{{l}}', {last}), '{{i}}', CAST({_I} % 10 AS VARCHAR))"


_OFFERS_SQL = " UNION ALL ".join(
    f"SELECT {_I} AS doc_id, {k} AS k, '{label}' AS label, '{source}' AS source, {_fill(b)} AS b, {_fill(v)} AS v, {_fill(a)} AS a FROM customer WHERE {_I} % {len(OFFERS)} = {k}" for k, (label, source, b, v, a) in enumerate(OFFERS)
)
_FIXTURE = f"""WITH RECURSIVE made AS MATERIALIZED ({_OFFERS_SQL}), docs AS MATERIALIZED (SELECT doc_id, b || v || a AS text FROM made), vocab AS MATERIALIZED ({NAMED_VOCABULARY}),
spans_ AS MATERIALIZED (SELECT doc_id, k, CAST(length(b) AS BIGINT) AS "start", CAST(length(b) + length(v) AS BIGINT) AS "end", label, source FROM made)"""


def offers(spark, sf_dir):
    """``(doc_id, k, text, found)``: a text for each customer, and a span that something offers in it."""
    from ..sources.corpus import FIRST, LAST

    i = F.col(_I)
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    given = spark.createDataFrame([(k, *o) for k, o in enumerate(OFFERS)], "k long, label string, source string, b string, v string, a string")
    rows = table(spark, sf_dir, "customer").select(i, (i % len(OFFERS)).alias("k"), pick(FIRST, i).alias("f"), pick(LAST, F.floor(i / 7)).alias("l")).join(F.broadcast(given), "k")
    fill = lambda c: F.replace(F.replace(F.replace(c, F.lit("{n}"), F.concat_ws(" ", "f", "l")), F.lit("{l}"), F.col("l")), F.lit("{i}"), (i % 10).cast("string"))
    rows = rows.withColumns({c: fill(F.col(c)) for c in "bva"})
    n = F.length("b").cast("long")
    span = F.struct(n.alias("start"), (n + F.length("v")).alias("end"), "label", "source")
    return rows.select(i.alias("doc_id"), "k", F.concat("b", "v", "a").alias("text"), F.array(span).alias("found"))


def _judged(docs, spark):
    return vocabulary.looked_up(docs, named_vocabulary(spark), "judged", lambda voc: clinical.judged_expr("text", "found", voc))


_COUNTED = ", ".join(f"count(*) FILTER (f_{n}) AS {n}" for n in clinical.FACTS)


@query("guard_table", f"{_FIXTURE} SELECT k, count(*) AS spans, {_COUNTED} FROM ({facts_sql('spans_', 'docs', 'vocab')}) GROUP BY k")
def guard_table(spark, sf_dir):
    rows = _judged(offers(spark, sf_dir), spark).select("k", F.inline_outer("judged")).where("start is not null")
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("spans"), *[F.count_if(F.col("facts")[n]).alias(n) for n in clinical.FACTS])


@query("span_verdicts", f"{_FIXTURE} SELECT k, label, source, reason, coalesce(becomes, '') AS becomes, count(*) AS spans FROM ({judged_sql('spans_', 'docs', 'vocab')}) GROUP BY ALL")
def span_verdicts(spark, sf_dir):
    rows = _judged(offers(spark, sf_dir), spark).select("k", F.inline_outer("judged")).where("start is not null")
    return rows.groupBy("k", "label", "source", F.col("verdict.reason").alias("reason"), F.coalesce("verdict.label", F.lit("")).alias("becomes")).agg(F.count(F.lit(1)).alias("spans"))


@query("name_labels", f"{_FIXTURE} SELECT label, becomes AS refined, norm, count(*) AS spans FROM ({judged_sql('spans_', 'docs', 'vocab')}) WHERE contains(label, 'NAME') AND reason = 'keep' GROUP BY ALL")
def name_labels(spark, sf_dir):
    rows = _judged(offers(spark, sf_dir), spark).select(F.inline_outer("judged")).where(F.col("label").contains("NAME") & (F.col("verdict.reason") == "keep"))
    return rows.groupBy("label", F.col("verdict.label").alias("refined"), "norm").agg(F.count(F.lit(1)).alias("spans"))


_BASE_SQL = merged_sql(spans_sql(_ALL, "docs"), _ALL, PRIORITY, "CASE WHEN rule = 'offered' THEN 'model' ELSE 'structured' END")


@query(
    "guarded_spans",
    f"""WITH RECURSIVE docs AS MATERIALIZED ({_CASES}), spans_ AS MATERIALIZED ({_BASE_SQL}), vocab AS MATERIALIZED ({NAMED_VOCABULARY})
    SELECT doc_id, count(*) AS kept, CAST(sum("end" - "start") AS BIGINT) AS chars FROM ({judged_sql('spans_', 'docs', 'vocab')}) WHERE becomes IS NOT NULL GROUP BY doc_id""",
)
def guarded_spans(spark, sf_dir):
    """Spans of the measuring corpus that stay, with a model that offers all capitalised runs."""
    ruled = spans.sourced_expr(spans.find_expr("text", [*FIELD_RULES, *DIRECT_RULES]))
    found = F.expr(spans.merged_expr(f"concat({ruled}, {spans.sourced_expr(spans.find_expr('text', [OFFERED]), 'model')})", "text"))
    docs = cases(spark, sf_dir).withColumn("found", found)
    kept = vocabulary.looked_up(docs, named_vocabulary(spark), "kept", lambda voc: clinical.kept_expr("text", "found", voc)).select("doc_id", F.inline_outer("kept")).where("start is not null")
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("end") - F.col("start")).alias("chars"))


_VALUES = (
    "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Patient: ' || c_mktsegment || ' Grant, MD' WHEN 1 THEN 'Avery Archer. Seen again today' WHEN 2 THEN 'Dr. A. Brooks DOB 1/2/1990' "
    "WHEN 3 THEN 'Casey Ellis Per nursing' ELSE c_name || ' ; ' END AS value FROM customer"
)


@query("trimmed_values", f"SELECT c_custkey, CAST(lead AS BIGINT) AS lead, {KEPT} AS kept FROM ({TRIMMED} ({_VALUES}))")
def trimmed_values(spark, sf_dir):
    c = F.col("c_custkey") % 5
    value = (
        F.when(c == 0, F.concat(F.lit("Patient: "), "c_mktsegment", F.lit(" Grant, MD"))).when(c == 1, "Avery Archer. Seen again today").when(c == 2, "Dr. A. Brooks DOB 1/2/1990")
        .when(c == 3, "Casey Ellis Per nursing").otherwise(F.concat("c_name", F.lit(" ; ")))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", value.alias("v")).select("c_custkey", F.expr(clinical.trimmed_expr("v")).alias("t")).select("c_custkey", "t.*")
