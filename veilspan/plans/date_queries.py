"""Queries over dates in free text: found, resolved, anchored, placed, rendered."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dates, spans
from .base import merged_sql, query, spans_sql, spread, table
from .record_queries import _duration_sql

_MON = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_REF = "2026-06-15"


def dated_notes(spark, sf_dir):
    """A note for each customer, with dates in many forms and numbers that look like dates."""
    i = F.col("c_custkey")
    s = lambda c: c.cast("long").cast("string")
    mon = F.element_at(F.array(*[F.lit(m) for m in _MON]), (i % 12 + 1).cast("int"))
    m, d = s(i % 12 + 1), s(i % 28 + 1)
    lead = F.when(i % 3 == 0, F.concat(F.lit("Admission date: "), m, F.lit("/"), d, F.lit("/2026\n"))).when(i % 3 == 1, F.concat(F.lit("Collected: 2026-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"), F.lit("\n"))).otherwise("")
    body = F.concat(
        F.lit("Seen on "), mon, F.lit(" "), d, F.lit(" and "), s(i % 12 + 1), F.lit("/"), s(i * 7 % 31 + 1), F.lit(", pain 3/10, BP 120/80 mmHg.\nBegan "), s(i % 9 + 1),
        F.lit(" days ago, ill for "), s(i % 5 + 2), F.lit(" weeks later; follow up "), s((i + 1) % 12 + 1), F.lit("/2/2026.\nDOB: 1/"), d, F.lit("/19"), s(i % 50 + 40),
        F.lit("\nSurgery in "), mon, F.lit(" 2019 on 0"), s(i % 9 + 1), F.lit("-Mar-18; odd 2/30/2026; seen today, round 5/8 04"), F.lpad(s(i % 60), 2, "0"), F.lit(" and "), mon, F.lit(" 3-5, then 3/4 at "), s(i % 12 + 1), F.lit(":05 pm; 5/9 1200 mg, 5/10 2015"),
    )
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select(i.alias("doc_id"), F.concat(lead, body).alias("text"))


_S = lambda x: f"CAST({x} AS VARCHAR)"
_M = "[" + ", ".join(f"'{m}'" for m in _MON) + "][CAST(i % 12 + 1 AS BIGINT)]"
_NOTES = f"""SELECT i AS doc_id, CASE i % 3 WHEN 0 THEN 'Admission date: ' || {_S('i % 12 + 1')} || '/' || {_S('i % 28 + 1')} || '/2026' || chr(10)
  WHEN 1 THEN 'Collected: 2026-' || lpad({_S('i % 12 + 1')}, 2, '0') || '-' || lpad({_S('i % 28 + 1')}, 2, '0') || chr(10) ELSE '' END
  || 'Seen on ' || {_M} || ' ' || {_S('i % 28 + 1')} || ' and ' || {_S('i % 12 + 1')} || '/' || {_S('i * 7 % 31 + 1')} || ', pain 3/10, BP 120/80 mmHg.' || chr(10) || 'Began ' || {_S('i % 9 + 1')}
  || ' days ago, ill for ' || {_S('i % 5 + 2')} || ' weeks later; follow up ' || {_S('(i + 1) % 12 + 1')} || '/2/2026.' || chr(10) || 'DOB: 1/' || {_S('i % 28 + 1')} || '/19' || {_S('i % 50 + 40')} || chr(10)
  || 'Surgery in ' || {_M} || ' 2019 on 0' || {_S('i % 9 + 1')} || '-Mar-18; odd 2/30/2026; seen today, round 5/8 04' || lpad({_S('i % 60')}, 2, '0') || ' and ' || {_M} || ' 3-5, then 3/4 at ' || {_S('i % 12 + 1')} || ':05 pm; 5/9 1200 mg, 5/10 2015' AS text FROM (SELECT c_custkey AS i FROM customer)"""
_RANK = [r.name for r in dates.RULES]
_Q = lambda p: "'" + p.replace("'", "''") + "'"
_DIRECTION = "CASE " + " ".join(
    f"WHEN regexp_matches(before, {_Q(p)}) THEN '{n}'"
    for n, p in (("birth", dates.BIRTH), ("source", dates.SOURCE), ("admission", dates.ADMISSION), ("future", dates.FUTURE), ("past", dates.PAST), ("current", dates.CURRENT))
) + " ELSE 'neutral' END"
_N = "regexp_extract_all(value, '[0-9]+')"
_FULL = lambda x: f"CASE WHEN length({x}) = 2 THEN '20' || {x} ELSE {x} END"
_MPOS = "CAST(list_position([" + ", ".join(f"'{m}'" for m in dates.MONTHS) + "], lower(regexp_extract(value, '[A-Za-z]{3}'))) AS VARCHAR)"
_NEAREST = lambda ahead: f"""(SELECT arg_min(x, (abs(x - ref), x)) FROM (SELECT TRY_CAST((year(ref) + k) || '-' || m || '-' || d AS DATE) AS x FROM (SELECT unnest([-1, 0, 1]) AS k)) WHERE x IS NOT NULL AND x - ref <= {ahead})"""
_DAYS = ", ".join(f"'{k}'" for k in dates.DAYS)


def dates_sql(notes: str) -> str:
    return f"""
WITH RECURSIVE notes AS MATERIALIZED ({notes}), merged AS ({merged_sql(spans_sql(dates.RULES, 'notes'), dates.RULES, [])}),
near AS (SELECT m.doc_id, m."start", m."end", m.label AS kind, substr(text, CAST("start" + 1 AS INTEGER), CAST("end" - "start" AS INTEGER)) AS value,
  string_split(substr(text, CAST(greatest("start" - 48, 0) + 1 AS INTEGER), CAST(least("start", 48) AS INTEGER)), chr(10))[-1] AS before, substr(text, CAST("end" + 1 AS INTEGER), 24) AS after
  FROM merged m JOIN notes n ON n.doc_id = m.doc_id),
clear AS MATERIALIZED (SELECT *, {_DIRECTION} AS context, regexp_extract(after, {_Q(dates.CLOCK)}) AS c0 FROM near WHERE NOT (kind = 'md' AND (regexp_matches(before, {_Q(dates.SCORE)}) OR regexp_matches(after, {_Q(dates.UNIT)}) OR value = '2/2') OR kind = 'ago' AND regexp_matches(before, {_Q(dates.DURATION)}))),
good AS (SELECT doc_id, "start", CAST("end" + length(c) AS BIGINT) AS "end", kind, value, context, trim(regexp_extract(c, '[0-9].*$')) AS clock FROM (SELECT *, CASE WHEN kind IN ({_DAYS}) AND NOT regexp_matches(substr(after, length(c0) + 1), {_Q(dates.DOSE)}) THEN c0 ELSE '' END AS c FROM clear)
  UNION ALL SELECT doc_id, CAST("end" + length(l) AS BIGINT), CAST("end" + length(l) + length(d) AS BIGINT), kind, regexp_extract(value, '^[A-Za-z]+') || ' ' || d, context, '' FROM (
    SELECT *, regexp_extract(after, {_Q(dates.UNTIL)}, 1) AS l, regexp_extract(after, {_Q(dates.UNTIL)}, 2) AS d FROM clear WHERE kind = 'mon_d' AND regexp_matches(after, {_Q(dates.UNTIL)}))),
p AS (SELECT *, DATE '{_REF}' AS ref,
  CASE WHEN kind IN ('iso', 'mon_y') THEN {_N}[1] WHEN kind IN ('mdy', 'mdy2', 'dash') THEN {_FULL(_N + '[3]')} WHEN kind IN ('mon_d_y', 'm_y') THEN {_N}[2] WHEN kind = 'd_mon' THEN {_FULL(_N + '[2]')} END AS y,
  CASE WHEN kind = 'iso' THEN {_N}[2] WHEN kind IN ('mdy', 'mdy2', 'dash', 'md', 'm_y') THEN {_N}[1] WHEN kind IN ('mon_d_y', 'd_mon', 'mon_d', 'mon_y') THEN {_MPOS} END AS m,
  CASE WHEN kind = 'iso' THEN {_N}[3] WHEN kind IN ('mdy', 'mdy2', 'dash', 'md') THEN {_N}[2] WHEN kind IN ('mon_d_y', 'd_mon', 'mon_d') THEN {_N}[1] WHEN kind IN ('mon_y', 'm_y') THEN '1' END AS d FROM good),
dated AS MATERIALIZED (SELECT *, TRY_CAST(y || '-' || m || '-' || d AS DATE) AS said, CAST(CASE WHEN kind = 'ago' THEN
    CASE WHEN contains(value, 'day') THEN ref + (CASE WHEN value LIKE '%ago' THEN -1 ELSE 1 END) * CAST({_N}[1] AS INTEGER) ELSE ref + (CASE WHEN value LIKE '%ago' THEN -7 ELSE 7 END) * CAST({_N}[1] AS INTEGER) END
  WHEN kind = 'casual' THEN ref + CASE lower(value) WHEN 'yesterday' THEN -1 WHEN 'tomorrow' THEN 1 ELSE 0 END
  WHEN kind IN ('mon_d', 'md') THEN CASE WHEN context = 'future' THEN {_NEAREST(366)} ELSE {_NEAREST(30)} END ELSE TRY_CAST(y || '-' || m || '-' || d AS DATE) END AS DATE) AS date FROM p)
"""


_DATES = dates_sql(_NOTES)
_OWN = "FILTER (context <> 'birth' AND date IS NOT NULL AND {})"
def anchored_sql(notes: str) -> str:
    return f"""{dates_sql(notes)}, last AS (SELECT doc_id, max(date) {_OWN.format("said IS NOT NULL AND kind NOT IN ('mon_y', 'm_y')")} AS latest FROM dated GROUP BY doc_id),
anchors AS (SELECT x.doc_id, coalesce(max(date) {_OWN.format("context = 'source' AND said IS NOT NULL")}, min(date) {_OWN.format("context = 'admission'")}, max(date) {_OWN.format("context = 'current'")},
    CASE WHEN any_value(latest) IS NULL THEN arg_max(date, "start") {_OWN.format('true')} END, min(date) {_OWN.format("said IS NOT NULL AND kind NOT IN ('mon_y', 'm_y') AND latest - date <= 14")}) AS anchor
  FROM dated x JOIN last l ON l.doc_id = x.doc_id GROUP BY x.doc_id)"""


_ANCHORED = anchored_sql(_NOTES)


_HOUR = "CAST(CASE WHEN contains(clock, ':') THEN split_part(clock, ':', 1) ELSE lpad(clock, 4, '0')[1:2] END AS INTEGER)"
_MINUTE = "CASE WHEN contains(clock, ':') THEN regexp_extract(clock, ':([0-9]{2})', 1) ELSE lpad(clock, 4, '0')[3:4] END"
_CLOCKED = f"""CASE WHEN clock = '' THEN NULL WHEN regexp_matches(clock, '[AaPp][Mm]$') THEN CASE WHEN contains(clock, ':') AND {_HOUR} BETWEEN 1 AND 12 THEN lpad(CAST({_HOUR} % 12 + CASE WHEN regexp_matches(clock, '[Pp][Mm]$') THEN 12 ELSE 0 END AS VARCHAR), 2, '0') || ':' || {_MINUTE} END
  ELSE lpad(CAST({_HOUR} AS VARCHAR), 2, '0') || ':' || {_MINUTE} END"""


def placed_sql(notes: str) -> str:
    """``(doc_id, start, end, context, label)``: each date's label on its text's timeline."""
    each = 'SELECT d.*, d.doc_id || chr(58) || d."start" AS k, anchor, date - anchor + 1 AS n FROM dated d JOIN anchors a ON a.doc_id = d.doc_id'
    return f"""{anchored_sql(notes)}, each AS MATERIALIZED ({each}), lasted AS ({_duration_sql("date", "anchor", "(SELECT * FROM each WHERE date < anchor)", "k")})
    SELECT doc_id, "start", "end", context, CASE WHEN context = 'birth' THEN 'DOB' WHEN date IS NULL THEN 'Historical date' WHEN kind IN ('mon_y', 'm_y') THEN 'Historical: ' || year(date) WHEN anchor IS NULL THEN 'Historical date'
      WHEN n >= 1 AND context <> 'past' THEN concat_ws(' at ', 'Hospital Day ' || n, {_CLOCKED}) WHEN n >= 1 THEN 'Historical date' ELSE phrase || ' prior to hospital admission' END AS label
    FROM each LEFT JOIN lasted USING (k)"""


@query("date_spans", f'{_DATES} SELECT doc_id, "start", "end", kind, value, context, clock FROM dated')
def date_spans(spark, sf_dir):
    return dated_notes(spark, sf_dir).select("doc_id", F.inline(dates.find("text")))


_DAY = lambda: F.lit(_REF).cast("date")


@query("date_values", f'{_DATES} SELECT doc_id, "start", CAST(said AS VARCHAR) AS said, CAST(date AS VARCHAR) AS date FROM dated')
def date_values(spark, sf_dir):
    found = dated_notes(spark, sf_dir).select("doc_id", F.inline(dates.timed("text", _DAY())))
    return found.select("doc_id", "start", F.col("said").cast("string").alias("said"), F.col("date").cast("string").alias("date"))


@query("date_anchor", f"{_ANCHORED} SELECT doc_id, CAST(anchor AS VARCHAR) AS anchor FROM anchors")
def date_anchor(spark, sf_dir):
    found = dated_notes(spark, sf_dir).select("doc_id", dates.anchor(dates.timed("text", _DAY()), F.lit(None).cast("date")).alias("anchor"))
    return found.select("doc_id", F.col("anchor").cast("string").alias("anchor"))


@query("date_places", f'SELECT doc_id, "start", label FROM ({placed_sql(_NOTES)})')
def date_places(spark, sf_dir):
    return dated_notes(spark, sf_dir).select("doc_id", F.inline(dates.timed("text", _DAY()))).select("doc_id", "start", "label")


_SPLICED = f"""WITH docs AS MATERIALIZED ({_NOTES}), placed AS MATERIALIZED ({placed_sql(_NOTES)}), parts AS (
  SELECT d.doc_id, p."start" AS pos, substr(d.text, CAST(lag(p."end", 1, 0) OVER w + 1 AS INTEGER), CAST(p."start" - lag(p."end", 1, 0) OVER w AS INTEGER)) || '[' || p.label || ']' AS piece FROM placed p JOIN docs d ON d.doc_id = p.doc_id WINDOW w AS (PARTITION BY p.doc_id ORDER BY p."start")
  UNION ALL SELECT d.doc_id, 1e12, substr(d.text, CAST(max(p."end") + 1 AS INTEGER)) FROM placed p JOIN docs d ON d.doc_id = p.doc_id GROUP BY d.doc_id, d.text)
SELECT doc_id, regexp_replace(string_agg(piece, '' ORDER BY pos), {_Q(dates.FIELD)}, '\\1Timeline\\2', 'g') AS text FROM parts GROUP BY doc_id"""


@query("timeline_text", _SPLICED)
def timeline_text(spark, sf_dir):
    timed = dated_notes(spark, sf_dir).withColumn("timed", dates.timed("text", _DAY()))
    return timed.select("doc_id", dates.renamed_fields(F.expr(spans.splice_expr("text", "timed"))).alias("text"))


@query("legacy_placeholders", "SELECT e.event_id, CASE event_id % 4 WHEN 0 THEN 'x [Historical date] y' WHEN 1 THEN 'x [Hospital Day ' || (event_id % 30) || '] y' WHEN 2 THEN 'x [Hospital Day 7] y' ELSE 'x [DOB] y' END AS text FROM events e")
def legacy_placeholders(spark, sf_dir):
    k = F.col("event_id") % 4
    old = F.when(k == 0, "[Exact date]").when(k == 1, F.concat(F.lit("[hospital day #"), (F.col("event_id") % 30).cast("string"), F.lit("]"))).when(k == 2, "[HD 7]").otherwise("[Birth date]")
    return table(spark, sf_dir, "events").select("event_id", dates.converted(F.concat(F.lit("x "), old, F.lit(" y"))).alias("text"))


@query(
    "inferred_years",
    """WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, o_orderpriority LIKE '1%' AS current FROM orders),
    c AS (SELECT DISTINCT o_custkey, year(date) + k AS y FROM o, (SELECT unnest([-1, 0, 1]) AS k)),
    s AS (SELECT c.o_custkey, y, sum(abs(TRY_CAST(y || '-' || (c.o_custkey % 12 + 1) || '-' || (c.o_custkey % 28 + 1) AS DATE) - date) * CASE WHEN current THEN 3 ELSE 1 END) AS far FROM c JOIN o ON o.o_custkey = c.o_custkey GROUP BY ALL)
    SELECT o_custkey, CAST(arg_min(y, (far, abs(y - 1995), y)) AS INTEGER) AS year FROM s GROUP BY o_custkey""",
)
def inferred_years(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").startswith("1").alias("current"))
    said = rows.groupBy("o_custkey").agg(F.collect_list(F.struct("date", "current")).alias("said"))
    k = F.col("o_custkey")
    return said.select("o_custkey", dates.inferred_year(k % 12 + 1, k % 28 + 1, F.col("said"), F.lit(1995)).alias("year"))
