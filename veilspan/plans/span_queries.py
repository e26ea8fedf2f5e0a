"""Queries over spans: detection, algebra, rendering, zones, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rules import DIRECT_RULES, FIELD_RULES, PRIORITY, RESIDUAL_RULES, Rule
from ..operators import evaluate, lines, spans
from ..sources.notes import FIRST, LAST
from .base import _ungrouped, merged_sql, noted, query, spans_sql, spread, table

BY_NAME = {r.name: r for r in DIRECT_RULES}
CORE = [BY_NAME["email"], BY_NAME["ipv4"], BY_NAME["us_phone"], BY_NAME["card"]]
LONG_DIGITS = Rule("digits", "ID", r"[0-9]{4,}")
_LIST = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"

NOTES_SQL = f"""
SELECT doc_id, 'Patient: ' || name || chr(10) || 'DOB: ' || dob || chr(10) || 'MRN: ' || mrn || chr(10) || 'Phone: ' || phone || chr(10) || 'Email: ' || email
  || chr(10) || 'Employer: ' || emp || chr(10) || 'Labs:' || chr(10) || 'WBC 7.' || doc_id % 10 || ' (4.0-11.0)' || chr(10) || 'stable' || chr(10) || 'Sodium 13' || doc_id % 10
  || ' mmol/L' || chr(10) || 'BP 1' || (doc_id % 60 + 10) || '/80 HR 72' || chr(10) || 'metoprolol 25 mg BID' || chr(10) || chr(10) || chr(10) || 'Assessment: improving' AS text, *
FROM (SELECT c_custkey AS doc_id, {_LIST(FIRST)}[c_custkey % {len(FIRST)} + 1] || ' ' || {_LIST(LAST)}[(c_custkey // 7) % {len(LAST)} + 1] AS name,
  CAST(CAST(DATE '1950-01-01' + CAST(c_custkey * 37 % 18000 AS INTEGER) AS DATE) AS VARCHAR) AS dob, CAST(c_custkey + 1000000 AS VARCHAR) AS mrn,
  '(' || (c_custkey % 800 + 200) || ') 555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone, 'user' || c_custkey || '@mail.example.org' AS email,
  'Unit ' || (c_custkey % 90) || ' Works' AS emp FROM customer)
"""


def _one(rule: Rule):
    def run(spark, sf_dir):
        return spans.detect(table(spark, sf_dir, "documents"), [rule])

    return run


for _name, _rule in (("email_spans", "email"), ("phone_spans", "us_phone"), ("ip_spans", "ipv4"), ("card_spans", "card"), ("hex_spans", "hex_code")):
    query(_name, spans_sql([BY_NAME[_rule]], "documents"))(_one(BY_NAME[_rule]))


@query("note_rule_spans", spans_sql(FIELD_RULES + DIRECT_RULES, f"({NOTES_SQL})"))
def note_rule_spans(spark, sf_dir):
    return spans.detect(noted(spark, sf_dir), FIELD_RULES + DIRECT_RULES)


_CORE_SQL = spans_sql(CORE + [LONG_DIGITS], "documents")


@query("span_union_counts", f"SELECT label, count(*) AS spans, count(DISTINCT doc_id) AS docs FROM ({_CORE_SQL}) GROUP BY label")
def span_union_counts(spark, sf_dir):
    found = spans.detect(table(spark, sf_dir, "documents"), CORE + [LONG_DIGITS])
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("doc_id").alias("docs"))


_CORE_RULES = CORE + [LONG_DIGITS]


@query("span_merge", f'SELECT doc_id, "start", "end", label, members FROM ({merged_sql(_CORE_SQL, _CORE_RULES, PRIORITY)})')
def span_merge(spark, sf_dir):
    return spans.merge_found(spread(table(spark, sf_dir, "documents")), _CORE_RULES).drop("source")


_MIXED = f"(SELECT *, CASE WHEN rule = 'digits' THEN 'model' WHEN rule = 'card' THEN 'pattern' ELSE 'structured' END AS source FROM ({_CORE_SQL}))"


@query("span_merge_sources", merged_sql(_MIXED, _CORE_RULES, PRIORITY, "source"))
def span_merge_sources(spark, sf_dir):
    found = spans.detect(spread(table(spark, sf_dir, "documents")), _CORE_RULES)
    source = F.when(F.col("rule") == "digits", "model").when(F.col("rule") == "card", "pattern").otherwise("structured")
    rank = F.array_position(F.array(*[F.lit(r.name) for r in _CORE_RULES]), F.col("rule"))
    return spans.merge(found.withColumns({"source": source, "rank": rank}), order=["rank"])


@query(
    "span_overlap_pairs",
    f"WITH a AS ({spans_sql(CORE, 'documents')}), b AS ({spans_sql([LONG_DIGITS], 'documents')}) "
    'SELECT a.doc_id, a.label AS label_a, a.start AS start_a, b.start AS start_b FROM a JOIN b ON a.doc_id = b.doc_id AND a.start < b."end" AND b.start < a."end"',
)
def span_overlap_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pairs = spans.overlaps(spans.detect(docs, CORE), spans.detect(docs, [LONG_DIGITS]))
    return pairs.select("doc_id", "label_a", "start_a", "start_b")


@query(
    "span_containment",
    f"WITH a AS ({spans_sql([LONG_DIGITS], 'documents')}), b AS ({spans_sql(CORE, 'documents')}) "
    'SELECT a.doc_id, a.start AS start_a, a."end" AS end_a, min(b.start) AS start_b FROM a JOIN b ON a.doc_id = b.doc_id AND b.start <= a.start AND b."end" >= a."end" GROUP BY ALL',
)
def span_containment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    inner, outer = (spans.detect(docs, r).select("doc_id", "start", "end") for r in ([LONG_DIGITS], CORE))
    return spans.containing(inner, outer).select("doc_id", "start_a", "end_a", "start_b")


@query("span_sort", f'SELECT doc_id, start, "end", CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, rule) AS BIGINT) AS ord FROM ({_CORE_SQL})')
def span_sort(spark, sf_dir):
    found = spans.detect(table(spark, sf_dir, "documents"), CORE + [LONG_DIGITS])
    order = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "rule")
    return found.select("doc_id", "start", "end", F.row_number().over(order).cast("long").alias("ord"))


_REDACTED = f"regexp_replace(regexp_replace(text, '{BY_NAME['email'].pattern}', '[EMAIL]', 'g'), '{BY_NAME['ipv4'].pattern}', '[IP]', 'g')"


_SAFE_RULES = [BY_NAME["email"], BY_NAME["ipv4"]]


@query("redacted_text", f"SELECT doc_id, sha256({_REDACTED}) AS sha, CAST(length({_REDACTED}) AS BIGINT) AS chars FROM documents")
def redacted_text(spark, sf_dir):
    return spans.redact(spread(table(spark, sf_dir, "documents")), _SAFE_RULES).select("doc_id", F.sha2("text", 256).alias("sha"), F.length("text").cast("long").alias("chars"))


@query(
    "residual_scan",
    f"SELECT rule, severity, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM ({spans_sql(RESIDUAL_RULES, f'(SELECT doc_id, {_REDACTED} AS text FROM documents)')}) GROUP BY ALL",
)
def residual_scan(spark, sf_dir):
    found = spans.detect(spans.redact(spread(table(spark, sf_dir, "documents")), _SAFE_RULES), RESIDUAL_RULES)
    return found.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("doc_id").alias("docs"))


@query(
    "placeholder_ordinals",
    f'SELECT doc_id, label, start, CAST(row_number() OVER (PARTITION BY doc_id, label ORDER BY start, "end") - 1 AS BIGINT) AS ordinal FROM ({spans_sql(CORE, "documents")})',
)
def placeholder_ordinals(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("start", "end"))
    return spans.detect(table(spark, sf_dir, "documents"), CORE).select("doc_id", "label", "start", (n - 1).cast("long").alias("ordinal"))


@query(
    "review_specificity",
    f"""SELECT doc_id, start, "end", rule FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY
      CASE WHEN label = 'PATIENT NAME' THEN 40 WHEN label = 'NAME' THEN 20 ELSE 5 END DESC, rule) AS n FROM ({spans_sql(FIELD_RULES + DIRECT_RULES, f"({NOTES_SQL})")})) WHERE n = 1""",
)
def review_specificity(spark, sf_dir):
    found = spans.detect(noted(spark, sf_dir), FIELD_RULES + DIRECT_RULES)
    weight = F.when(F.col("label") == "PATIENT NAME", 40).when(F.col("label") == "NAME", 20).otherwise(5)
    n = F.row_number().over(Window.partitionBy("doc_id", "start", "end").orderBy(weight.desc(), "rule"))
    return found.withColumn("n", n).where("n = 1").select("doc_id", "start", "end", "rule")


# ---- lines and zones --------------------------------------------------------------------------


def _lines_sql(source: str) -> str:
    return f"""SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, ls[i] AS line,
      CAST(list_sum(list_transform(ls[1:i], lambda x: length(x) + 1)) - 1 AS BIGINT) AS "end" FROM (
      SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {source}))"""


def _kind_sql(line: str) -> str:
    test = lambda p: f"regexp_matches({line}, '{p}')"
    return (
        f"CASE WHEN trim({line}) = '' THEN 'blank' WHEN {test(lines.NARRATIVE)} THEN 'narrative' WHEN {test(lines.IMAGING)} THEN 'imaging' "
        f"WHEN {test(lines.VITALS)} THEN 'vitals' WHEN {test(lines.MEDS)} THEN 'meds' WHEN {test(lines.LAB)} THEN 'lab' "
        f"WHEN {test(lines.LAB_HEADER)} THEN 'lab_header' ELSE 'narrative' END"
    )


@query("line_offsets", f'SELECT doc_id, line_no, CAST("end" - length(line) AS BIGINT) AS start, "end" FROM ({_lines_sql("documents")})')
def line_offsets(spark, sf_dir):
    return lines.split_lines(table(spark, sf_dir, "documents")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("line_kinds", f"SELECT {_kind_sql('line')} AS kind, count(*) AS lines FROM (SELECT * FROM ({_lines_sql('documents')}) UNION ALL SELECT * FROM ({_lines_sql(f'({NOTES_SQL})')})) GROUP BY 1")
def line_kinds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(noted(spark, sf_dir).select("doc_id", "text"))
    each = docs.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return each.groupBy(lines.kind(F.col("line")).alias("kind")).agg(F.count(F.lit(1)).alias("lines"))


@query(
    "line_density",
    f"SELECT doc_id, line_no, CASE WHEN length(line) > 0 THEN round(length(regexp_replace(line, '[^0-9]', '', 'g')) / length(line), 6) ELSE 0.0 END AS density FROM ({_lines_sql('documents')})",
)
def line_density(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return each.select("doc_id", F.col("line_no").cast("long").alias("line_no"), lines.density(F.col("line")).alias("density"))


@query(
    "blank_runs",
    f"""SELECT doc_id, min(line_no) AS first_line, count(*) AS lines FROM (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g
      FROM ({_lines_sql(f'({NOTES_SQL})')}) WHERE trim(line) = '') GROUP BY doc_id, g""",
)
def blank_runs(spark, sf_dir):
    found = lines.blank_runs(lines.split_lines(noted(spark, sf_dir)))
    return found.select("doc_id", F.col("first_line").cast("long").alias("first_line"), "lines")


_W = "OVER (PARTITION BY doc_id ORDER BY line_no)"
_ZONES_SQL = f"""
WITH k AS (SELECT *, {_kind_sql('line')} AS kind FROM ({_lines_sql(f'({NOTES_SQL})')})),
b AS (SELECT *, CASE WHEN kind = 'lab_header' AND (coalesce(lead(kind, 1) {_W} = 'lab', false) OR coalesce(lead(kind, 2) {_W} = 'lab', false) OR coalesce(lead(kind, 3) {_W} = 'lab', false))
  THEN 'lab' WHEN kind = 'lab_header' THEN 'narrative' ELSE kind END AS base FROM k),
s AS (SELECT *, CASE WHEN lag(base) {_W} = 'lab' AND lead(base) {_W} = 'lab' AND length(line) <= 40 AND base = 'narrative' THEN 'lab' ELSE base END AS smooth,
  CASE WHEN kind = 'imaging' THEN 1 WHEN regexp_matches(line, '{lines.NARRATIVE}') OR (kind = 'blank' AND lag(kind) {_W} = 'blank') THEN 0 END AS event FROM b)
SELECT doc_id, line_no, kind, CASE WHEN coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) = 1
  AND smooth IN ('narrative', 'imaging') THEN 'imaging' ELSE smooth END AS zone FROM s
"""


@query("zones", _ZONES_SQL)
def zones(spark, sf_dir):
    found = lines.zones(lines.split_lines(noted(spark, sf_dir)))
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "kind", "zone")


@query(
    "zone_of_span",
    f"""WITH z AS ({_ZONES_SQL}), l AS ({_lines_sql(f'({NOTES_SQL})')}), sp AS ({spans_sql([BY_NAME['email'], LONG_DIGITS], f'({NOTES_SQL})')})
    SELECT sp.doc_id, sp.start, CASE WHEN count(DISTINCT z.zone) = 1 THEN min(z.zone) ELSE 'narrative' END AS zone
    FROM sp JOIN l ON sp.doc_id = l.doc_id AND sp.start < l."end" AND l."end" - length(l.line) < sp."end" JOIN z ON z.doc_id = l.doc_id AND z.line_no = l.line_no GROUP BY sp.doc_id, sp.start""",
)
def zone_of_span(spark, sf_dir):
    corpus = noted(spark, sf_dir)
    zoned = lines.zones(lines.split_lines(corpus)).where("start < end").select("doc_id", "start", "end", "zone")
    found = spans.detect(corpus, [BY_NAME["email"], LONG_DIGITS]).select("doc_id", "start", "end")
    met = spans.overlaps(found, zoned)
    one = F.when(F.count_distinct("zone_b") == 1, F.min("zone_b")).otherwise("narrative")
    return met.groupBy("doc_id", F.col("start_a").alias("start")).agg(one.alias("zone"))


# ---- evaluation -------------------------------------------------------------------------------

_TRUTH_SQL = f"""
SELECT doc_id, category, key, CAST(instr(text, lead || key) - 1 + length(lead) AS BIGINT) AS start, CAST(instr(text, lead || key) - 1 + length(lead) + length(key) AS BIGINT) AS "end" FROM (
  SELECT doc_id, text, unnest([{{'lead': 'Patient: ', 'key': name, 'category': 'PATIENT NAME'}}, {{'lead': 'DOB: ', 'key': dob, 'category': 'DOB'}}, {{'lead': 'MRN: ', 'key': mrn, 'category': 'MRN'}},
    {{'lead': 'Phone: ', 'key': phone, 'category': 'PHONE'}}, {{'lead': 'Email: ', 'key': email, 'category': 'EMAIL'}}, {{'lead': 'Employer: ', 'key': emp, 'category': 'ORGANIZATION'}}], recursive := true)
  FROM ({NOTES_SQL}))
"""
_GRADED_RULES = [r for r in FIELD_RULES if r.name in ("line_patient", "line_dob", "line_phone")] + [Rule("digits", "ID", r"\b[0-9]{7}\b"), BY_NAME["email"]]
_GRADE_SQL = f"""
WITH t AS ({_TRUTH_SQL}), f AS ({spans_sql(_GRADED_RULES, f'({NOTES_SQL})')}),
g AS (SELECT t.doc_id, t.category, t.key, t.start, t."end", count(f.start) AS touched,
    arg_min(f.label, (f.start, f."end", f.label)) FILTER (f.start <= t.start AND f."end" >= t."end") AS label
  FROM t LEFT JOIN f ON f.doc_id = t.doc_id AND f.start < t."end" AND t.start < f."end" GROUP BY ALL)
SELECT *, CASE WHEN touched = 0 THEN 'missed' WHEN label IS NULL THEN 'partial' WHEN replace(label, ' ', '_') <> replace(category, ' ', '_') THEN 'mislabelled' ELSE 'exact' END AS state FROM g
"""


def _truth(spark, sf_dir):
    corpus = noted(spark, sf_dir)
    return corpus, corpus.select("doc_id", F.explode("truth").alias("t")).select("doc_id", "t.*")


def _graded(spark, sf_dir):
    return noted(spark, sf_dir).select("doc_id", F.inline(evaluate.grade_row(F.col("truth"), spans.find("text", _GRADED_RULES))))


@query("truth_spans", f'SELECT doc_id, category, key, start, "end" FROM ({_TRUTH_SQL})')
def truth_spans(spark, sf_dir):
    return _truth(spark, sf_dir)[1].select("doc_id", "category", "key", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(
    "grade_metrics",
    f"""SELECT category, count(*) AS truth, count(*) FILTER (label IS NOT NULL) AS detected, count(*) FILTER (state = 'exact') AS exact,
    round(count(*) FILTER (label IS NOT NULL) / count(*), 6) AS recall, round(count(*) FILTER (state = 'exact') / nullif(count(*) FILTER (label IS NOT NULL), 0), 6) AS accuracy FROM ({_GRADE_SQL}) GROUP BY category""",
)
def grade_metrics(spark, sf_dir):
    return evaluate.metrics(_graded(spark, sf_dir))


@query(
    "corpus_eligibility",
    "SELECT count(*) AS cases, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(min(length(text)) AS BIGINT) AS shortest, count(*) FILTER (length(text) >= 10000) AS eligible, count(*) - count(DISTINCT doc_id) AS repeated FROM documents",
)
def corpus_eligibility(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "documents").agg(
        F.count(F.lit(1)).alias("cases"), F.sum(n).alias("chars"), F.min(n).cast("long").alias("shortest"), F.count_if(n >= 10000).alias("eligible"),
        (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("repeated"),
    )


# ---- guards -----------------------------------------------------------------------------------

_SLASH = r"\b([0-9]{1,3})/([0-9]{1,3})\b"


_SLASH_SQL = _ungrouped(_SLASH)


@query(
    "guard_slash_values",
    f"""SELECT doc_id, value, CASE WHEN TRY_CAST(split_part(value, '/', 2) AS INTEGER) <= 10 THEN 'score' ELSE 'ratio' END AS verdict
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_SLASH_SQL}')) AS value FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM ({NOTES_SQL})))""",
)
def guard_slash_values(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").union(noted(spark, sf_dir).select("doc_id", "text"))
    found = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_SLASH), F.lit(0))).alias("value"))
    below = F.substring_index("value", "/", -1).cast("int")
    return found.select("doc_id", "value", F.when(below <= 10, "score").otherwise("ratio").alias("verdict"))


_RESULT = r"^[A-Za-z][A-Za-z ]*[:\t ]+[0-9.]+ ?(?:mmol/L|mg/dL|\(|%)"


@query("result_lines", f"SELECT doc_id, line_no FROM ({_lines_sql(f'({NOTES_SQL})')}) WHERE regexp_matches(line, '{_RESULT}')")
def result_lines(spark, sf_dir):
    each = lines.split_lines(noted(spark, sf_dir)).where(F.col("line").rlike(_RESULT))
    return each.select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query(
    "inside_bracket",
    f"""SELECT doc_id, start, regexp_matches(substr(t, 1, CAST(start AS INTEGER)), '\\[[^\\]]*$') AND regexp_matches(substr(t, CAST("end" + 1 AS INTEGER)), '^[^\\[]*\\]') AS inside
    FROM ({spans_sql([LONG_DIGITS], "(SELECT doc_id, replace(text, '.', ']') AS text FROM documents)")}) s JOIN (SELECT doc_id AS d, replace(text, '.', ']') AS t FROM documents) x ON x.d = s.doc_id""",
)
def inside_bracket(spark, sf_dir):
    t = "replace(text, '.', ']')"
    found = spans.inside_bracket(t, spans.find(t, [LONG_DIGITS]))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(found)).select("doc_id", "start", "inside")


@query(
    "token_boundary",
    f"""SELECT doc_id, start, CAST(start - length(regexp_extract(substr(text, 1, CAST(start AS INTEGER)), '[A-Za-z0-9]*$')) AS BIGINT) AS grown_start,
    CAST("end" + length(regexp_extract(substr(text, CAST("end" + 1 AS INTEGER)), '^[A-Za-z0-9]*')) AS BIGINT) AS grown_end
    FROM ({spans_sql([Rule('mid', 'ID', '[0-9]{4}')], 'documents')}) JOIN (SELECT doc_id AS d, text FROM documents) ON d = doc_id""",
)
def token_boundary(spark, sf_dir):
    found = spans.to_token_edges(F.col("text"), spans.find("text", [Rule("mid", "ID", "[0-9]{4}")]))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(found)).select("doc_id", "start", "grown_start", "grown_end")
