"""Queries over the measuring corpus: its cases, grading of the engine's rules on it, failures and survivors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import DIRECT_RULES, FIELD_RULES, PRIORITY
from ..operators import evaluate, spans
from ..scratch import settled
from ..sources import corpus
from .base import merged_sql, query, spans_sql, spread, table

_ALL = FIELD_RULES + DIRECT_RULES


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, by: str) -> str:
    return f"{_list(values)}[CAST(({by}) % {len(values)} + 1 AS BIGINT)]"


def _filled(pattern: str, values: dict[str, str], mark: str) -> str:
    parts, rest = [], pattern
    while rest:
        before, _, rest = rest.partition(mark[0])
        if before:
            parts.append("'" + before.replace("'", "''") + "'")
        if rest:
            name, _, rest = rest.partition(mark[1])
            parts.append(values[name])
    return "(" + " || ".join(parts) + ")"


def _cases_sql() -> str:
    text = lambda x: f"CAST({x} AS VARCHAR)"
    pad = lambda x, n: f"lpad(CAST({x} AS VARCHAR), {n}, '0')"
    first, last = _pick(corpus.FIRST, "i"), _pick(corpus.LAST, "i // 7")
    m, d, d2 = "(i % 12 + 1)", "(i % 28 + 1)", "((i * 5) % 28 + 1)"
    parts = {
        "i": text("i"), "first": first, "last": last, "FIRST": f"upper({first})", "LAST": f"upper({last})", "first2": _pick(corpus.FIRST, "i + 3"), "last2": _pick(corpus.LAST, "i + 5"),
        "m": text(m), "d": text(d), "d2": text(d2), "mm": pad(m, 2), "dd": pad(d2, 2), "hh": pad("i % 24", 2), "mi": pad("i * 7 % 60", 2), "birth": text("1940 + i % 60"),
        "n7": pad("1000000 + i", 7), "n5": pad("10000 + i % 80000", 5), "n4": pad("1000 + i % 9000", 4), "n4b": pad("1000 + (i + 17) % 9000", 4), "n3": text("200 + i % 700"), "n2": text("10 + i % 80"),
        "b": text("1 + i % 250"), "house": text("100 + i % 900"), "street": _pick(corpus.STREETS, "i"),
    }
    values = {k: f"v_{k}" for k, _, _ in corpus.IDENTIFIERS}
    rounds = []
    for r in range(corpus.ROUNDS):
        rounds.append(_filled(corpus.BLOCK, {"r": f"'{r + 1}'", "p": _pick(corpus.PROTECTED, f"i + {r}"), "j": _pick(corpus.JOBS, f"i + {r}")}, "{}"))
        if r % 2 == 0:
            rounds.append(_filled(corpus.LAYOUTS[r // 2 % len(corpus.LAYOUTS)], values, "%%"))
    made = ", ".join(f"{_filled(p, parts, '{}')} AS v_{k}" for k, _, p in corpus.IDENTIFIERS)
    return f"SELECT i AS doc_id, {' || '.join(rounds)} AS text, * FROM (SELECT i, {made} FROM (SELECT s_suppkey AS i FROM supplier))"


_CASES = _cases_sql()


def _places_sql(rows: list[tuple[str, str, str]]) -> str:
    """Occurrences of values given as (key, category, expression)."""
    each = " UNION ALL ".join(f"SELECT doc_id, text, '{k}' AS key, '{c}' AS category, {v} AS value FROM cases" for k, c, v in rows)
    return f"""SELECT doc_id, category, key, value, CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + (k - 1) * length(value) AS BIGINT) AS start,
      CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + k * length(value) AS BIGINT) AS "end"
      FROM (SELECT *, unnest(generate_series(1, len(g) - 1)) AS k FROM (SELECT *, string_split(text, value) AS g FROM ({each})))"""


_TRUTH = _places_sql([(k, c, f"v_{k}") for k, c, _ in corpus.IDENTIFIERS])
_KEPT = _places_sql([(f"guard{n}", "CLINICAL NON-PHI", "'" + p.replace("'", "''") + "'") for n, p in enumerate(corpus.PROTECTED)])
_WITH = f"WITH RECURSIVE cases AS MATERIALIZED ({_CASES}), truth AS MATERIALIZED ({_TRUTH})"
_FOUND = merged_sql(spans_sql(_ALL, "cases"), _ALL, PRIORITY)
_OUTPUT = """SELECT doc_id, text, coalesce(s, text) AS output FROM cases LEFT JOIN (
    SELECT doc_id AS d, string_agg(piece, '' ORDER BY pos) AS s FROM (
      SELECT c.doc_id, f."start" AS pos, substr(c.text, CAST(lag(f."end", 1, 0) OVER w + 1 AS INTEGER), CAST(f."start" - lag(f."end", 1, 0) OVER w AS INTEGER)) || '[' || f.label || ']' AS piece
        FROM found f JOIN cases c ON c.doc_id = f.doc_id WINDOW w AS (PARTITION BY f.doc_id ORDER BY f."start")
      UNION ALL SELECT c.doc_id, 1e12, substr(c.text, CAST(max(f."end") + 1 AS INTEGER)) FROM found f JOIN cases c ON c.doc_id = f.doc_id GROUP BY c.doc_id, c.text) GROUP BY doc_id) ON d = doc_id"""
_GRADED = """SELECT t.doc_id, t.category, t.key, t.value, t.start, t."end", count(f.start) AS touched,
    arg_min(f.label, (f.start, f."end")) FILTER (f.start <= t.start AND f."end" >= t."end") AS label
  FROM truth t LEFT JOIN found f ON f.doc_id = t.doc_id AND f.start < t."end" AND t.start < f."end" GROUP BY ALL"""
_STATE = "CASE WHEN touched = 0 THEN 'missed' WHEN label IS NULL THEN 'partial' WHEN label <> category THEN 'mislabelled' ELSE 'exact' END"
_SCORED = f"{_WITH}, found AS MATERIALIZED ({_FOUND}), output AS MATERIALIZED ({_OUTPUT}), graded AS MATERIALIZED (SELECT *, {_STATE} AS state FROM ({_GRADED}))"


def cases(spark, sf_dir):
    return corpus.cases(spread(table(spark, sf_dir, "supplier").select("s_suppkey"), most=1000), "s_suppkey")


def found(spark, sf_dir):
    """``(doc_id, text, truth, protected, found, output)``: each case with its merged spans and its safe text, in the row."""
    merged = cases(spark, sf_dir).withColumn("found", spans.merged("text", _ALL))
    return merged.withColumn("output", spans.splice("text", "found"))


@query("corpus_cases", f"WITH cases AS ({_CASES}) SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, sha256(text) AS sha FROM cases")
def corpus_cases(spark, sf_dir):
    return cases(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha"))


@query("corpus_truth", f'{_WITH} SELECT doc_id, category, key, value, start, "end" FROM truth')
def corpus_truth(spark, sf_dir):
    return cases(spark, sf_dir).select("doc_id", F.inline("truth"))


def _graded(made):
    return made.select("doc_id", F.inline(evaluate.grade_row(F.col("truth"), F.col("found"))))


@query(
    "corpus_grade",
    f"""{_SCORED} SELECT category, count(*) AS truth, count(*) FILTER (label IS NOT NULL) AS detected, count(*) FILTER (state = 'exact') AS exact,
    round(count(*) FILTER (label IS NOT NULL) / count(*), 6) AS recall, round(count(*) FILTER (state = 'exact') / nullif(count(*) FILTER (label IS NOT NULL), 0), 6) AS accuracy FROM graded GROUP BY category""",
)
def corpus_grade(spark, sf_dir):
    return evaluate.metrics(_graded(settled(found(spark, sf_dir))))


_FAILED = f"""{_SCORED}, failed AS MATERIALIZED (
  SELECT doc_id, CASE state WHEN 'missed' THEN 'missed-phi-span' WHEN 'partial' THEN 'partial-phi-redaction' ELSE 'category-mismatch' END AS type, replace(category, ' ', '_') AS category, key AS annotation, start FROM graded WHERE state <> 'exact' AND doc_id % 10 <> 3
  UNION ALL SELECT k.doc_id, CASE WHEN count(f.start) > 0 THEN 'protected-span-redacted' ELSE 'protected-text-corrupted' END, 'CLINICAL_NON_PHI', 'guard', k.start
    FROM ({_KEPT}) k JOIN output o ON o.doc_id = k.doc_id LEFT JOIN found f ON f.doc_id = k.doc_id AND f.start < k."end" AND k.start < f."end" WHERE k.doc_id % 10 <> 3
    GROUP BY k.doc_id, k.start, k.value, o.output HAVING count(f.start) > 0 OR NOT contains(o.output, k.value)
  UNION ALL SELECT doc_id, 'missing-run-result', 'UNKNOWN', '', NULL FROM cases WHERE doc_id % 10 = 3)"""


@query(
    "failure_clusters",
    f"""{_FAILED} SELECT type, category, annotation, count(*) AS occurrences, count(DISTINCT doc_id) AS cases,
    string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id, start) FILTER (n <= 3) AS examples
    FROM (SELECT *, row_number() OVER (PARTITION BY type, category, annotation ORDER BY doc_id, start) AS n FROM failed) GROUP BY type, category, annotation""",
)
def failure_clusters(spark, sf_dir):
    made = settled(found(spark, sf_dir))  # read in several places
    runs = made.where(F.col("doc_id") % 10 != 3)  # every tenth case stands for a run that never came back
    missing = made.join(runs.select("doc_id"), "doc_id", "left_anti")
    bad = evaluate.protected_failures(runs.select("doc_id", F.inline("protected")), runs.select("doc_id", F.inline("found")), runs)
    return evaluate.failure_clusters(evaluate.failures(_graded(runs), bad, missing))


@query(
    "surviving_values",
    f"""{_SCORED} SELECT category, value, count(*) AS annotated, CAST(sum(CASE WHEN n = 1 THEN len(string_split(output, value)) - 1 ELSE 0 END) AS BIGINT) AS in_output, string_agg(DISTINCT CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS cases
    FROM (SELECT t.*, o.output, row_number() OVER (PARTITION BY t.doc_id, category, value ORDER BY t.start) AS n FROM truth t JOIN output o ON o.doc_id = t.doc_id WHERE contains(o.output, t.value)) GROUP BY category, value""",
)
def surviving_values(spark, sf_dir):
    left = F.filter("truth", lambda t: F.contains("output", t.value))
    each = found(spark, sf_dir).select("doc_id", "output", F.inline(left))
    per_case = each.groupBy("doc_id", "category", "value").agg(F.count(F.lit(1)).alias("annotated"), F.first("output").alias("output"))
    times = (F.size(F.split("output", F.concat(F.lit("\\Q"), F.col("value"), F.lit("\\E")), -1)) - 1).cast("long")
    return per_case.groupBy("category", "value").agg(
        F.sum("annotated").alias("annotated"), F.sum(times).alias("in_output"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.col("doc_id").cast("string")))).alias("cases"),
    )
