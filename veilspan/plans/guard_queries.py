"""Queries over guards, names, contexts, case scores and reconciled defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import DIRECT_RULES, FIELD_RULES, PRIORITY
from ..operators import guards, lines, records, spans
from ..sources.notes import FIRST, LAST
from .base import noted, query, spans_sql, table
from .span_queries import _GRADE_SQL, _LIST, _REDACTED, LONG_DIGITS, NOTES_SQL, _SAFE_RULES, _graded, _lines_sql, _truth

def _k():
    return F.col("c_custkey")


_PHRASES = ["May", "3rd of June", "10:45", "aged 45", "3-5", "12.5", "2024-03-05", "4/5/2024", "March 3"]
_LEADS = ["seen on ", "range ", "", "dose "]


def _pick(values, by):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def _sql_pick(values, by):
    return f"{_LIST(values)}[CAST({by} AS BIGINT) % {len(values)} + 1]"


@query(
    "guard_dates",
    f"""SELECT c_custkey, span, regexp_matches(span, '{guards.NO_DAY}') OR (regexp_matches(span, '{guards.RANGE}') AND NOT regexp_matches(lead, '{guards.DATE_CONTEXT}')) AS dropped
    FROM (SELECT c_custkey, {_sql_pick(_PHRASES, 'c_custkey')} AS span, {_sql_pick(_LEADS, 'c_custkey // 9')} AS lead FROM customer)""",
)
def guard_dates(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", _pick(_PHRASES, _k()).alias("span"), _pick(_LEADS, F.floor(_k() / 9)).alias("lead"))
    return rows.select("c_custkey", "span", guards.date_false_positive(F.col("span"), F.col("lead")).alias("dropped"))


_STATEMENTS = ["pain for 3 days", "cough for several weeks of winter", "admitted in May", "for the past 2 hours", "metoprolol 25 mg BID", "5 units IV", "Dr. ", "patient: ", "about the "]


@query(
    "guard_statements",
    f"""SELECT c_custkey, regexp_matches(s, '{guards.DURATION}') AS duration, regexp_matches(s, '{guards.DOSAGE}') AS dosage, regexp_matches(s, '{guards.NAME_CONTEXT}') AS name_context
    FROM (SELECT c_custkey, {_sql_pick(_STATEMENTS, 'c_custkey')} AS s FROM customer)""",
)
def guard_statements(spark, sf_dir):
    s = _pick(_STATEMENTS, _k())
    return table(spark, sf_dir, "customer").select(
        "c_custkey", s.rlike(guards.DURATION).alias("duration"), s.rlike(guards.DOSAGE).alias("dosage"), s.rlike(guards.NAME_CONTEXT).alias("name_context")
    )


_KNOWN = ["EMAIL", "IP", "PHONE", "MRN"]


@query(
    "placeholder_scan",
    f"""SELECT doc_id, label, label IN ('EMAIL', 'IP', 'PHONE', 'MRN') AS known, count(*) AS times FROM (
      SELECT doc_id, unnest(regexp_extract_all({_REDACTED}, '{guards.PLACEHOLDER}', 1)) AS label FROM documents) GROUP BY ALL""",
)
def placeholder_scan(spark, sf_dir):
    return guards.placeholders(spans.redact(table(spark, sf_dir, "documents"), _SAFE_RULES), _KNOWN).select("doc_id", "label", "known", "times")


_TITLES, _ENDS = ["Dr. ", "", "Ms ", "Prof. "], [", MD", "", " Jr.", " III"]


def _names(spark, sf_dir):
    full = F.concat(_pick(_TITLES, _k()), _pick(FIRST, _k()), F.lit(" Q. "), _pick(LAST, F.floor(_k() / 7)), _pick(_ENDS, F.floor(_k() / 3)))
    return table(spark, sf_dir, "customer").select(_k().alias("doc_id"), full.alias("name"))


_NAMES_SQL = f"""SELECT c_custkey AS doc_id, trim({_sql_pick(_TITLES, 'c_custkey')}, '. ') AS title, {_sql_pick(FIRST, 'c_custkey')} AS first, 'Q.' AS middle,
  {_sql_pick(LAST, 'c_custkey // 7')} AS surname FROM customer"""


@query("name_parts", f"SELECT doc_id, title, first, middle, surname, lower(surname) AS key FROM ({_NAMES_SQL})")
def name_parts(spark, sf_dir):
    return _names(spark, sf_dir).select("doc_id", guards.name_parts(F.col("name")).alias("p")).select("doc_id", "p.*")


@query(
    "alias_variants",
    f"""SELECT doc_id, alias, bool_or(strong) AS strong FROM (
      SELECT doc_id, first || ' ' || surname AS alias, true AS strong FROM ({_NAMES_SQL}) UNION ALL
      SELECT doc_id, title || ' ' || surname, true FROM ({_NAMES_SQL}) WHERE title <> '' UNION ALL
      SELECT doc_id, first, false FROM ({_NAMES_SQL}) UNION ALL
      SELECT doc_id, surname, contains(surname, '-') OR length(surname) >= 9 FROM ({_NAMES_SQL})) GROUP BY ALL""",
)
def alias_variants(spark, sf_dir):
    return guards.alias_variants(name_parts(spark, sf_dir)).select("doc_id", "alias", "strong")


@query(
    "token_neighbours",
    f"""SELECT doc_id, i - 1 AS n, ts[i] AS token, array_to_string(ts[greatest(i - 4, 1):i - 1], ' ') AS before, coalesce(ts[i + 1], '') AS next
    FROM (SELECT doc_id, ts, unnest(generate_series(1, len(ts))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ts FROM ({NOTES_SQL})))""",
)
def token_neighbours(spark, sf_dir):
    tokens = noted(spark, sf_dir).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("n", "token"))
    return guards.neighbours(tokens).withColumn("n", F.col("n").cast("long"))


_EMAIL = next(r for r in DIRECT_RULES if r.name == "email")


@query(
    "line_context",
    f"""SELECT s.doc_id, s.start, l.line, substr(l.line, 1, CAST(s.start - (l."end" - length(l.line)) AS INTEGER)) AS before FROM ({spans_sql([_EMAIL], f'({NOTES_SQL})')}) s
    JOIN ({_lines_sql(f'({NOTES_SQL})')}) l ON l.doc_id = s.doc_id AND s.start >= l."end" - length(l.line) AND s.start < l."end" """,
)
def line_context(spark, sf_dir):
    corpus = noted(spark, sf_dir)
    each = lines.split_lines(corpus).select("doc_id", "start", (F.col("end") + 1).alias("end"), "line")
    met = spans.overlaps(spans.detect(corpus, [_EMAIL]).select("doc_id", "start", "end"), each).where("start_b <= start_a and start_a < end_b - 1")
    return met.select("doc_id", F.col("start_a").alias("start"), F.col("line_b").alias("line"), F.substr("line_b", F.lit(1), (F.col("start_a") - F.col("start_b")).cast("int")).alias("before"))


@query(
    "case_scores",
    f"""SELECT doc_id, count(*) FILTER (state = 'missed') AS leaks, count(*) FILTER (state = 'partial') AS partial, count(*) FILTER (state = 'mislabelled') AS mislabelled,
    count(*) FILTER (state <> 'exact') = 0 AS clean FROM ({_GRADE_SQL}) GROUP BY doc_id""",
)
def case_scores(spark, sf_dir):
    n = lambda state: F.count_if(F.col("state") == state)
    return _graded(spark, sf_dir).groupBy("doc_id").agg(
        n("missed").alias("leaks"), n("partial").alias("partial"), n("mislabelled").alias("mislabelled"), (F.count_if(F.col("state") != "exact") == 0).alias("clean")
    )


@query("missing_runs", f"SELECT doc_id, count(*) AS truth FROM (SELECT doc_id, unnest([1, 2, 3, 4, 5, 6]) FROM ({NOTES_SQL})) WHERE doc_id % 10 = 3 GROUP BY doc_id")
def missing_runs(spark, sf_dir):
    truth = _truth(spark, sf_dir)[1]
    results = table(spark, sf_dir, "customer").where(_k() % 10 != 3).select(_k().alias("doc_id"))
    return truth.join(results, "doc_id", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("truth"))


@query(
    "return_merge",
    "SELECT l_orderkey, l_linenumber, coalesce(max(CASE WHEN l_linenumber % 2 = 0 AND l_orderkey % 3 <> 0 THEN 'returned ' || l_returnflag END) OVER (PARTITION BY l_orderkey, l_linenumber), l_returnflag) AS answer FROM lineitem",
)
def return_merge(spark, sf_dir):
    mine = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("answer"))
    theirs = mine.where("l_linenumber % 2 = 0 and l_orderkey % 3 <> 0").select("l_orderkey", "l_linenumber", F.concat(F.lit("returned "), "answer").alias("back"))
    theirs = theirs.groupBy("l_orderkey", "l_linenumber").agg(F.max("back").alias("back"))  # one answer comes back for each item
    return mine.join(theirs, ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", F.coalesce("back", "answer").alias("answer"))


@query(
    "default_reconciliation",
    """WITH d AS (SELECT lower(n_name) AS token, 'default ' || n_name AS text FROM nation), s AS (
      SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'own-' || s_suppkey % 4 WHEN s_suppkey % 3 = 1 THEN 'old-' || s_suppkey % 4 ELSE lower(n_name) END AS token, s_name AS text, s_suppkey AS ord
      FROM supplier JOIN nation ON n_nationkey = s_nationkey), f AS (SELECT token, arg_min(text, ord) AS own FROM s GROUP BY token)
    SELECT d.token, coalesce(own, text) AS text, true AS is_default FROM d LEFT JOIN f ON f.token = d.token
    UNION ALL SELECT token, own, false FROM f WHERE token NOT IN (SELECT token FROM d) AND NOT regexp_matches(token, '^old-')""",
)
def default_reconciliation(spark, sf_dir):
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    defaults = nation.select(F.lower("n_name").alias("token"), F.concat(F.lit("default "), "n_name").alias("text"))
    k = F.col("s_suppkey")
    token = F.when(k % 3 == 0, F.concat(F.lit("own-"), k % 4)).when(k % 3 == 1, F.concat(F.lit("old-"), k % 4)).otherwise(F.lower("n_name"))
    stored = supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(token.alias("token"), F.col("s_name").alias("text"), k.alias("ord"))
    return guards.reconcile(defaults, stored, "^old-")


@query(
    "synthetic_corpus",
    f"SELECT i AS id, 'Case ' || i || ': ' || repeat('line ' || i % 7 || ' of the note. ', CAST(400 + i % 50 AS BIGINT)) || {_sql_pick(FIRST, 'i')} AS text FROM range(100) t(i)",
)
def synthetic_corpus(spark, sf_dir):
    i = F.col("id")
    filler = F.repeat(F.concat(F.lit("line "), (i % 7).cast("string"), F.lit(" of the note. ")), (400 + i % 50).cast("int"))
    return spark.range(100).select("id", F.concat(F.lit("Case "), i.cast("string"), F.lit(": "), filler, _pick(FIRST, i)).alias("text"))


@query(
    "widest_match",
    f"""SELECT doc_id, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "end" - start DESC, start) AS n FROM ({spans_sql([LONG_DIGITS], 'documents')})) WHERE n = 1""",
)
def widest_match(spark, sf_dir):
    found = spans.detect(table(spark, sf_dir, "documents"), [LONG_DIGITS])
    best = found.groupBy("doc_id").agg(F.max(F.struct((F.col("end") - F.col("start")).alias("w"), (-F.col("start")).alias("s"))).alias("m"))
    return best.select("doc_id", (-F.col("m.s")).alias("start"), (F.col("m.w") - F.col("m.s")).alias("end"))


@query(
    "latest_day",
    "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
)
def latest_day(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return records.latest(rows, "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query(
    "caret_token",
    "SELECT p_partkey, regexp_extract(substr('see {{' || p_name || '}} and {{' || p_brand, 1, CAST(p_partkey % 30 + 5 AS INTEGER)), '\\{\\{([A-Za-z0-9# _-]*)$', 1) AS token FROM part",
)
def caret_token(spark, sf_dir):
    typed = F.concat(F.lit("see {{"), "p_name", F.lit("}} and {{"), "p_brand")
    upto = F.substr(typed, F.lit(1), (F.col("p_partkey") % 30 + 5).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract(upto, r"\{\{([A-Za-z0-9# _-]*)$", 1).alias("token"))


@query("label_priority", f"SELECT DISTINCT label, CAST(coalesce(list_position({_LIST(PRIORITY)}, label), {len(PRIORITY) + 1}) AS INTEGER) AS rank FROM (SELECT upper(p_type) AS label FROM part UNION ALL SELECT label FROM ({spans_sql(FIELD_RULES, f'({NOTES_SQL})')}))")
def label_priority(spark, sf_dir):
    found = spans.detect(noted(spark, sf_dir), FIELD_RULES).select("label")
    labels = table(spark, sf_dir, "part").select(F.upper("p_type").alias("label")).union(found).distinct()
    return labels.select("label", spans.priority(F.col("label")).cast("int").alias("rank"))
