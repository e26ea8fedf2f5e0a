"""Queries over persons: names by context, parsed, in runs, by evidence, promoted; dictionaries and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clinical, people
from ..operators.vocabulary import looked_up
from ..sources.corpus import FIRST, LAST
from .base import query, spans_sql, spread, table, tailed_sql
from .guard_sql import NAMED_VOCABULARY, evidence_sql, named_vocabulary

_STORIES = [
    "Spoke with {n} about the plan. Ms. {m} is a 44 year old woman.", "Follow up with Dr. {m}, MD. Graves disease and Babinski sign.", "HPI: {n} presents with Chest Pain.",
    "{c} said that mother {m} called.", "Patient: {n} has Renal Failure. Harper's gait.", "Seen by Dr. Grant at Home. Unknown Person walked; Sodium 140 mmol/L.",
]
_LIST = lambda v: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in v) + "]"
_F = lambda by: f"{_LIST(FIRST)}[({by}) % {len(FIRST)} + 1]"
_G = lambda by: f"{_LIST(LAST)}[({by}) % {len(LAST)} + 1]"
_N, _M, _C = f"({_F('i')} || ' ' || {_G('i // 7')})", f"({_F('i + 2')} || ' ' || {_G('i // 7 + 3')})", f"({_G('i // 7')} || ', ' || {_F('i')})"
_CASES = " ".join(f"WHEN {k} THEN replace(replace(replace('{t.replace(chr(39), chr(39) * 2)}', '{{n}}', {_N}), '{{m}}', {_M}), '{{c}}', {_C})" for k, t in enumerate(_STORIES))
STORIES_SQL = f"SELECT i AS doc_id, CASE i % {len(_STORIES)} {_CASES} END AS text FROM (SELECT c_custkey AS i FROM customer)"


def stories(spark, sf_dir):
    i = F.col("c_custkey")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    j = F.floor(i / 7)
    n, m = F.concat_ws(" ", pick(FIRST, i), pick(LAST, j)), F.concat_ws(" ", pick(FIRST, i + 2), pick(LAST, j + 3))
    c = F.concat_ws(", ", pick(LAST, j), pick(FIRST, i))
    text = pick(_STORIES, i)
    for mark, value in (("{n}", n), ("{m}", m), ("{c}", c)):
        text = F.replace(text, F.lit(mark), value)
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select(i.alias("doc_id"), text.alias("text"))


CONTEXT_SQL = lambda source: tailed_sql(people.CONTEXT_RULES, source)


@query("contextual_names", f'SELECT doc_id, rule, label, start, "end", value FROM ({CONTEXT_SQL(f"({STORIES_SQL})")})')
def contextual_names(spark, sf_dir):
    return stories(spark, sf_dir).select("doc_id", F.inline(people.contextual("text"))).drop("severity")


_NAMED = f"""SELECT i AS id, CASE i % 5 WHEN 0 THEN 'Dr. ' || {_N} || ', MD' WHEN 1 THEN {_C} WHEN 2 THEN '  ' || {_F('i')} || ' Q. ' || {_G('i // 7')} || ' Jr.' WHEN 3 THEN 'Zoë Müller' ELSE {_G('i')} END AS name FROM (SELECT c_custkey AS i FROM customer)"""
_TURNED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^(?:Dr|Mr|Mrs|Ms|Miss|Prof)\.? ', ''), ',? +(?:MD|DO|RN|NP|PA|PhD|PharmD)\.?$', ''), ',? +(?:Jr|Sr|II|III|IV)\.?$', ''), '^([^,]+), *(.+)$', '\2 \1')"
_KEY = lambda x: f"regexp_replace(lower(strip_accents({x})), '[^a-z]', '', 'g')"


@query(
    "parsed_names",
    f"""SELECT id, title, first, middle, surname, initials, {_KEY('first')} AS first_key, {_KEY('surname')} AS surname_key FROM (
      SELECT id, rtrim(regexp_extract(x, '^((?:Dr|Mr|Mrs|Ms|Miss|Prof)\\.?) ', 1), '.') AS title, CASE WHEN len(w) > 1 THEN w[1] ELSE '' END AS first, CASE WHEN len(w) > 2 THEN array_to_string(w[2:len(w) - 1], ' ') ELSE '' END AS middle,
        coalesce(w[-1], '') AS surname, array_to_string(list_transform(w, lambda y: upper(strip_accents(y)[1])), '') AS initials
      FROM (SELECT *, list_filter(string_split({_TURNED}, ' '), lambda y: y <> '') AS w FROM (SELECT id, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS x FROM ({_NAMED}))))""",
)
def parsed_names(spark, sf_dir):
    i = F.col("c_custkey")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    first, last = pick(FIRST, i), pick(LAST, F.floor(i / 7))
    k = i % 5
    name = (
        F.when(k == 0, F.concat(F.lit("Dr. "), first, F.lit(" "), last, F.lit(", MD"))).when(k == 1, F.concat(last, F.lit(", "), first)).when(k == 2, F.concat(F.lit("  "), first, F.lit(" Q. "), last, F.lit(" Jr.")))
        .when(k == 3, "Zoë Müller").otherwise(pick(LAST, i))
    )
    return table(spark, sf_dir, "customer").select(i.alias("id"), people.parsed(name).alias("p")).select("id", "p.*")


def runs_sql(docs: str) -> str:
    """CTEs up to ``runs(doc_id, start, end, tokens, comma)``: capitalised words that blanks or one comma join."""
    return f"""w AS MATERIALIZED (SELECT s.doc_id, s.start, s."end", s.value, t.text, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.start) AS n FROM ({spans_sql([people.WORD], docs)}) s
  JOIN {docs} t ON t.doc_id = s.doc_id WHERE regexp_matches(value, '^[A-Z]')),
r AS (SELECT doc_id, n, 1 AS g, start, "end", [value] AS tokens, false AS comma FROM w WHERE n = 1
  UNION ALL SELECT doc_id, n, CASE WHEN j THEN g ELSE g + 1 END, CASE WHEN j THEN rs ELSE ws END, we, CASE WHEN j THEN list_append(tokens, value) ELSE [value] END, j AND (comma OR contains(gap, ','))
  FROM (SELECT *, ws - re <= 4 AND len(tokens) < {people.LONGEST} AND (regexp_matches(gap, '^(?:[ \\t]+|\\.[ \\t]+)$') OR (regexp_matches(gap, '^,[ \\t]+$') AND NOT comma)) AS j
    FROM (SELECT w.doc_id, w.n, r.g, r.start AS rs, r."end" AS re, w.start AS ws, w."end" AS we, r.tokens, r.comma, w.value, substr(w.text, CAST(r."end" + 1 AS INTEGER), CAST(w.start - r."end" AS INTEGER)) AS gap
      FROM r JOIN w ON w.doc_id = r.doc_id AND w.n = r.n + 1))),
runs AS MATERIALIZED (SELECT doc_id, min(start) AS start, max("end") AS "end", arg_max(tokens, n) AS tokens, bool_or(comma) AS comma FROM r GROUP BY doc_id, g)"""


_RUNS = f"WITH RECURSIVE stories AS MATERIALIZED ({STORIES_SQL}), {runs_sql('stories')}"


@query("name_runs", f"""{_RUNS} SELECT doc_id, start, "end", array_to_string(tokens, ' ') AS name, comma FROM runs""")
def name_runs(spark, sf_dir):
    found = stories(spark, sf_dir).select("doc_id", F.inline(F.expr(people.runs_expr("text"))))
    return found.select("doc_id", "start", "end", F.array_join("tokens", " ").alias("name"), "comma")


@query(
    "name_evidence",
    f"""{_RUNS}, vocab AS ({NAMED_VOCABULARY}), spans_ AS (SELECT doc_id, start, "end", 'NAME' AS label, 'dictionary' AS source, tokens, comma FROM runs), {evidence_sql("spans_", "stories", "vocab")}
    SELECT doc_id, start, array_to_string(tokens, ' ') AS name, CAST(known AS INTEGER) AS known, CAST(score AS INTEGER) AS score FROM scored""",
)
def name_evidence(spark, sf_dir):
    words = named_vocabulary(spark)
    found = looked_up(stories(spark, sf_dir), words, "found", lambda voc: people.evidence_expr("text", voc))
    return found.select("doc_id", F.inline_outer("found")).where("start is not null").select("doc_id", "start", "name", "known", "score")


@query(
    "promoted_names",
    f"""WITH s AS ({STORIES_SQL}), f AS (SELECT DISTINCT i AS doc_id, lower({_G('i // 7')}) AS s FROM (SELECT c_custkey AS i FROM customer)),
    l AS (SELECT i AS doc_id, CASE i % 3 WHEN 0 THEN 'Old ' || {_G('i // 7')} WHEN 1 THEN 'Old ' || {_G('i // 7')} || 'x' ELSE 'Some Body' END AS name FROM (SELECT c_custkey AS i FROM customer)),
    k AS (SELECT l.doc_id, name, {_KEY("string_split(name, ' ')[-1]")} AS k, s FROM l JOIN f ON f.doc_id = l.doc_id)
    SELECT doc_id, name, CASE WHEN bool_or(s = k) THEN 'alias' ELSE 'fuzzy' END AS reason FROM k GROUP BY doc_id, name HAVING bool_or(s = k) OR bool_or(length(s) >= 7 AND levenshtein(s, k) <= 1)""",
)
def promoted_names(spark, sf_dir):
    i = F.col("c_custkey")
    last = F.element_at(F.array(*[F.lit(v) for v in LAST]), (F.floor(i / 7) % len(LAST) + 1).cast("int"))
    c = table(spark, sf_dir, "customer")
    found = c.select(i.alias("doc_id"), F.concat(F.lit("New "), last).alias("name"))
    left = c.select(i.alias("doc_id"), F.when(i % 3 == 0, F.concat(F.lit("Old "), last)).when(i % 3 == 1, F.concat(F.lit("Old "), last, F.lit("x"))).otherwise("Some Body").alias("name"))
    return people.promoted(found, left)


_WORDS = "SELECT lower(unnest(regexp_split_to_array(text, '[^A-Za-z]+'))) AS token FROM documents"


@query(
    "name_dictionary",
    f"""WITH w AS ({_WORDS}), c AS (SELECT token, count(*) AS n FROM w WHERE regexp_matches(token, '^[a-z][a-z''-]+$') GROUP BY token HAVING count(*) >= 20)
    SELECT token, n, length(token) <= 3 OR list_contains({_LIST(clinical.CLINICAL_WORDS)}, token) OR list_contains({_LIST(clinical.EPONYMS)}, token) OR token IN (SELECT lower(unnest(string_split(p_name, ' '))) FROM part) AS ambiguous FROM c""",
)
def name_dictionary(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    common = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("token"), F.lit(1).alias("rank"))
    return people.dictionary(words, clinical.CLINICAL_WORDS, common, least=20)


_BANNED = ["old", "new"]
_VOCAB = " UNION ALL ".join(f"SELECT unnest(regexp_split_to_array(lower({c}), '[^a-z0-9]+')) AS token, {i} AS i FROM {t}" for i, (t, c) in enumerate((("part", "p_name"), ("part", "p_type"), ("customer", "c_mktsegment"))))


@query("clinical_vocabulary", f"SELECT token, count(DISTINCT i) AS sources FROM ({_VOCAB}) WHERE length(token) BETWEEN 2 AND 40 AND NOT list_contains({_LIST(_BANNED)}, token) AND NOT regexp_matches(token, '^[0-9]+$') GROUP BY token")
def clinical_vocabulary(spark, sf_dir):
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    return people.vocabulary_of([part.select(F.col("p_name").alias("name")), part.select(F.col("p_type").alias("name")), customer.select(F.col("c_mktsegment").alias("name"))], _BANNED)


@query("vocabulary_anchors", "SELECT DISTINCT token, regexp_matches(token, '(?:itis|osis|emia|oma|pathy|ectomy|ing|et)$') AS strong FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part) WHERE token NOT IN ('old', 'new')")
def vocabulary_anchors(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("token")).distinct()
    return people.anchors(words, _BANNED, "(?:itis|osis|emia|oma|pathy|ectomy|ing|et)$")
