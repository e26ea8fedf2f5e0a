"""Queries over the whole way from a text to a safe one, with every step of it in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import DIRECT_RULES, FIELD_RULES, PRIORITY
from ..operators import chain, evaluate, people
from ..scratch import settled
from ..sources.corpus import FIRST, LAST
from .base import merged_sql, query, spans_sql, spread, table, tailed_sql
from .corpus_queries import _CASES, _KEPT, _TRUTH, cases
from .date_queries import placed_sql
from .guard_sql import KEPT, NAMED_VOCABULARY, TRIMMED, evidence_sql, judged_sql, named_vocabulary, text
from .people_queries import runs_sql

_REF = "2026-06-15"
RULES = FIELD_RULES + DIRECT_RULES
#: Notes in which something has to be found, or left: {n} a name, {t} it turned, {l} its surname, {c} it in capitals, {i} a number.
NOTES = [
    "Seen 3/4/2026, born DOB 1/2/19{i}0. Spoke with {n} about it.",
    "Patient Name: {n} MRN: 123456{i}\n{l} slept well; {c} in Room {i}B. Graves disease and a Foley catheter.",
    "Patient: {n}, MD. Slept well today. IP 999.1.1.{i} and 10.1.2.{i}.",
    "PATIENT: {t}\nMr. {l} rests. Robin {l} visited, mother Denise too.\nAdmission date: 2026-06-0{i}\nPain 3/10, BP 128/76 mmHg",
    "Called {n} to confirm. Read by Dr. Okafor, MD. Emergency contact: {n} (sister).",
    "CT Head W/O Con: no acute finding. CBC: WBC 8.{i}, Hgb 10.2. Babinski sign absent, {n} said.",
    "Follow up with Dr. {l} on May 3. {n} is a 4{i} year old woman. Write to a.b{i}@mail.example.org or (202) 555-014{i}.",
]
_PICK = lambda v, by: f"[{', '.join(map(text, v))}][CAST({by} % {len(v)} + 1 AS BIGINT)]"


def _notes_sql() -> str:
    first, last = _PICK(FIRST, "i"), _PICK(LAST, "(i // 7)")
    lit = lambda x: text(x).replace("\n", "' || chr(10) || '")
    body = "CASE i % " + str(len(NOTES)) + " " + " ".join(f"WHEN {k} THEN {lit(t)}" for k, t in enumerate(NOTES)) + " END"
    for mark, value in (("{n}", f"{first} || ' ' || {last}"), ("{t}", f"upper({last}) || ', ' || upper({first})"), ("{l}", last), ("{c}", f"upper({first} || ' ' || {last})"), ("{i}", "CAST(i % 10 AS VARCHAR)")):
        body = f"replace({body}, '{mark}', {value})"
    return f"SELECT i AS doc_id, {body} AS text FROM (SELECT c_custkey AS i FROM customer)"


def notes(spark, sf_dir):
    i = F.col("c_custkey")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    first, last = pick(FIRST, i), pick(LAST, F.floor(i / 7))
    body = pick(NOTES, i)
    full = F.concat_ws(" ", first, last)
    for mark, value in (("{n}", full), ("{t}", F.upper(F.concat_ws(", ", last, first))), ("{l}", last), ("{c}", F.upper(full)), ("{i}", (i % 10).cast("string"))):
        body = F.replace(body, F.lit(mark), value)
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select(i.alias("doc_id"), body.alias("text"))


_LABELS = lambda v: ", ".join(map(text, v))


def _pass_sql(k: int, docs: str) -> str:
    """CTEs of one pass: the names that the last one left, their forms and repeats, all spans merged, and those that stay."""
    before, out = f"kept{k - 1}", ""
    seeds = 'SELECT doc_id, label, start, "end", source FROM seeds'
    if k > 1:
        bare = f"regexp_replace(trim(regexp_replace(value, '\\s+', ' ', 'g')), {text(chain.TITLES)}, '')"
        words = f"list_filter(string_split(regexp_replace({bare}, {text(chain.TURNED)}, '\\2 \\1'), ' '), lambda w: regexp_matches(w, {text(chain.PART)}))"
        word = "(SELECT DISTINCT lower(trim(term)) AS w FROM vocab WHERE kind IN ('clinical', 'eponym', 'common', 'medication'))"
        full = "CASE WHEN len(nw) > 1 THEN [nw[1] || ' ' || nw[-1], nw[-1] || ' ' || nw[1], nw[-1] || ', ' || nw[1]] ELSE [] END"
        own = f"CASE WHEN length(nw[-1]) >= {chain.SHORTEST} AND lower(nw[-1]) NOT IN (SELECT w FROM {word}) THEN [nw[-1]] ELSE [] END"
        out += f"""names{k} AS MATERIALIZED (SELECT n.doc_id, n.label, {words} AS nw FROM (SELECT f.doc_id, f.label, substr(d.text, CAST(f.start + 1 AS INTEGER), CAST(f."end" - f.start AS INTEGER)) AS value
            FROM {before} f JOIN {docs} d ON d.doc_id = f.doc_id WHERE f.label IN ({_LABELS(chain.clinical.NAME_LABELS)})) n),
          forms{k} AS MATERIALIZED (SELECT DISTINCT doc_id, label, form FROM (SELECT doc_id, label, unnest(list_concat(e, list_transform(e, lambda x: upper(x)))) AS form FROM (
            SELECT doc_id, label, list_concat({full}, {own}) AS e FROM names{k} WHERE len(nw) > 0))),
          repeats{k} AS (SELECT doc_id, label, CAST(off AS BIGINT) AS start, CAST(off + length(form) AS BIGINT) AS "end", 'alias' AS source FROM (
            SELECT *, list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length(form) AS off FROM (
              SELECT f.doc_id, f.label, f.form, g, unnest(generate_series(1, len(g) - 1)) AS i FROM (SELECT f.*, string_split(d.text, f.form) AS g FROM forms{k} f JOIN {docs} d ON d.doc_id = f.doc_id) f)
            WHERE (CASE WHEN g[i] = '' THEN i = 1 ELSE NOT regexp_matches(right(g[i], 1), '{chain.WORDY}') END) AND (CASE WHEN g[i + 1] = '' THEN i + 1 = len(g) ELSE NOT regexp_matches(left(g[i + 1], 1), '{chain.WORDY}') END))),
          lasts{k} AS (SELECT DISTINCT doc_id, string_split(form, ' ')[-1] AS l FROM forms{k} WHERE contains(form, ' ')),
          promoted{k} AS (SELECT DISTINCT p.doc_id, 'NAME' AS label, p.start, p."end", 'alias' AS source FROM pairs p JOIN lasts{k} l ON l.doc_id = p.doc_id AND (l.l = string_split(p.value, ' ')[-1] OR (length(l.l) >= 7 AND levenshtein(l.l, string_split(p.value, ' ')[-1]) <= 1))),
        """
        seeds = " UNION ALL ".join([seeds, *(f'SELECT doc_id, label, start, "end", source FROM {t}{k}' for t in ("repeats", "promoted"))])
    rank = f"coalesce(list_position([{', '.join(map(text, PRIORITY))}], label), {len(PRIORITY) + 1}), label, source"
    merged = merged_sql(f"SELECT *, '' AS rule FROM ({seeds})", [], PRIORITY, "source", order=rank)
    return out + f"""merged{k} AS MATERIALIZED ({merged}),
      kept{k} AS MATERIALIZED (SELECT doc_id, "start" AS start, "end", becomes AS label, source FROM ({judged_sql(f'merged{k}', docs, 'vocab')}) WHERE becomes IS NOT NULL)"""


def chain_sql(source: str) -> str:
    """CTEs ``docs``, ``placed`` (dates), ``final`` (spans with placeholders) and ``safe(doc_id, text)``."""
    date = "SELECT doc_id, CASE WHEN context = 'birth' THEN 'DOB' ELSE 'DATE' END AS label, \"start\" AS start, \"end\" FROM placed"
    trimmed = f"SELECT doc_id, label, CAST(start + CASE WHEN label IN ({_LABELS(chain.TRIMMED)}) THEN lead ELSE 0 END AS BIGINT) AS start, CAST(CASE WHEN label IN ({_LABELS(chain.TRIMMED)}) THEN start + lead + length({KEPT}) ELSE \"end\" END AS BIGINT) AS \"end\" FROM ({TRIMMED} ({spans_sql(RULES, 'docs')}))"
    context = f'SELECT doc_id, label, start, "end" FROM ({tailed_sql(people.CONTEXT_RULES, "docs")})'
    place = 'SELECT f.*, CASE WHEN f.label IN (\'DATE\', \'DOB\') THEN coalesce(p.label, f.label) ELSE f.label END AS placeholder FROM kept{k} f LEFT JOIN placed p ON p.doc_id = f.doc_id AND p."start" = f.start AND p."end" = f."end"'
    renamed = f"regexp_replace(coalesce(s, text), {text(chain.dates.FIELD)}, '\\1Timeline\\2', 'g')"
    return f"""WITH RECURSIVE docs AS MATERIALIZED ({source}), vocab AS MATERIALIZED ({NAMED_VOCABULARY}), placed AS MATERIALIZED ({placed_sql('SELECT doc_id, text FROM docs')}),
    {runs_sql('docs')}, runs_ AS (SELECT doc_id, start, "end", 'NAME' AS label, 'dictionary' AS source, tokens, comma FROM runs), {evidence_sql('runs_', 'docs', 'vocab')},
    pairs AS MATERIALIZED ({spans_sql([chain.PAIR], 'docs')}),
    seeds AS MATERIALIZED (SELECT *, 'structured' AS source FROM ({trimmed} UNION ALL {context} UNION ALL {date} UNION ALL SELECT doc_id, 'NAME', start, "end" FROM scored WHERE known > 0 AND score >= {people.LEAST}) WHERE "end" > start),
    {', '.join(_pass_sql(k, 'docs') for k in range(1, chain.PASSES + 1))},
    final AS MATERIALIZED ({place.format(k=chain.PASSES)}),
    safe AS MATERIALIZED (SELECT doc_id, {renamed} AS text FROM docs LEFT JOIN (SELECT doc_id AS d, string_agg(piece, '' ORDER BY pos) AS s FROM (
      SELECT c.doc_id, f.start AS pos, substr(c.text, CAST(lag(f."end", 1, 0) OVER w + 1 AS INTEGER), CAST(f.start - lag(f."end", 1, 0) OVER w AS INTEGER)) || '[' || f.placeholder || ']' AS piece
        FROM final f JOIN docs c ON c.doc_id = f.doc_id WINDOW w AS (PARTITION BY f.doc_id ORDER BY f.start)
      UNION ALL SELECT c.doc_id, 1e12, substr(c.text, CAST(max(f."end") + 1 AS INTEGER)) FROM final f JOIN docs c ON c.doc_id = f.doc_id GROUP BY c.doc_id, c.text) GROUP BY doc_id) ON d = doc_id)"""


_CHAIN = chain_sql(_notes_sql())


def deidentified(spark, sf_dir):
    return chain.deidentify(notes(spark, sf_dir), named_vocabulary(spark), reference=F.lit(_REF).cast("date"))


@query("safe_notes", f"{_CHAIN} SELECT doc_id, text FROM safe")
def safe_notes(spark, sf_dir):
    return deidentified(spark, sf_dir).select("doc_id", "text")


@query("safe_spans", f'{_CHAIN} SELECT doc_id, start, "end", label, source, placeholder FROM final')
def safe_spans(spark, sf_dir):
    return deidentified(spark, sf_dir).select("doc_id", F.inline_outer("spans")).where("start is not null")


# ---- the measuring corpus, run and graded ------------------------------------------------------

_RUN = f"{chain_sql(_CASES)}, cases AS MATERIALIZED (SELECT * FROM docs), truth AS MATERIALIZED ({_TRUTH})"
_GRADED = """SELECT t.doc_id, t.category, count(f.start) AS touched, arg_min(f.label, (f.start, f."end")) FILTER (f.start <= t.start AND f."end" >= t."end") AS label
  FROM truth t LEFT JOIN final f ON f.doc_id = t.doc_id AND f.start < t."end" AND t.start < f."end" GROUP BY t.doc_id, t.category, t.key, t.value, t.start, t."end\""""


def run(spark, sf_dir, *columns):
    """Columns of ``(doc_id, text, truth, protected, found, output)``: each case of the corpus with its spans and its safe text, written."""
    made = cases(spark, sf_dir).withColumn("output", F.col("text"))
    return settled(chain.deidentify(made, named_vocabulary(spark), text="output", reference=F.lit(_REF).cast("date")).withColumnRenamed("spans", "found").select(*columns))


@query(
    "run_grade",
    f"""{_RUN}, graded AS (SELECT *, CASE WHEN touched = 0 THEN 'missed' WHEN label IS NULL THEN 'partial' WHEN label <> category THEN 'mislabelled' ELSE 'exact' END AS state FROM ({_GRADED}))
    SELECT category, count(*) AS truth, count(*) FILTER (label IS NOT NULL) AS detected, count(*) FILTER (state = 'exact') AS exact, round(count(*) FILTER (label IS NOT NULL) / count(*), 6) AS recall,
      round(count(*) FILTER (state = 'exact') / nullif(count(*) FILTER (label IS NOT NULL), 0), 6) AS accuracy FROM graded GROUP BY category""",
)
def run_grade(spark, sf_dir):
    return evaluate.metrics(run(spark, sf_dir, "truth", "found").select(F.inline(evaluate.grade_row(F.col("truth"), F.col("found")))))


@query(
    "run_results",
    f"""{_RUN} SELECT s.doc_id, sha256(s.text) AS sha, CAST(length(s.text) AS BIGINT) AS chars, coalesce(n, 0) AS redactions, coalesce(g, 0) AS protected_hit
    FROM safe s LEFT JOIN (SELECT doc_id, count(*) AS n FROM final GROUP BY doc_id) f ON f.doc_id = s.doc_id
    LEFT JOIN (SELECT k.doc_id, count(DISTINCT k.start) AS g FROM ({_KEPT}) k JOIN final f ON f.doc_id = k.doc_id AND f.start < k."end" AND k.start < f."end" GROUP BY k.doc_id) p ON p.doc_id = s.doc_id""",
)
def run_results(spark, sf_dir):
    touched = F.filter("protected", lambda p: F.exists("found", lambda f: (f.start < p.end) & (p.start < f.end)))
    return run(spark, sf_dir, "doc_id", "protected", "found", "output").select("doc_id", F.sha2("output", 256).alias("sha"), F.length("output").cast("long").alias("chars"), F.size("found").cast("long").alias("redactions"), F.size(touched).cast("long").alias("protected_hit"))
