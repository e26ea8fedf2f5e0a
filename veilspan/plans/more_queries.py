"""Queries over names, models, modes, sealed records, streams and SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql
from ..functions.rules import DIRECT_RULES, FIELD_RULES, PRIORITY, Rule
from ..operators import model, names, spans
from ..sources import vault
from ..sources.notes import FIRST, LAST
from ..scratch import new_folder
from ..streaming import events
from .base import merged_sql, noted, query, spans_sql, table
from .span_queries import _LIST, NOTES_SQL

_ALL = FIELD_RULES + DIRECT_RULES
_NOTE_SPANS = spans_sql(_ALL, f"({NOTES_SQL})")
_NOTE_MERGED = merged_sql(_NOTE_SPANS, _ALL, PRIORITY)


@query("deid_summary", f"SELECT label, count(*) AS spans, count(DISTINCT doc_id) AS docs FROM ({_NOTE_MERGED}) GROUP BY 1")
def deid_summary(spark, sf_dir):
    merged = spans.merge_found(noted(spark, sf_dir), _ALL)
    return merged.groupBy("label").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("doc_id").alias("docs"))


@query(
    "deid_text_length",
    f"""SELECT n.doc_id, CAST(length(n.text) + coalesce(sum(length(m.label) + 2 - (m."end" - m.start)), 0) AS BIGINT) AS chars FROM ({NOTES_SQL}) n LEFT JOIN ({_NOTE_MERGED}) m ON m.doc_id = n.doc_id GROUP BY n.doc_id, n.text""",
)
def deid_text_length(spark, sf_dir):
    corpus = noted(spark, sf_dir)
    safe = spans.redact(corpus, _ALL)
    return safe.select("doc_id", F.length("text").cast("long").alias("chars"))


_TOKENS = f"SELECT doc_id, ts[i] AS token, ts[i + 1] AS second, lower(ts[i - 1]) AS before, i - 1 AS n FROM (SELECT doc_id, ts, unnest(generate_series(1, len(ts))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*') AS ts FROM ({NOTES_SQL})))"
_RECALL = f"""
SELECT doc_id, n, token || ' ' || second AS name, score FROM (SELECT *, CASE WHEN g THEN 2 ELSE 0 END + CASE WHEN s THEN 2 ELSE 0 END + CASE WHEN g AND s THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(token, '^[A-Z][a-z]') AND regexp_matches(second, '^[A-Z][a-z]') THEN 1 ELSE 0 END + CASE WHEN coalesce(before, '') IN ({', '.join(repr(x) for x in (*names.HONORIFICS, *names.FIELDS))}) THEN 4 ELSE 0 END AS score
  FROM (SELECT *, list_contains({_LIST(FIRST)}, token) AS g, list_contains({_LIST(LAST)}, second) AS s FROM ({_TOKENS}) WHERE regexp_matches(token, '^[A-Z]') AND regexp_matches(second, '^[A-Z]'))) WHERE score >= {names.THRESHOLD}
"""


def _recalled(spark, sf_dir):
    corpus = noted(spark, sf_dir)
    words = lambda v: spark.createDataFrame([(x,) for x in v], "token string")
    return corpus, names.recall(corpus, words(FIRST), words(LAST))


@query("name_recall", f"SELECT doc_id, CAST(n AS BIGINT) AS n, name, CAST(score AS BIGINT) AS score FROM ({_RECALL})")
def name_recall(spark, sf_dir):
    return _recalled(spark, sf_dir)[1].select("doc_id", F.col("n").cast("long").alias("n"), "name", F.col("score").cast("long").alias("score"))


@query(
    "alias_repeats",
    f"""WITH r AS ({_RECALL}), a AS (SELECT DISTINCT doc_id, unnest([name, string_split(name, ' ')[2]]) AS alias FROM r)
    SELECT a.doc_id, alias, CAST(len(regexp_extract_all(text, '\\b' || alias || '\\b')) AS BIGINT) AS times FROM a JOIN ({NOTES_SQL}) n ON n.doc_id = a.doc_id""",
)
def alias_repeats(spark, sf_dir):
    corpus, found = _recalled(spark, sf_dir)
    return names.repeats(corpus, names.aliases(found))


_SEEN = f"(SELECT doc_id, text || chr(10) || 'Seen with ' || 'Robin ' || string_split(name, ' ')[2] || ' and Kim Other.' AS text, name FROM ({NOTES_SQL}))"
_SEED = f"(SELECT doc_id, name FROM ({_RECALL}) WHERE n < 5)"


@query(
    "alias_fixpoint",
    f"""SELECT doc_id, name FROM {_SEED} UNION SELECT s.doc_id, pair FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[A-Z][a-z]+ [A-Z][a-z]+\\b')) AS pair FROM {_SEEN}) s
    JOIN {_SEED} d ON d.doc_id = s.doc_id AND string_split(d.name, ' ')[2] = string_split(pair, ' ')[2]""",
)
def alias_fixpoint(spark, sf_dir):
    corpus, found = _recalled(spark, sf_dir)
    surname = F.element_at(F.split(F.col("truth")[0]["key"], " "), -1)
    seen = corpus.withColumn("text", F.concat("text", F.lit("\nSeen with Robin "), surname, F.lit(" and Kim Other.")))
    return names.fixpoint(seen, found.where("n < 5"), names.same_surname)


def _capital_pairs():
    import re

    pair = re.compile(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b")
    return lambda texts: [[(m.start(), m.end(), "NAME", 0.9) for m in pair.finditer(t)] for t in texts]


@query("model_hook", spans_sql([Rule("m", "NAME", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b")], f"({NOTES_SQL})").replace("rule, label, severity, start, CAST", "label, start, CAST", 1).replace(', value FROM (SELECT doc_id, rule', ' FROM (SELECT doc_id, rule', 1))
def model_hook(spark, sf_dir):
    found = model.predict(noted(spark, sf_dir).select("doc_id", "text"), _capital_pairs)
    return found.select("doc_id", "label", "start", "end")


_MODEL_SPANS = spans_sql([Rule("m", "NAME", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b")], f"({NOTES_SQL})")


_BOTH = f"""SELECT doc_id, start, "end", label, rule, 'structured' AS source FROM ({_NOTE_SPANS}) UNION ALL SELECT doc_id, start, "end", label, rule, 'model' FROM ({_MODEL_SPANS})"""


@query("deid_modes", f"""WITH s AS (SELECT count(*) AS n FROM ({_NOTE_SPANS})), m AS (SELECT count(*) AS n FROM ({_MODEL_SPANS})), h AS (SELECT count(*) AS n FROM ({merged_sql(_BOTH, [*_ALL, Rule("m", "NAME", "")], PRIORITY, "source")}))
    SELECT 'structured' AS mode, n AS spans FROM s UNION ALL SELECT 'model', n FROM m UNION ALL SELECT 'hybrid', n FROM h""")
def deid_modes(spark, sf_dir):
    corpus = noted(spark, sf_dir).select("doc_id", "text")
    own, theirs = spans.detect(corpus, _ALL), model.predict(corpus, _capital_pairs)
    counted = lambda mode: model.combine(own, theirs, mode).agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("spans"))
    return counted("structured").union(counted("model")).union(counted("hybrid"))


@query("sealed_records", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def sealed_records(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    key = vault.derive_key("a phrase", b"0123456789abcdef")
    return vault.decrypt(vault.encrypt(rows, key), key, rows.schema)


@query("stream_tumbling", "SELECT * FROM (SELECT event_type, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_tumbling(spark, sf_dir):
    read = events.read(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)
    stamped = read.withColumn("ts", F.col("ts").cast("timestamp"))
    counted = events.tumbling(stamped, "ts", "1 day", "1 hour", "event_type")
    at = new_folder(spark, "stream")
    out = events.run_available(counted.select("event_type", F.col("w.start").alias("start"), "n"), f"{at}/out", f"{at}/state")  # windows that the watermark has closed
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_once", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def stream_once(spark, sf_dir):
    read = events.read(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    doubled = read.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    at = new_folder(spark, "stream")
    kept = events.run_available(events.once(doubled, "event_id", "ts", "1 day").select("user_id", "event_id"), f"{at}/out", f"{at}/state")
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sql_functions",
    "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CAST(len(string_split(p_name, 'e')) - 1 AS INTEGER) AS n FROM part",
)
def sql_functions(spark, sf_dir):
    sql.register(spark)
    return table(spark, sf_dir, "part").select("p_partkey", F.expr("deid_slug(p_name)").alias("slug"), F.expr("deid_occurrences(p_name, 'e')").alias("n"))
