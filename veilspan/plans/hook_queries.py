"""Queries over growing sections, model hooks, foreign outputs, rules and vocabularies in files, and orders by locale."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as rule_tables
from ..functions import sql
from ..functions.rules import DIRECT_RULES, FIELD_RULES, Rule
from ..operators import model, spans, text
from ..scratch import new_folder
from ..sources import vocabularies
from ..streaming import sections
from .base import noted, query, spans_sql, table
from .span_queries import NOTES_SQL

_EMAIL = next(r for r in DIRECT_RULES if r.name == "email")
_GROWN = """SELECT conv_id, turn, string_agg(CASE WHEN turn % 4 = 3 AND t2 < turn THEN '' ELSE 'u' || conv_id || 'x' || t2 || '@mail.example.org said ' || n || ' things. ' END, ' ' ORDER BY t2) AS t
  FROM (SELECT a.conv_id, a.turn, b.turn AS t2, length(b.text) AS n FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn <= a.turn) GROUP BY conv_id, turn"""
_MAIL = _EMAIL.pattern.replace("'", "''")


@query(
    "stream_sections",
    f"""SELECT conv_id, turn, CASE WHEN t = b THEN 'unchanged' WHEN b <> '' AND starts_with(t, b) THEN 'append' ELSE 'full' END AS mode, sha256(regexp_replace(t, '{_MAIL}', '[EMAIL]', 'g')) AS sha
    FROM (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM ({_GROWN}))""",
)
def stream_sections(spark, sf_dir):
    """Versions of growing sections as a stream in two runs, of which the second goes on from the state of the first."""
    turns = table(spark, sf_dir, "conversations")
    a, b = turns.select("conv_id", "turn"), turns.select("conv_id", F.col("turn").alias("t2"), F.length("text").alias("n"))
    line = F.concat(F.lit("u"), F.col("conv_id").cast("string"), F.lit("x"), F.col("t2").cast("string"), F.lit("@mail.example.org said "), F.col("n").cast("string"), F.lit(" things. "))
    said = F.when((F.col("turn") % 4 == 3) & (F.col("t2") < F.col("turn")), "").otherwise(line)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("t2", said.alias("s")))), lambda x: x.s)
    grown = a.join(b, "conv_id").where("t2 <= turn").groupBy("conv_id", "turn").agg(F.array_join(parts, " ").alias("t"))
    at = new_folder(spark, "sections")
    for part in (grown.where("turn < 2"), grown.where("turn >= 2")):
        part.write.mode("append").parquet(f"{at}/in")
        stream = sections.incremental(spark.readStream.schema(grown.schema).parquet(f"{at}/in"), "conv_id", "turn", "t", [_EMAIL])
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").select("conv_id", "turn", "mode", F.sha2("t", 256).alias("sha"))


_WORD = Rule("word", "WORD", r"\b[A-Z][a-z]+\b")


def _broken():
    raise OSError("no such model")


def _short_inputs():
    import re

    word = re.compile(_WORD.pattern)

    def run(texts):
        if any(len(t) > 300 for t in texts):
            raise ValueError("input sequence is too long")
        return [[(m.start(), m.end(), "WORD", 0.9) for m in word.finditer(t)] for t in texts]

    return run


@query("model_retries", f"SELECT doc_id, count(*) AS spans, CAST(sum(start * 7 + \"end\") AS BIGINT) AS places FROM ({spans_sql([_WORD], '(SELECT doc_id, left(text, 5000) AS text FROM documents)')}) GROUP BY doc_id".replace("left(text, 5000) AS text", "regexp_replace(text, '[^A-Za-z ]', ' ', 'g') AS text"))
def model_retries(spark, sf_dir):
    """A model that fails on more than 300 characters, after one that does not load, still yields all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z ]", " ").alias("text"))
    found = model.predict(docs, [_broken, _short_inputs])
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("start") * 7 + F.col("end")).alias("places"))


_SHIFT = "CAST(start + coalesce(sum(8 - length(value)) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"


@query("aligned_rows", f"SELECT doc_id, start, value AS original, '<hidden>' AS replacement, {_SHIFT} AS output_start FROM ({spans_sql([_EMAIL], f'({NOTES_SQL})')}) UNION ALL SELECT doc_id, start, value, '<hidden>', {_SHIFT} FROM ({spans_sql([_EMAIL], 'documents')})")
def aligned_rows(spark, sf_dir):
    """What an output that the engine did not make has in place of each span."""
    docs = noted(spark, sf_dir).select("doc_id", "text").unionByName(table(spark, sf_dir, "documents").select("doc_id", "text"))
    made = docs.withColumns({"output": F.regexp_replace("text", _EMAIL.pattern, "<hidden>"), "found": spans.merged("text", [_EMAIL])})
    rows = made.select("doc_id", F.inline_outer(text.aligned("text", "found", "output"))).where("start is not null")
    return rows.select("doc_id", "start", "original", "replacement", "output_start")


@query("rule_table", spans_sql(FIELD_RULES + DIRECT_RULES, f"({NOTES_SQL})"))
def rule_table(spark, sf_dir):
    """Rules written as JSON lines, read back, and applied."""
    at = new_folder(spark, "rules")
    rule_tables.as_table(spark, FIELD_RULES + DIRECT_RULES).withColumn("ord", F.monotonically_increasing_id()).write.json(at)
    return spans.detect(noted(spark, sf_dir), rule_tables.read_rules(spark, at))


@query("span_function", spans_sql([_EMAIL, FIELD_RULES[0]], f"({NOTES_SQL})"))
def span_function(spark, sf_dir):
    """Spans by a table function in a lateral join."""
    sql.register_spans(spark, [_EMAIL, FIELD_RULES[0]])
    return spark.sql("SELECT d.doc_id, s.* FROM {d} d, LATERAL deid_spans(d.text) s", d=noted(spark, sf_dir))


_LINES = "SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN c_custkey || ',too,many,values' WHEN c_custkey % 10 = 7 THEN 'x' || c_custkey || ',' || c_mktsegment ELSE c_custkey || ',' || c_mktsegment END AS line FROM customer"


@query("csv_vocabulary", f"SELECT c_custkey % 10 IN (3, 7) AS bad, count(*) AS n, min(CASE WHEN c_custkey % 10 IN (3, 7) THEN line ELSE split_part(line, ',', 2) END) AS least FROM ({_LINES}) GROUP BY 1")
def csv_vocabulary(spark, sf_dir):
    """A gzipped CSV file with bad lines: they are reported, good ones kept."""
    k = F.col("c_custkey")
    line = F.when(k % 10 == 3, F.concat(k.cast("string"), F.lit(",too,many,values"))).when(k % 10 == 7, F.concat(F.lit("x"), k.cast("string"), F.lit(","), "c_mktsegment")).otherwise(F.concat(k.cast("string"), F.lit(","), "c_mktsegment"))
    at = new_folder(spark, "csv")
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(at, compression="gzip")
    good, bad = vocabularies.read_csv(spark, at, "id long, name string", header=False)
    count = lambda df, flag, c: df.agg(F.lit(flag).alias("bad"), F.count(F.lit(1)).alias("n"), F.min(c).alias("least"))
    return count(good, False, "name").union(count(bad, True, "line"))


@query("xml_terms", "SELECT DISTINCT term, 'clinical' AS kind FROM (SELECT unnest(list_concat([p_name], list_filter(string_split(p_name, ' '), lambda w: length(w) >= 4))) AS term FROM part WHERE p_size >= 10)")
def xml_terms(spark, sf_dir):
    """Names in gzipped XML elements, filtered and split into terms."""
    at = new_folder(spark, "xml")
    row = F.concat(F.lit("<record><name>"), "p_name", F.lit("</name><size>"), F.col("p_size").cast("string"), F.lit("</size><other>x</other></record>"))
    whole = F.concat(F.lit("<records>"), F.array_join(F.collect_list(row), "\n"), F.lit("</records>"))
    parts = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 1000)).agg(whole.alias("value"))  # documents of at most 1,000 records, a file each
    parts.select("value").write.option("maxRecordsPerFile", 1).text(at, compression="gzip")
    good, _ = vocabularies.read_xml(spark, at, "record", "name string, size int")
    return vocabularies.terms_of(good.where("size >= 10"), "clinical", least=4)


@query(
    "title_order",
    """SELECT n_nationkey, CAST(row_number() OVER (ORDER BY title COLLATE NOCASE.NOACCENT, n_nationkey) AS INTEGER) AS place, count(*) OVER (PARTITION BY lower(strip_accents(title))) AS same
    FROM (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN upper(n_name) WHEN 1 THEN lower(n_name) WHEN 2 THEN replace(lower(n_name), 'a', 'á') ELSE n_name END AS title FROM nation)""",
)
def title_order(spark, sf_dir):
    """Titles in the order of a locale, case and accents aside, and how many are equal then."""
    k, n = F.col("n_nationkey"), F.col("n_name")
    title = F.when(k % 4 == 0, F.upper(n)).when(k % 4 == 1, F.lower(n)).when(k % 4 == 2, F.replace(F.lower(n), F.lit("a"), F.lit("á"))).otherwise(n)
    return text.title_order(table(spark, sf_dir, "nation").select("n_nationkey", title.alias("title")), "title", "n_nationkey")
