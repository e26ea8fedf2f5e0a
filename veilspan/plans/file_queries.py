"""Queries over files, runs, templates, chunks, colours, previews and review."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import spans, text
from ..scratch import new_folder
from ..sources import files
from ..sources.corpus import FIRST, LAST
from .base import query, spans_sql, table
from .span_queries import BY_NAME

_LIST = lambda v: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in v) + "]"


@query("run_directory", "SELECT CAST(doc_id AS VARCHAR) AS id, sha256(text) AS sha256, CAST(length(text) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS bytes, doc_id % 7 = 3 AS missing, doc_id % 7 <> 3 AS intact FROM documents")
def run_directory(spark, sf_dir):
    path = new_folder(spark, "run")
    results = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    files.write_run(results, path)
    results.where(F.col("id").cast("long") % 7 != 3).write.mode("overwrite").json(f"{path}/cases")  # a run that lost some
    return files.read_run(spark, path, "id string, text string").drop("text")


@query("corpus_files", "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'array' ELSE 'object' END AS form, count(*) AS cases, count(*) FILTER (p_partkey % 5 = 0) AS bad FROM part GROUP BY 1")
def corpus_files(spark, sf_dir):
    path = new_folder(spark, "corpus")
    k = F.col("p_partkey")
    end = F.when(k % 5 == 0, F.lit("99")).otherwise(F.length("p_name").cast("string"))
    case = F.concat(F.lit('{"id":"'), k.cast("string"), F.lit('","text":"'), "p_name", F.lit('","annotations":[{"start":0,"end":'), end, F.lit("}]}"))
    for form, lead, tail in (("array", "[", "]"), ("object", '{"cases":[', "]}")):
        rows = table(spark, sf_dir, "part").where((k % 2 == 0) if form == "array" else (k % 2 == 1))
        parts = rows.groupBy(F.floor(k / 1000)).agg(F.concat(F.lit(lead), F.concat_ws(",", F.collect_list(case)), F.lit(tail)).alias("value"))
        parts.select("value").write.option("maxRecordsPerFile", 1).text(f"{path}/{form}")  # files of at most 1,000 cases
    out = None
    for form in ("array", "object"):
        read = files.read_corpus(spark, f"{path}/{form}")
        bad = files.problems(read, least_cases=1, least_chars=1).where("problem = 'span out of range'")
        each = read.select(F.lit(form).alias("form"), F.lit(1).alias("cases"), F.lit(0).alias("bad")).union(bad.select(F.lit(form), F.lit(0), F.lit(1)))
        out = each if out is None else out.union(each)
    return out.groupBy("form").agg(F.sum("cases").alias("cases"), F.sum("bad").alias("bad"))


@query("workup_library", "SELECT row_number() OVER (ORDER BY id) AS rank, id, title, items FROM (SELECT 'w' || n_nationkey AS id, n_name AS title, CAST(n_regionkey AS BIGINT) AS items FROM nation)")
def workup_library(spark, sf_dir):
    path = new_folder(spark, "workups")
    item = F.struct(F.lit("i").alias("id"), F.lit("history").alias("kind"), F.lit("s").alias("system"), F.lit("t").alias("text"), F.array(F.lit("no"), F.lit("yes")).alias("choices"))
    rows = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("w"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("title"), F.array().cast("array<string>").alias("aliases"), F.array_repeat(item, F.col("n_regionkey").cast("int")).alias("items")
    )
    rows.withColumn("file", F.col("id")).write.partitionBy("file").json(path)  # a file for each
    return files.build_library(spark, path)


@query("mirror_files", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")
def mirror_files(spark, sf_dir):
    path = new_folder(spark, "mirror")
    files.write_mirror(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name")), path)
    read = spark.read.schema("name string, id string").json(f"{path}/workups").select("id", "name")
    return read.join(spark.read.schema("id string, sha256 string").json(f"{path}/manifest"), "id", "left_semi")


@query("pretty_json", """SELECT r_regionkey, '{' || chr(10) || '  "r_regionkey" : ' || r_regionkey || ',' || chr(10) || '  "r_name" : "' || r_name || '"' || chr(10) || '}' AS json FROM region""")
def pretty_json(spark, sf_dir):
    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return files.pretty(rows).select(F.get_json_object("json", "$.r_regionkey").cast(rows.schema["r_regionkey"].dataType).alias("r_regionkey"), "json")


@query("vocabulary_export", "SELECT token, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part) GROUP BY token")
def vocabulary_export(spark, sf_dir):
    path = new_folder(spark, "vocabulary")
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    files.write_vocabulary(words, path)
    return spark.read.schema("token string, n long").parquet(path)


@query("failure_report", "SELECT l_returnflag AS type, l_linestatus AS category, '' AS annotation, count(*) AS occurrences FROM lineitem GROUP BY 1, 2")
def failure_report(spark, sf_dir):
    path = new_folder(spark, "report")
    counted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("category"), F.lit("").alias("annotation")).agg(F.count(F.lit(1)).alias("occurrences"))
    files.write_report(counted, path)
    return spark.read.schema("type string, category string, annotation string, occurrences long").json(path)


_F, _G = f"{_LIST(FIRST)}[i % {len(FIRST)} + 1]", f"{_LIST(LAST)}[i // {len(FIRST)} % {len(LAST)} + 1]"
_FILLED = f"{_LIST(files.TEMPLATES)}[i % {len(files.TEMPLATES)} + 1]"
for _k, _v in {
    "n": f"{_F} || ' ' || {_G}", "f": _F, "l": _G, "a": "CAST(20 + i % 70 AS VARCHAR)", "p": "'555-' || lpad(CAST(i % 10000 AS VARCHAR), 4, '0')", "m": "CAST(100000 + i AS VARCHAR)",
    "d": "(i % 12 + 1) || '/' || (i % 28 + 1) || '/2025'", "e": f"lower({_F}) || '@mail.example.org'",
}.items():
    _FILLED = f"replace({_FILLED}, '{{{_k}}}', {_v})"


@query("templated_notes", f"SELECT i AS doc_id, CASE WHEN i % 20 = 19 THEN 'adversarial' ELSE 'template' END AS kind, CASE WHEN i % 20 = 19 THEN {_LIST(files.ADVERSARIAL)}[i // 20 % {len(files.ADVERSARIAL)} + 1] ELSE {_FILLED} END AS text FROM (SELECT o_orderkey AS i FROM orders)")
def templated_notes(spark, sf_dir):
    return files.templated(table(spark, sf_dir, "orders"), FIRST, LAST, "o_orderkey")


@query(
    "model_chunks",
    """WITH RECURSIVE c AS (SELECT doc_id, text, CAST(0 AS BIGINT) AS pos FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT doc_id, text, CASE WHEN cut - 80 <= pos THEN cut ELSE cut - 80 END FROM (SELECT *, CASE WHEN pos + 700 < length(text) AND back > 0 AND pos + length(w) - back > pos + 385 THEN pos + length(w) - back + 1 ELSE least(pos + 700, length(text)) END AS cut
        FROM (SELECT *, substr(text, pos + 1, 701) AS w, instr(reverse(substr(text, pos + 1, 701)), chr(10)) AS back FROM c)) WHERE cut < length(text))
    SELECT doc_id, pos AS "offset" FROM c""",
)
def model_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(text.model_chunks("text"))).select("doc_id", "offset")


@query(
    "chunk_halves",
    """SELECT doc_id, coalesce(CASE WHEN r IS NULL OR m - l <= r - m THEN l END, r, m - 1) + 1 AS "at" FROM (
      SELECT *, CASE WHEN lf > 80 AND lf < n - 80 AND substr(text, lf + 1, 1) = ' ' THEN lf END AS l, CASE WHEN rt > 80 AND rt < n - 80 AND substr(text, rt + 1, 1) = ' ' THEN rt END AS r FROM (
        SELECT *, m - instr(reverse(substr(text, 1, m + 1)), ' ') + 1 AS lf, m + instr(substr(text, m + 1), ' ') - 1 AS rt FROM (SELECT doc_id, text, length(text) AS n, length(text) // 2 AS m FROM documents WHERE length(text) > 400)))""",
)
def chunk_halves(spark, sf_dir):
    h = text.halves(F.col("text"))
    halved = table(spark, sf_dir, "documents").where(F.length("text") > 400).select("doc_id", "text", h.alias("h"))
    return halved.where(F.concat(F.get("h", F.lit(0)), F.get("h", F.lit(1))) == F.col("text")).select("doc_id", F.length(F.get("h", F.lit(0))).cast("long").alias("at"))


@query("token_colours", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '#cc3333' WHEN 1 THEN '#33cc33' ELSE '#3333cc' END AS hex FROM part")
def token_colours(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.hsl_hex((F.col("p_size") % 3 * 120).cast("double")).alias("hex"))


@query("template_segments", "SELECT p_partkey, unnest([false, true, false, true]) AS token, unnest(['Hi ', 'name', ', see ', p_type]) AS text FROM part")
def template_segments(spark, sf_dir):
    given = F.concat(F.lit("Hi {{name}}, see {{"), "p_type", F.lit("}}"))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(text.segments(given)))


@query("restored_originals", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CASE event_id % 3 WHEN 0 THEN 'a ' || event_type || ' b [X] c' ELSE 'a [X] b ' || event_type || ' c' END ELSE 'a [X] b [X] c' END AS text FROM events")
def restored_originals(spark, sf_dir):
    n = (F.col("event_id") % 3 + 1).cast("int")
    return table(spark, sf_dir, "events").select("event_id", text.restored(F.lit("a [X] b [X] c"), F.lit("[X]"), n, F.col("event_type")).alias("text"))


_MAIL = spans_sql([BY_NAME["email"]], "documents")


@query(
    "review_rows",
    f"""SELECT doc_id, start, value AS original, '[EMAIL]' AS replacement, CAST(start + coalesce(sum(7 - length(value)) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS output_start FROM ({_MAIL})""",
)
def review_rows(spark, sf_dir):
    found = text.rendered("text", "found")
    return table(spark, sf_dir, "documents").withColumn("found", spans.merged("text", [BY_NAME["email"]])).select("doc_id", F.inline(found)).select("doc_id", "start", "original", "replacement", "output_start")


@query("model_errors", "SELECT event_id, event_id % 4 < 2 AS again FROM events")
def model_errors(spark, sf_dir):
    k = F.col("event_id") % 4
    said = F.when(k == 0, "Input sequence is too long for the model").when(k == 1, "index out of bounds").when(k == 2, "network down")
    return table(spark, sf_dir, "events").select("event_id", text.too_long(said).alias("again"))


@query("unique_warnings", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, lower(event_type), event_type")
def unique_warnings(spark, sf_dir):
    first = F.row_number().over(Window.partitionBy("user_id", F.lower("event_type")).orderBy("event_id"))
    return table(spark, sf_dir, "events").withColumn("n", first).where("n = 1").select("user_id", "event_type", "event_id")
