"""Files of workups, corpora, runs, reports and vocabularies.

Everything is read and written by Spark, a row or a file at a time; nothing passes through the driver.
Text that is no JSON gives a row with the file's path in ``bad`` and null fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .documents import read_workups

_CASE = "struct<id:string,text:string,annotations:array<struct<start:bigint,end:bigint,category:string,key:string,text:string>>>"


def build_library(spark: SparkSession, path: str) -> DataFrame:
    """``(rank, id, title, items)``: the workups of a folder's files, ranked by id, and how many items each has."""
    read = read_workups(spark, path).where("id is not null")
    order = Window.orderBy("id")  # a library is what one person maintains
    return read.select(F.row_number().over(order).cast("long").alias("rank"), "id", "title", F.size("items").cast("long").alias("items"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(id, text, annotations, bad)`` of corpus files: a JSON array of cases, or an object with ``cases``.

    Each file is parsed in one row; :func:`read_cases` reads corpora of any size, a line for each case.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.trim("value").alias("value"))
    given = F.when(F.col("value").startswith("{"), F.get_json_object("value", "$.cases")).otherwise(F.col("value"))
    cases = raw.select("path", F.from_json(given, f"array<{_CASE}>").alias("cases"))
    whole = F.col("cases").isNotNull() & (F.size("cases") > 0)
    each = cases.select(F.when(~whole, F.col("path")).alias("bad"), F.explode_outer("cases").alias("c"))
    return each.select("c.id", "c.text", "c.annotations", "bad")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """``(id, text, annotations, bad)`` of JSON lines, a case each; ``bad`` has a line that is none."""
    schema = "id string, text string, annotations array<struct<start:bigint,end:bigint,category:string,key:string,text:string>>, bad string"
    return spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="bad")


def problems(cases: DataFrame, least_cases: int = 100, least_chars: int = 10_000) -> DataFrame:
    """``(id, problem)``: what is wrong with a corpus ``(id, text, annotations)``; an empty table if it is fit.

    Repeated ids, spans out of range, span texts that disagree with the case's, texts that are too
    short; and, with a null id, too few cases.
    """
    repeated = cases.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("problem"))
    short = cases.where(F.length("text") < least_chars).select("id", F.lit("too short").alias("problem"))
    spans = cases.select("id", "text", F.explode("annotations").alias("a"))
    fits = (F.col("a.start") >= 0) & (F.col("a.end") > F.col("a.start")) & (F.col("a.end") <= F.length("text"))
    said = F.substr("text", (F.col("a.start") + 1).cast("int"), (F.col("a.end") - F.col("a.start")).cast("int"))
    problem = F.when(~fits, "span out of range").when(F.col("a.text").isNotNull() & (said != F.col("a.text")), "span text disagrees")
    bad = spans.select("id", problem.alias("problem")).where("problem is not null")
    few = cases.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least_cases).select(F.lit(None).cast("string").alias("id"), F.lit("too few cases").alias("problem"))
    return repeated.union(short).union(bad).union(few)


def write_run(results: DataFrame, path: str, text: str = "text") -> None:
    """A run: the results by case under ``cases``, and a manifest of each case with its hash and sizes."""
    results.write.mode("overwrite").json(f"{path}/cases")
    each = results.select("id", F.sha2(text, 256).alias("sha256"), F.length(text).cast("long").alias("chars"), F.octet_length(text).cast("long").alias("bytes"))
    each.write.mode("overwrite").json(f"{path}/manifest")


def read_run(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The manifest's cases with their results; ``missing`` says that a case has no result, ``intact`` that its hash agrees."""
    manifest = spark.read.schema("id string, sha256 string, chars long, bytes long").json(f"{path}/manifest")
    results = spark.read.schema(schema).json(f"{path}/cases")
    joined = manifest.join(results.withColumn("_here", F.lit(True)), "id", "left")
    return joined.withColumn("missing", F.col("_here").isNull()).withColumn("intact", F.coalesce(F.sha2("text", 256) == F.col("sha256"), F.lit(False))).drop("_here")


def write_mirror(workups: DataFrame, path: str) -> None:
    """A file for each workup id, and a manifest of ids and hashes."""
    workups.write.mode("overwrite").partitionBy("id").json(f"{path}/workups")
    workups.select("id", F.sha2(F.to_json(F.struct("*")), 256).alias("sha256")).write.mode("overwrite").json(f"{path}/manifest")


def pretty(df: DataFrame) -> DataFrame:
    """``(json)``: rows as indented JSON."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("json"))


def write_report(clusters: DataFrame, path: str) -> None:
    """A failure report: clusters by how often they occur, the most frequent first, as JSON."""
    clusters.orderBy(F.desc("occurrences"), "type", "category", "annotation").write.mode("overwrite").json(path)


def write_vocabulary(words: DataFrame, path: str) -> None:
    """A vocabulary sorted by word, as Parquet."""
    words.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(path)


TEMPLATES = [
    "{n}, {a} yo, came with cough. Phone {p}.", "Call {n} at {p} about the result.", "MRN: {m}. {n} sleeps well.", "{n} was seen on {d}.", "Mail {n} at {e}.",
    "Patient: {n}\nDOB: {d}\nMRN: {m}", "Room 12B, {n}, fall risk.", "Dr. {l} signed on {d}.", "Spoke with {n} for ten minutes.", "{l}, {f} needs a ride home.",
    "Address: {m} Mill Court. {n} lives alone.", "Employer: {l} Works. No leave yet.", "{n} denies pain; 3/10 before.", "Fax {p} to {n}.", "Emergency contact: {n} ({p})",
]
#: Texts that must come out as they went in.
ADVERSARIAL = ["May 5 of 12 patients improve", "Graves disease, Babinski sign", "pain 3/10, strength 5/5", "Will follow; Rose spots absent", "BP 120/80 and 2/6 murmur"]


def templated(ids: DataFrame, first: list[str], last: list[str], column: str = "id") -> DataFrame:
    """``(doc_id, kind, text)``: a filled template for each number; every twentieth is an adversarial text."""
    i = F.col(column)
    pick = lambda v, by: F.element_at(F.array(*[F.lit(x) for x in v]), (by % len(v) + 1).cast("int"))
    s = lambda c: c.cast("long").cast("string")
    f, el = pick(first, i), pick(last, F.floor(i / len(first)))
    values = {"n": F.concat_ws(" ", f, el), "f": f, "l": el, "a": s(20 + i % 70), "p": F.concat(F.lit("555-"), F.lpad(s(i % 10000), 4, "0")), "m": s(100000 + i), "d": F.concat(s(i % 12 + 1), F.lit("/"), s(i % 28 + 1), F.lit("/2025")), "e": F.concat(F.lower(f), F.lit("@mail.example.org"))}
    text = pick(TEMPLATES, i)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    odd = i % 20 == 19
    return ids.select(i.alias("doc_id"), F.when(odd, "adversarial").otherwise("template").alias("kind"), F.when(odd, pick(ADVERSARIAL, F.floor(i / 20))).otherwise(text).alias("text"))
