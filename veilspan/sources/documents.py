"""Readers and writers of record files: workups, libraries, text files, manifests, graded runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "struct<id:string,kind:string,system:string,text:string,choices:array<string>,select:string>"
WORKUP = f"id string, title string, aliases array<string>, items array<{ITEM}>"
LIBRARY = f"id string, title string, version string, description string, workups array<struct<id:string,title:string,aliases:array<string>,items:array<{ITEM}>>>"


def read_workups(spark: SparkSession, path: str) -> DataFrame:
    """Workups of a folder, a file each; rows that do not parse keep their text in _corrupt_record."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    parsed = F.from_json("value", f"{WORKUP}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return whole.select("file", parsed.alias("w")).select("w.*", "file")


def parse_workups(rows: DataFrame, text: str) -> DataFrame:
    """Workups of a column of JSON texts."""
    return rows.select(F.from_json(text, WORKUP, {"mode": "PERMISSIVE"}).alias("w")).select("w.*")


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """The workups of library files, with the library's id."""
    return spark.read.schema(LIBRARY).option("multiLine", True).json(path).select(F.col("id").alias("library"), F.inline("workups"))


def repeated_ids(workups: DataFrame) -> DataFrame:
    return workups.groupBy("id").count().where("count > 1").select("id")


def checklist(workups: DataFrame) -> DataFrame:
    """A row for each item, its id led by its workup's."""
    each = workups.select(F.col("id").alias("workup"), "title", F.posexplode("items").alias("ord", "item"))
    return each.select(F.concat_ws(":", "workup", "item.id").alias("id"), "workup", "title", "ord", "item.kind", "item.system", "item.text", "item.choices")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_run(results: DataFrame, path: str, text: str = "text") -> None:
    """Results as JSON with the text's hash, characters and bytes beside them."""
    results.withColumns({"sha256": F.sha2(text, 256), "chars": F.length(text), "bytes": F.octet_length(text)}).write.mode("overwrite").json(path)
