"""Vocabularies in files: typed CSV and XML, plain or gzipped, with the lines that do not fit set apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import settled

BAD = "_bad"


def _split(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    rows = settled(rows)  # parsed once for both
    bad = rows.where(F.col(BAD).isNotNull()).select(F.col(BAD).alias("line"))
    return rows.where(F.col(BAD).isNull()).select(*columns), bad


def _names(spark: SparkSession, schema: str) -> list[str]:
    return spark.createDataFrame([], schema).columns


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of CSV files by a schema, and ``(line)`` of those that have too few or too many values, or values of another type."""
    rows = spark.read.schema(f"{schema}, {BAD} string").csv(path, header=header, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, enforceSchema=True)
    return _split(rows, _names(spark, schema))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Elements named ``row_tag`` of XML files by a schema, and ``(line)`` of those that do not fit it."""
    rows = spark.read.format("xml").schema(f"{schema}, {BAD} string").options(rowTag=row_tag, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD).load(path)
    return _split(rows, _names(spark, schema))


def terms_of(names: DataFrame, kind: str, least: int = 3, name: str = "name") -> DataFrame:
    """``(term, kind)`` of names: whole, and each of their words that is long enough, in lower case and once."""
    whole = F.lower(F.trim(F.col(name)))
    words = F.filter(F.split(whole, "[^a-z0-9]+"), lambda w: F.length(w) >= least)
    return names.select(F.explode(F.array_distinct(F.concat(F.array(whole), words))).alias("term")).where("term <> ''").distinct().withColumn("kind", F.lit(kind))
