"""The text operators as SQL functions of a session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from .rules import Rule

DEFINITIONS = {
    "deid_slug": ("s STRING", "STRING", "regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '-'), '^-+|-+$', '')"),
    "deid_email": ("s STRING", "STRING", "regexp_replace(s, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', '[EMAIL]')"),
    "deid_occurrences": ("s STRING, needle STRING", "INT", "(length(s) - length(replace(s, needle, ''))) div length(needle)"),
    "hospital_day": ("d DATE, anchor DATE", "INT", "datediff(d, anchor) + 1"),
}


def register_spans(spark: SparkSession, rules: Sequence[Rule], name: str = "deid_spans") -> None:
    """A table function of the spans that rules find, for a lateral join: ``FROM docs, LATERAL deid_spans(docs.text)``."""
    from ..operators.spans import find_expr

    columns = "rule STRING, label STRING, severity STRING, start BIGINT, end BIGINT, value STRING"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(body STRING) RETURNS TABLE({columns}) RETURN SELECT s.* FROM (SELECT explode({find_expr('body', rules)}) AS s)")


def register(spark: SparkSession) -> None:
    for name, (args, kind, body) in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
