"""Registration of queries with the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.rules import Rule
from ..sources.notes import notes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, most: int = 20_000) -> DataFrame:
    """A small table over all cores, at most about ``most`` rows in a task. A file of one row group is read by one task; past one split's bytes there are tasks enough."""
    spark = df.sparkSession
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(spark.sparkContext.defaultParallelism, df.count() // most)) if size <= int(limit.rstrip("bB")) else df


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of all customers, made by all cores."""
    return notes(spread(table(spark, sf_dir, "customer").select("c_custkey")))


def _ungrouped(pattern: str) -> str:
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)


def spans_sql(rules: Sequence[Rule], source: str, key: str = "doc_id", text: str = "text") -> str:
    """SQL for :func:`veilspan.operators.spans.detect` over ``source``."""
    parts = []
    for r in rules:
        p, whole = r.pattern.replace("'", "''"), _ungrouped(r.pattern).replace("'", "''")
        lead = f"regexp_extract_all({text}, '{p}', 1)" if r.field else "NULL"
        value = f"regexp_extract_all({text}, '{p}', 2)" if r.field else "NULL"
        parts.append(
            f"SELECT {key}, '{r.name}' AS rule, '{r.label}' AS label, '{r.severity}' AS severity, m, g, l, v, unnest(generate_series(1, len(m))) AS i FROM ("
            f"SELECT {key}, regexp_extract_all({text}, '{whole}') AS m, string_split_regex({text}, '{whole}') AS g, {lead} AS l, {value} AS v FROM {source})"
        )
    each = " UNION ALL ".join(parts)
    start = (
        "CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)"
        " + coalesce(length(l[i]), 0) AS BIGINT)"
    )
    return (
        f"SELECT {key}, rule, label, severity, start, CAST(start + length(value) AS BIGINT) AS \"end\", value FROM ("
        f"SELECT {key}, rule, label, severity, {start} AS start, coalesce(v[i], m[i]) AS value FROM ({each}))"
    )


def tailed_sql(rules: Sequence[Rule], source: str, key: str = "doc_id", text: str = "text") -> str:
    """:func:`spans_sql` for field rules that have a third group."""
    parts = []
    for r in rules:
        p, whole = r.pattern.replace("'", "''"), _ungrouped(r.pattern).replace("'", "''")
        groups = ", ".join(f"regexp_extract_all({text}, '{p}', {i}) AS g{i}" for i in (1, 2, 3))
        parts.append(
            f"SELECT {key}, '{r.name}' AS rule, '{r.label}' AS label, '{r.severity}' AS severity, *, unnest(generate_series(1, len(m))) AS i FROM ("
            f"SELECT {key}, regexp_extract_all({text}, '{whole}') AS m, string_split_regex({text}, '{whole}') AS g, {groups} FROM {source})"
        )
    upto = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) + length(g1[i])"
    return (
        f'SELECT {key}, rule, label, severity, start, CAST(start + length(value) AS BIGINT) AS "end", value FROM ('
        f"SELECT {key}, rule, label, severity, CAST({upto} AS BIGINT) AS start, g2[i] AS value FROM ({' UNION ALL '.join(parts)}))"
    )


def merged_sql(found: str, rules: Sequence[Rule], priority: Sequence[str], source: str = "'structured'", key: str = "doc_id", order: str = "") -> str:
    """SQL for :func:`veilspan.operators.spans.merged` over spans ``found``: a recursion from span to span."""
    names = ", ".join(f"'{r.name}'" for r in rules)
    rank = lambda label: f"coalesce(list_position([{', '.join(repr(x) for x in priority)}], {label}), 99)"
    over = '(l."start" < o."end" AND o."start" < l."end")'
    firm = lambda e: f"regexp_matches({e}.source, 'structured|alias|residual')"
    model = lambda e: f"contains({e}.source, 'model')"
    joined = lambda a, b: f"CASE WHEN contains({a}.source, {b}.source) THEN {a}.source ELSE {a}.source || '+' || {b}.source END"
    state = f"""CASE WHEN NOT {over} THEN 'apart' WHEN {firm('l')} AND o.source = 'model' THEN 'drop' WHEN l.source = 'model' AND {firm('o')} THEN 'swap'
      WHEN o."end" <= l."end" AND o."start" >= l."start" AND NOT {model('l')} AND NOT {model('o')} THEN CASE WHEN {firm('o')} AND NOT {firm('l')} THEN 'inner' ELSE 'outer' END ELSE 'union' END"""
    pick = lambda new, inner, outer, union: f"CASE c WHEN 'apart' THEN {new} WHEN 'swap' THEN {new} WHEN 'inner' THEN {inner} WHEN 'union' THEN {union} ELSE {outer} END"
    return f"""
    WITH RECURSIVE o AS (SELECT {key}, "start", "end", label, {source} AS source, row_number() OVER (PARTITION BY {key} ORDER BY "start", "end" DESC, {order or f"list_position([{names}], rule), start"}) AS n
      FROM ({found}) WHERE "end" > "start"),
    f AS (SELECT {key}, n, 1 AS g, "start", "end", label, source, CAST(1 AS BIGINT) AS members FROM o WHERE n = 1
      UNION ALL
      SELECT {key}, n, g + CASE WHEN c = 'apart' THEN 1 ELSE 0 END, {pick('os', 'os', 'ls', 'least(ls, os)')}, {pick('oe', 'oe', 'le', 'greatest(le, oe)')},
        {pick('ol', 'ol', 'll', f"CASE WHEN {rank('ol')} < {rank('ll')} THEN ol ELSE ll END")}, {pick('osrc', 'jn', 'CASE WHEN c = ' + "'drop'" + ' THEN lsrc ELSE jo END', 'jo')},
        {pick('CAST(1 AS BIGINT)', 'm + 1', "CASE WHEN c = 'drop' THEN m ELSE m + 1 END", 'm + 1')}
      FROM (SELECT o.{key}, o.n, l.g, l.members AS m, o."start" AS os, o."end" AS oe, o.label AS ol, o.source AS osrc, l."start" AS ls, l."end" AS le, l.label AS ll, l.source AS lsrc,
        {joined('o', 'l')} AS jn, {joined('l', 'o')} AS jo, {state} AS c FROM f l JOIN o ON o.{key} = l.{key} AND o.n = l.n + 1))
    SELECT {key}, arg_max("start", n) AS "start", arg_max("end", n) AS "end", arg_max(label, n) AS label, arg_max(source, n) AS source, arg_max(members, n) AS members FROM f GROUP BY {key}, g
    """
