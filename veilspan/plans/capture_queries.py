"""Queries over captures, libraries and the day that a timeline starts from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import captures
from .base import query, table

_PAIRS = lambda d: " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items())
_GIVEN = ["physical_exam", "pre_round_physical_exam", "results", "odd kind", None]
_KIND_LIST = "['physical_exam', 'pre_round_physical_exam', 'results', 'odd kind', NULL]"
_KNOWN = ", ".join(f"'{k}'" for k in captures.KINDS)


@query(
    "source_captures",
    f"""SELECT CASE WHEN event_id % 7 = 0 THEN 'capture_' || substr(sha256(concat_ws(chr(31), k, l, t)), 1, 16) ELSE CAST(event_id AS VARCHAR) END AS id, k AS kind, l AS label, t AS text, coalesce(c, m, now) AS captured, coalesce(m, c, now) AS created, coalesce(u, m, c, now) AS updated
    FROM (SELECT *, coalesce(nullif(trim(label), ''), CASE k {_PAIRS(captures.KINDS)} END) AS l FROM (
      SELECT event_id, CASE WHEN g = 'pre_round_physical_exam' THEN 'physical_exam' WHEN g IN ({_KNOWN}) THEN g ELSE 'other_chart_text' END AS k, CASE event_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN event_type END AS label, coalesce(CASE WHEN event_id % 11 > 0 THEN props END, '') AS t,
        CASE WHEN event_id % 2 = 0 THEN ts END AS c, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 1 DAY END AS m, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 2 DAY END AS u, TIMESTAMP '2030-01-01' AS now
      FROM (SELECT *, {_KIND_LIST}[CAST(event_id % 5 + 1 AS BIGINT)] AS g FROM events)))""",
)
def source_captures(spark, sf_dir):
    i, ts = F.col("event_id"), F.col("ts")
    given = F.element_at(F.array(*[F.lit(x) for x in _GIVEN]), (i % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(
        F.when(i % 7 == 0, "").otherwise(i.cast("string")).alias("id"), given.alias("kind"), F.when(i % 3 == 0, " ").when(i % 3 == 1, F.col("event_type")).alias("label"), F.when(i % 11 > 0, F.col("props")).alias("text"),
        F.when(i % 2 == 0, ts).alias("captured"), F.when(i % 5 == 0, ts + F.expr("interval 1 day")).alias("created"), F.when(i % 4 == 0, ts + F.expr("interval 2 days")).alias("updated"),
    )
    return captures.captures(rows, F.lit("2030-01-01").cast("timestamp_ntz"))


_ROLE_LIST = "[" + ", ".join(f"'{r}'" for r in captures.ROLES) + ", 'unknown']"


@query(
    "migrated_captures",
    f"""SELECT event_id AS id, CASE r {_PAIRS(captures.ROLES)} ELSE 'other_chart_text' END AS kind, event_type AS label, t AS text, CAST(NULL AS TIMESTAMP) IS NULL AS dated
    FROM (SELECT *, {_ROLE_LIST}[CAST(event_id % {len(captures.ROLES) + 1} + 1 AS BIGINT)] AS r, CASE WHEN event_id % 4 = 0 THEN ' ' ELSE props END AS t FROM events) WHERE trim(t) <> '' OR event_id % 8 = 0""",
)
def migrated_captures(spark, sf_dir):
    i = F.col("event_id")
    roles = [*captures.ROLES, "unknown"]
    rows = table(spark, sf_dir, "events").select(
        i.alias("id"), F.element_at(F.array(*[F.lit(r) for r in roles]), (i % len(roles) + 1).cast("int")).alias("role"), F.col("event_type").alias("label"), F.when(i % 4 == 0, " ").otherwise(F.col("props")).alias("text"),
        F.when(i % 8 == 0, 1).otherwise(0).alias("warned"), F.col("ts").alias("created"), F.lit(None).cast("timestamp_ntz").alias("updated"),
    )
    return captures.migrated(rows).select("id", "kind", "label", "text", (F.col("captured") == F.col("created")).alias("dated"))


@query(
    "workup_libraries",
    f"""SELECT id, title, CASE WHEN n % 2 = 0 THEN '1.0.0' ELSE '2.1' END AS version, '' AS description, len(w) AS workups, concat_ws('; ', CASE WHEN n % 5 = 1 THEN 'schema must be {captures.LIBRARY}' END, CASE WHEN id = '' THEN 'id is required' END,
      CASE WHEN NOT regexp_matches(id, '(?i)^[a-z0-9][a-z0-9._-]*$') THEN 'id must be URL-safe' END, CASE WHEN title = '' THEN 'title is required' END, CASE WHEN len(w) = 0 THEN 'workups must contain at least one workup' END,
      CASE WHEN len(list_distinct(w)) < len(w) THEN 'workup ids must be unique within a library' END) AS problems
    FROM (SELECT n_nationkey AS n, CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'lib ' || n_nationkey ELSE 'lib.' || n_nationkey END AS id, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END AS title,
      (SELECT CASE WHEN n_nationkey % 7 = 2 THEN [] ELSE list('w' || (s_suppkey % 40)) END FROM supplier WHERE s_nationkey = n_nationkey) AS w FROM nation) WHERE w IS NOT NULL""",
)
def workup_libraries(spark, sf_dir):
    k = F.col("n_nationkey")
    own = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_list(F.concat(F.lit("w"), (F.col("s_suppkey") % 40).cast("string"))).alias("w"))
    rows = table(spark, sf_dir, "nation").join(own, "n_nationkey", "left").where(F.col("w").isNotNull() | (k % 7 == 2))
    rows = rows.select(
        F.when(k % 5 == 1, "old").otherwise(captures.LIBRARY).alias("schema"), F.when(k % 4 == 0, None).when(k % 4 == 1, F.concat(F.lit("lib "), k.cast("string"))).otherwise(F.concat(F.lit(" lib."), k.cast("string"))).alias("id"),
        F.when(k % 3 == 0, " ").otherwise(F.col("n_name")).alias("title"), F.when(k % 2 == 0, "").otherwise("2.1").alias("version"), F.lit(None).cast("string").alias("description"),
        F.when(k % 7 == 2, F.array().cast("array<string>")).otherwise(F.col("w")).alias("workups"),
    )
    return captures.libraries(rows).withColumn("workups", F.size("workups").cast("long"))


_TYPED = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN '2026-02-31' ELSE '' END"


def _typed():
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    return F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MM/dd/yyyy")).when(k == 2, "2026-02-31").otherwise("")


@query(
    "stay_anchors",
    f"""WITH g AS (SELECT o_custkey AS id, arg_max(CAST(t AS DATE), (o_orderkey, t)) AS g FROM (SELECT *, {_TYPED} AS t FROM orders) WHERE o_orderkey % 4 = 0 AND o_custkey % 3 > 0 GROUP BY 1),
    d AS (SELECT o_custkey AS id, min(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_custkey % 3 < 2 GROUP BY 1)
    SELECT c_custkey AS id, coalesce(CAST(coalesce(g, d) AS VARCHAR), '') AS anchor, CASE WHEN g IS NOT NULL THEN 'given' WHEN d IS NOT NULL THEN 'days' ELSE 'missing' END AS source FROM customer c LEFT JOIN g ON g.id = c_custkey LEFT JOIN d ON d.id = c_custkey""",
)
def stay_anchors(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    given = orders.where("o_custkey % 3 > 0").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("at"), _typed().alias("text"))
    days = orders.where("o_custkey % 3 < 2").select(F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("date"))
    found = captures.anchored(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), given, days)
    return found.withColumn("anchor", F.coalesce(F.col("anchor").cast("string"), F.lit("")))


@query(
    "remembered_days",
    f"""SELECT id, step, coalesce(CAST(last_value(CASE WHEN step % 4 = 0 THEN CAST(t AS DATE) END IGNORE NULLS) OVER (PARTITION BY id ORDER BY step ROWS UNBOUNDED PRECEDING) AS VARCHAR), '') AS day FROM (SELECT o_custkey AS id, o_orderkey AS step, {_TYPED} AS t FROM orders)""".replace("CAST(t AS DATE)", "TRY_CAST(t AS DATE)"),
)
def remembered_days(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("at"), _typed().alias("text"))
    return captures.remembered(rows).select("id", F.col("at").alias("step"), F.coalesce(F.col("day").cast("string"), F.lit("")).alias("day"))


@query("local_days", "SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE CASE event_id % 3 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Asia/Tokyo' ELSE 'UTC' END AS DATE) AS day FROM events")
def local_days(spark, sf_dir):
    k = F.col("event_id") % 3
    zone = F.when(k == 0, "America/New_York").when(k == 1, "Asia/Tokyo").otherwise("UTC")
    return table(spark, sf_dir, "events").select("event_id", captures.local_day(F.col("ts").cast("timestamp"), zone).alias("day"))
