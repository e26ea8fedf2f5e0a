"""Queries over records, texts, timelines, catalogs and event time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import names, records, text, timeline
from .base import query, table

L = lambda c: c.cast("long")

# ---- strings ----------------------------------------------------------------------------------

_DIRTY = "'  ' || replace(text, '. ', '.   ' || chr(10) || chr(10) || chr(10) || chr(10) || chr(10)) || chr(9)"
_CLEAN = (
    f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_DIRTY}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '[ \\t]+\\n', chr(10), 'g'), "
    "'\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')"
)


@query("cleanup_artifacts", f"SELECT doc_id, sha256({_CLEAN}) AS sha FROM documents")
def cleanup_artifacts(spark, sf_dir):
    dirty = F.concat(F.lit("  "), F.replace("text", F.lit(". "), F.lit(".   \n\n\n\n\n")), F.lit("\t"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.cleanup(dirty), 256).alias("sha"))


@query(
    "plain_prompt",
    "SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace('- 1. ' || text, '[\\[\\]{}`]', '', 'g'), '(?m)^[ \\t]*(?:[-*#>|]+|[0-9]+[.)])[ \\t]+', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS sha FROM documents",
)
def plain_prompt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.plain_prompt(F.concat(F.lit("- 1. "), "text")), 256).alias("sha"))


_SLUG = "regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


_SLUGGED = f"SELECT p_partkey, slug, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM (SELECT p_partkey, regexp_replace({_SLUG}, '-[a-z]+$', CASE WHEN p_partkey % 9 = 0 THEN '-2' ELSE '' END) AS slug FROM part)"


@query(
    "unique_slugs",
    f"""WITH s AS ({_SLUGGED}), t AS (SELECT regexp_extract(slug, '^(.*)-([1-9][0-9]*)$', 1) AS base, list(DISTINCT CAST(regexp_extract(slug, '^(.*)-([1-9][0-9]*)$', 2) AS BIGINT)) AS taken
      FROM s WHERE regexp_matches(slug, '^.*-[1-9][0-9]*$') GROUP BY 1)
    SELECT p_partkey, slug, CASE WHEN n = 1 THEN slug ELSE slug || '-' || (list_filter(range(2, n + coalesce(len(taken), 0) + 2), lambda x: NOT list_contains(coalesce(taken, []), x)))[n - 1] END AS token
    FROM s LEFT JOIN t ON t.base = s.slug""",
)
def unique_slugs(spark, sf_dir):
    short = F.regexp_replace(text.slug(F.col("p_name")), "-[a-z]+$", "")
    rows = table(spark, sf_dir, "part").withColumn("title", F.when(F.col("p_partkey") % 9 == 0, F.concat(short, F.lit("-2"))).otherwise(short))
    return text.unique_slugs(rows, "title", "p_partkey").select("p_partkey", "slug", "token")


@query(
    "generalise_ages",
    "SELECT c_custkey, regexp_replace(regexp_replace(t, '(?i)\\b(?:9[0-9]|1[01][0-9])[ -](?:years?|yrs?)[ -]old\\b', '[AGE 90+]', 'g'), '(?i)\\bage[d: ]+(?:9[0-9]|1[01][0-9])\\b', '[AGE 90+]', 'g') AS t "
    "FROM (SELECT c_custkey, 'A ' || (c_custkey % 120) || '-year-old, aged ' || (c_custkey % 110) AS t FROM customer)",
)
def generalise_ages(spark, sf_dir):
    k = F.col("c_custkey")
    t = F.concat(F.lit("A "), (k % 120).cast("string"), F.lit("-year-old, aged "), (k % 110).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.generalise_ages(t).alias("t"))


@query(
    "template_interpolate",
    "SELECT s_suppkey, replace(replace('{{name_full}} of {{name}}: {{name_full}}', '{{name_full}}', s_name), '{{name}}', CAST(s_nationkey AS VARCHAR)) AS t FROM supplier",
)
def template_interpolate(spark, sf_dir):
    values = {"name": F.col("s_nationkey").cast("string"), "name_full": F.col("s_name")}
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.interpolate(F.lit("{{name_full}} of {{name}}: {{name_full}}"), values).alias("t"))


@query(
    "compact_head_tail",
    "SELECT doc_id, sha256(CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, 550) || chr(10) || '[...]' || chr(10) || right(text, 350) END) AS sha FROM documents",
)
def compact_head_tail(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.compact(F.col("text"), 1000), 256).alias("sha"))


@query(
    "token_hash_hue",
    "SELECT c_custkey, CAST(list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split(c_name, ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, c: (h * 31 + c) % 4294967296) % 360 AS BIGINT) AS hue FROM customer",
)
def token_hash_hue(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.hue(F.col("c_name")).alias("hue"))


@query("base64_codec", "SELECT c_custkey, rtrim(translate(to_base64(encode(c_name || '~' || c_mktsegment || '?>')), '+/', '-_'), '=') AS code, c_name || '~' || c_mktsegment || '?>' AS back FROM customer")
def base64_codec(spark, sf_dir):
    code = text.url_code(F.concat("c_name", F.lit("~"), "c_mktsegment", F.lit("?>")))
    return table(spark, sf_dir, "customer").select("c_custkey", code.alias("code"), text.url_decode(code).alias("back"))


@query("nth_occurrence", "SELECT doc_id, CASE WHEN len(string_split(text, 'the')) - 1 >= 3 THEN CAST(length(array_to_string(string_split(text, 'the')[1:3], 'the')) AS BIGINT) ELSE -1 END AS at FROM documents")
def nth_occurrence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(L(text.nth_position(F.col("text"), "the", 3)), F.lit(-1).cast("long")).alias("at"))


@query("occurrence_counts", "SELECT doc_id, len(string_split(text, 'the')) - 1 AS n FROM documents")
def occurrence_counts(spark, sf_dir):
    from ..operators.spans import occurrences

    return table(spark, sf_dir, "documents").select("doc_id", L(occurrences(F.col("text"), "the")).alias("n"))


@query(
    "chunk_windows",
    "SELECT doc_id, i AS chunk_no, i * 620 AS start, sha256(substr(text, i * 620 + 1, 700)) AS sha FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 80) / 620.0) AS BIGINT), 1) - 1)) AS i FROM documents)",
)
def chunk_windows(spark, sf_dir):
    found = text.chunks(table(spark, sf_dir, "documents"), 700, 80)
    return found.select("doc_id", L(F.col("chunk_no")).alias("chunk_no"), L(F.col("start")).alias("start"), F.sha2("chunk", 256).alias("sha"))


@query(
    "sha_manifest",
    "SELECT doc_id, sha256(text) AS sha, CAST(length(text) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS bytes, regexp_replace(source, '[^A-Za-z0-9]+', '_', 'g') || '-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS file FROM documents",
)
def sha_manifest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha"), L(F.length("text")).alias("chars"), L(F.octet_length("text")).alias("bytes"),
        F.concat_ws("-", F.regexp_replace("source", "[^A-Za-z0-9]+", "_"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("file"),
    )


@query(
    "html_links",
    "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages",
)
def html_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("html_text", "SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS sha FROM pages")
def html_text(spark, sf_dir):
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\r\n]+", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(plain, 256).alias("sha"))


@query("url_hosts", "SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1")
def url_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


@query(
    "normalise_labels",
    "SELECT event_type, CASE up WHEN 'CLICK' THEN 'DATE' WHEN 'PURCHASE' THEN 'ID' ELSE replace(up, '_', ' ') END AS label FROM (SELECT DISTINCT event_type, upper(regexp_replace(regexp_replace('B-' || event_type, '^[BI]-', ''), '[^A-Za-z0-9]+', '_', 'g')) AS up FROM events)",
)
def normalise_labels(spark, sf_dir):
    up = F.upper(F.regexp_replace(F.regexp_replace(F.concat(F.lit("B-"), "event_type"), "^[BI]-", ""), "[^A-Za-z0-9]+", "_"))
    known = F.create_map(F.lit("CLICK"), F.lit("DATE"), F.lit("PURCHASE"), F.lit("ID"))
    return table(spark, sf_dir, "events").select("event_type").distinct().select("event_type", F.coalesce(known[up], F.replace(up, F.lit("_"), F.lit(" "))).alias("label"))


@query("guideline_query", "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_type), 'a') AND contains(lower(p_name || ' ' || p_type), 'g ')")
def guideline_query(spark, sf_dir):
    have = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    terms = ["a", "g "]
    out = table(spark, sf_dir, "part")
    for t in terms:
        out = out.where(have.contains(t))
    return out.select("p_partkey")


# ---- records ----------------------------------------------------------------------------------

_CHANGES = "SELECT p_partkey, 'Changed ' || p_name AS p_name FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey + 1000000, p_name FROM part WHERE p_partkey % 97 = 0"


def _catalog(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    k = F.col("p_partkey")
    changes = part.where(k % 7 == 0).select("p_partkey", F.concat(F.lit("Changed "), "p_name").alias("p_name"))
    changes = changes.union(part.where(k % 97 == 0).select((k + 1000000).alias("p_partkey"), "p_name"))
    return part, changes, part.where(k % 11 == 0).select("p_partkey")


@query(
    "catalog_override",
    f"WITH c AS ({_CHANGES}), h AS (SELECT p_partkey FROM part WHERE p_partkey % 11 = 0) SELECT coalesce(c.p_partkey, b.p_partkey) AS p_partkey, coalesce(c.p_name, b.p_name) AS p_name FROM part b FULL JOIN c USING (p_partkey) WHERE coalesce(c.p_partkey, b.p_partkey) NOT IN (SELECT p_partkey FROM h)",
)
def catalog_override(spark, sf_dir):
    return records.override(*_catalog(spark, sf_dir), "p_partkey")


@query("catalog_upsert", f"WITH c AS ({_CHANGES}) SELECT coalesce(c.p_partkey, b.p_partkey) AS p_partkey, coalesce(c.p_name, b.p_name) AS p_name FROM part b FULL JOIN c USING (p_partkey)")
def catalog_upsert(spark, sf_dir):
    part, changes, _ = _catalog(spark, sf_dir)
    return records.upsert(part, changes, "p_partkey")


@query("catalog_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def catalog_semi(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(chosen, "o_custkey", "left_semi").select("o_orderkey")


@query("catalog_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 5 = 0)")
def catalog_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_orderkey % 5 = 0").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("catalog_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def catalog_lookup(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("s_suppkey", "n_name", "r_name")


@query("hidden_filter", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (3, 5, 8)")
def hidden_filter(spark, sf_dir):
    return table(spark, sf_dir, "nation").where(~F.col("n_nationkey").isin(3, 5, 8)).select("n_nationkey", "n_name")


@query(
    "normalise_sections",
    "SELECT conv_id, turn, coalesce(nullif(trim(CASE WHEN turn % 3 = 0 THEN '  ' ELSE role END), ''), 'Section') AS label, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'other' END AS kind, CAST(length(trim(text)) AS BIGINT) AS n FROM conversations",
)
def normalise_sections(spark, sf_dir):
    label = F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", records.or_default(label, "Section").alias("label"), records.one_of(F.col("role"), ["user", "assistant"], "other").alias("kind"),
        L(F.length(F.trim("text"))).alias("n"),
    )


@query(
    "normalise_days",
    "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN DATE '2026-05-01' + CAST(turn AS INTEGER) ELSE DATE '2026-01-01' END AS day FROM conversations",
)
def normalise_days(spark, sf_dir):
    given = F.when(F.col("turn") % 2 == 1, F.lit("2026-01-01").cast("date"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(given, F.date_add(F.lit("2026-05-01").cast("date"), F.col("turn").cast("int"))).alias("day"))


@query("legacy_role_map", "SELECT conv_id, turn, coalesce(m.kind, 'note') AS kind FROM conversations LEFT JOIN (VALUES ('user', 'capture'), ('system', 'context')) m(role, kind) USING (role)")
def legacy_role_map(spark, sf_dir):
    kinds = F.create_map(*[F.lit(x) for x in ("user", "capture", "system", "context")])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(kinds[F.col("role")], F.lit("note")).alias("kind"))


@query("preferences", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'OTHER' END AS kind, substr(trim(c_name), 1, 12) AS name FROM customer")
def preferences(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", records.one_of(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"], "OTHER").alias("kind"), F.substring(F.trim("c_name"), 1, 12).alias("name")
    )


@query("clean_choices", "SELECT p_partkey, array_to_string(list_filter(list_distinct_keep, lambda c: c <> ''), '|') AS choices FROM (SELECT p_partkey, list_transform(list_filter(list_zip(xs, range(1, len(xs) + 1)), lambda z: list_position(xs, z[1]) = z[2]), lambda z: z[1]) AS list_distinct_keep FROM (SELECT p_partkey, list_transform(string_split(p_type || ' ,' || p_type || ',, x', ','), lambda c: trim(c)) AS xs FROM part))")
def clean_choices(spark, sf_dir):
    given = F.split(F.concat("p_type", F.lit(" ,"), "p_type", F.lit(",, x")), ",")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(records.clean_choices(given), "|").alias("choices"))


@query("props_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


_KINDS = ["STANDARD", "SMALL", "MEDIUM", "LARGE"]


@query(
    "workup_validate",
    f"SELECT p_partkey, concat_ws('; ', CASE WHEN NOT regexp_matches(id, '^[a-z0-9][a-z0-9-]*$') THEN 'bad id' END, CASE WHEN kind NOT IN ({', '.join(repr(k) for k in _KINDS)}) THEN 'bad kind' END, "
    "CASE WHEN len(xs) < 2 THEN 'too few choices' END, CASE WHEN len(list_distinct(xs)) < len(xs) THEN 'repeated choice' END) AS problems "
    "FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_name ELSE 'w-' || p_partkey END AS id, string_split(p_type, ' ')[1] AS kind, string_split(substr(p_name, 1, 9), ' ') AS xs FROM part)",
)
def workup_validate(spark, sf_dir):
    item = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(F.concat(F.lit("w-"), F.col("p_partkey").cast("string")))
    found = records.problems(item, F.split("p_type", " ")[0], F.split(F.substring("p_name", 1, 9), " "), _KINDS)
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("problems"))


@query("checklist_items", "SELECT l_orderkey || ':' || l_linenumber AS id, o_orderpriority AS system, CAST(l_linenumber AS BIGINT) AS ord FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def checklist_items(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), F.col("o_orderpriority").alias("system"), L(F.col("l_linenumber")).alias("ord"))


@query("group_by_system", "SELECT o_orderpriority AS system, min(o_orderkey) AS first, count(*) AS items FROM orders GROUP BY 1")
def group_by_system(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("system")).agg(F.min("o_orderkey").alias("first"), F.count(F.lit(1)).alias("items"))


@query("completion_counts", "SELECT l_returnflag AS grp, count(*) AS items, count(*) FILTER (l_linestatus = 'F' OR l_discount > 0.05) AS done FROM lineitem GROUP BY 1")
def completion_counts(spark, sf_dir):
    done = F.count_if((F.col("l_linestatus") == "F") | (F.col("l_discount") > 0.05))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(F.count(F.lit(1)).alias("items"), done.alias("done"))


@query("fill_negative", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.04 THEN 'yes' ELSE 'no' END AS answer FROM lineitem")
def fill_negative(spark, sf_dir):
    given = F.when(F.col("l_tax") > 0.04, "yes")
    choices = F.array(F.lit("no"), F.lit("yes"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(given, choices[0]).alias("answer"))


@query("answers_summary", "SELECT l_orderkey, string_agg(l_linenumber || '=' || l_returnflag, '; ' ORDER BY l_linenumber, l_partkey, l_returnflag) AS text FROM lineitem GROUP BY 1")
def answers_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey"))
    return records.assemble(rows, "l_orderkey", "o", F.concat_ws("=", "l_linenumber", "l_returnflag"), "; ")


@query("trajectory_text", "SELECT conv_id, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn, text)) AS sha FROM conversations GROUP BY 1")
def trajectory_text(spark, sf_dir):
    made = records.assemble(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.concat_ws(": ", "role", "text"))
    return made.select("conv_id", F.sha2("text", 256).alias("sha"))


@query(
    "packet_completeness",
    "SELECT conv_id, array_to_string(list_sort(list_filter(['assistant', 'system', 'user'], lambda r: NOT list_contains(list(role), r))), ',') AS missing, count(*) AS turns FROM conversations GROUP BY 1",
)
def packet_completeness(spark, sf_dir):
    expected = F.array(*[F.lit(r) for r in ("assistant", "system", "user")])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_join(F.sort_array(F.array_except(expected, F.collect_set("role"))), ",").alias("missing"), F.count(F.lit(1)).alias("turns")
    )


@query("role_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 9 END, turn) AS ord FROM conversations")
def role_order(spark, sf_dir):
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(9)
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(rank, "turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", L(n).alias("ord"))


@query("notes_merge", "SELECT user_id, min(event_id) AS first, count(DISTINCT event_id) AS notes FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 0) GROUP BY 1")
def notes_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    once = e.union(e.where("event_id % 3 = 0")).dropDuplicates(["event_id"])
    return once.groupBy("user_id").agg(F.min("event_id").alias("first"), F.count(F.lit(1)).alias("notes"))


@query("latest_per_user", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_user(spark, sf_dir):
    return records.latest(table(spark, sf_dir, "events"), "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("delete_by_id", "SELECT user_id, max(event_id) AS active FROM events WHERE user_id % 5 <> 0 GROUP BY 1")
def delete_by_id(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    gone = e.where("user_id % 5 = 0").select("user_id").distinct()
    return e.join(gone, "user_id", "left_anti").groupBy("user_id").agg(F.max("event_id").alias("active"))


@query(
    "decision_carry_forward",
    "WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events), b AS (SELECT user_id, event_type, CASE WHEN value > 50 THEN 'confirmed' ELSE 'restored' END AS state, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events WHERE event_id % 2 = 0) "
    "SELECT a.event_id, coalesce(b.state, 'pending') AS state FROM a LEFT JOIN b USING (user_id, event_type, rn)",
)
def decision_carry_forward(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    old = e.where("event_id % 2 = 0").withColumn("state", F.when(F.col("value") > 50, "confirmed").otherwise("restored"))
    return records.carry_decisions(old, e, ["user_id", "event_type"], "event_id", "state").select("event_id", "state")


@query("next_pending", "SELECT user_id, event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), min(event_id) OVER (PARTITION BY user_id)) AS next FROM events")
def next_pending(spark, sf_dir):
    w = Window.partitionBy("user_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce(F.lead("event_id").over(w.orderBy("event_id")), F.min("event_id").over(w)).alias("next"))


@query("reorder_sections", "SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY coalesce(list_position([7, 3, 12], n_nationkey), 99), n_nationkey) AS ord FROM nation")
def reorder_sections(spark, sf_dir):
    at = F.nullif(F.array_position(F.array(F.lit(7), F.lit(3), F.lit(12)), F.col("n_nationkey")), F.lit(0))
    n = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.coalesce(at, F.lit(99)), "n_nationkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", L(n).alias("ord"))


@query(
    "incremental_plan",
    "SELECT conv_id, turn, CASE WHEN t = b THEN 'unchanged' WHEN b <> '' AND starts_with(t, b) THEN 'append' ELSE 'full' END AS mode, CASE WHEN b <> '' AND t <> b AND starts_with(t, b) THEN substr(t, length(b) + 1) ELSE '' END AS suffix "
    "FROM (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (SELECT conv_id, turn, repeat('line ', CAST(turn // 2 + 1 AS INTEGER)) || CASE WHEN turn % 5 = 4 THEN 'x' ELSE '' END AS t FROM conversations))",
)
def incremental_plan(spark, sf_dir):
    t = F.concat(F.repeat(F.lit("line "), (F.floor(F.col("turn") / 2) + 1).cast("int")), F.when(F.col("turn") % 5 == 4, "x").otherwise(""))
    return records.incremental_plan(table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t")), "conv_id", "turn", "t")


@query("fuzzy_names", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND levenshtein(a.s_name, b.s_name) <= 1")
def fuzzy_names(spark, sf_dir):
    return names.near(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", "s_nationkey")


@query("compact_codes", "SELECT o_orderkey, rtrim(translate(to_base64(encode('[' || o_custkey || ',\"' || o_orderstatus || '\"]')), '+/', '-_'), '=') AS code FROM orders")
def compact_codes(spark, sf_dir):
    packed = F.concat(F.lit("["), F.col("o_custkey").cast("string"), F.lit(',"'), "o_orderstatus", F.lit('"]'))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.url_code(packed).alias("code"))


@query("id_sets", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds, count(DISTINCT event_type) AS n FROM events GROUP BY 1")
def id_sets(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"), F.count_distinct("event_type").alias("n"))


@query("mirror_plan", "SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS rank, lower(replace(n_name, ' ', '-')) || '.workup.json' AS file FROM nation")
def mirror_plan(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", L(n).alias("rank"), F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit(".workup.json")).alias("file"))


@query("top_flags", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 12")
def top_flags(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, sf_dir, "customer").withColumn("n", n).where("n <= 12").select("c_nationkey", "c_custkey")


# ---- timeline ---------------------------------------------------------------------------------


@query("clock_parse", "SELECT o_orderkey, lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0') AS clock FROM (SELECT o_orderkey, o_orderkey % 24 AS h, o_orderkey % 60 AS m FROM orders)")
def clock_parse(spark, sf_dir):
    h, m = F.col("o_orderkey") % 24, F.col("o_orderkey") % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h12 = F.when(h % 12 == 0, 12).otherwise(h % 12)
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(two(h), two(m))).otherwise(F.concat(h12.cast("string"), F.lit(":"), two(m), F.when(h < 12, " AM").otherwise(" PM")))
    return table(spark, sf_dir, "orders").select("o_orderkey", timeline.parse_clock(said).alias("clock"))


@query("date_parse", "SELECT o_orderkey, coalesce(TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN '2026-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE), DATE '1900-01-01') AS d FROM orders")
def date_parse(spark, sf_dir):
    said = F.when(F.col("o_orderkey") % 3 == 0, "2/30/2026").when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(timeline.parse_date(said), F.lit("1900-01-01").cast("date")).alias("d"))


_ANCHOR = "SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS anchor FROM orders GROUP BY 1"


def _stays(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    return o.join(o.groupBy("o_custkey").agg(F.min("d").alias("anchor")), "o_custkey")


@query("hospital_day_index", f"SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - anchor + 1 AS BIGINT) AS day FROM orders JOIN ({_ANCHOR}) USING (o_custkey)")
def hospital_day_index(spark, sf_dir):
    return _stays(spark, sf_dir).select("o_orderkey", L(F.datediff("d", "anchor") + 1).alias("day"))


_UNITS = """CASE WHEN y = 1 THEN '1 year' WHEN y > 1 THEN y || ' years' END, CASE WHEN m = 1 THEN '1 month' WHEN m > 1 THEN m || ' months' END, CASE WHEN d = 1 THEN '1 day' WHEN d > 1 THEN d || ' days' END"""


def _duration_sql(a: str, b: str, source: str, key: str) -> str:
    return f"""SELECT {key}, CASE len(p) WHEN 0 THEN 'less than a day' WHEN 1 THEN p[1] WHEN 2 THEN p[1] || ' and ' || p[2] ELSE p[1] || ', ' || p[2] || ', and ' || p[3] END AS phrase FROM (
      SELECT {key}, list_filter([{_UNITS}], lambda x: x IS NOT NULL) AS p FROM (
        SELECT {key}, t // 12 AS y, t % 12 AS m, b - CAST(a + to_months(CAST(t AS INTEGER)) AS DATE) AS d FROM (
          SELECT {key}, a, b, mm - CASE WHEN CAST(a + to_months(CAST(mm AS INTEGER)) AS DATE) > b THEN 1 ELSE 0 END AS t FROM (
            SELECT {key}, {a} AS a, {b} AS b, (year({b}) - year({a})) * 12 + month({b}) - month({a}) AS mm FROM {source}))))"""


@query("civil_duration", _duration_sql("anchor", "CAST(o_orderdate AS DATE)", f"orders JOIN ({_ANCHOR}) USING (o_custkey)", "o_orderkey"))
def civil_duration(spark, sf_dir):
    return _stays(spark, sf_dir).select("o_orderkey", timeline.duration(F.col("anchor"), F.col("d")).alias("phrase"))


@query(
    "timeline_labels",
    f"""WITH p AS ({_duration_sql("CAST(o_orderdate AS DATE)", "DATE '1996-06-01'", "(SELECT * FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1996-06-01')", "o_orderkey")})
    SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1996-06-01' THEN '[Hospital Day ' || (CAST(o_orderdate AS DATE) - DATE '1996-06-01' + 1) || ']' ELSE '[' || phrase || ' prior to hospital admission]' END AS label
    FROM orders LEFT JOIN p USING (o_orderkey)""",
)
def timeline_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", timeline.placement(F.to_date("o_orderdate"), F.lit("1996-06-01").cast("date")).alias("label"))


@query(
    "year_inference",
    """SELECT o_orderkey, d FROM (SELECT o_orderkey, d, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(d - a), d) AS n FROM (
      SELECT o_orderkey, DATE '1996-06-01' AS a, TRY_CAST((1996 + unnest([-1, 0, 1])) || strftime(o_orderdate, '-%m-%d') AS DATE) AS d FROM orders) WHERE d - a <= 30) WHERE n = 1""",
)
def year_inference(spark, sf_dir):
    d = timeline.nearest_year(F.month("o_orderdate"), F.day("o_orderdate"), F.lit("1996-06-01").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"))


@query(
    "anchor_choice",
    """SELECT o_custkey, coalesce(max(d) FILTER (o_orderpriority = '1-URGENT'), min(d) FILTER (o_orderpriority = '2-HIGH'), min(d) FILTER (last - d <= 14)) AS anchor FROM (
      SELECT o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS d, max(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey) AS last FROM orders) GROUP BY 1""",
)
def anchor_choice(spark, sf_dir):
    context = F.when(F.col("o_orderpriority") == "1-URGENT", "current").when(F.col("o_orderpriority") == "2-HIGH", "admission").otherwise("none")
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"), context.alias("context"))
    return timeline.choose_anchor(rows, "o_custkey", "d", "context")


@query(
    "lab_ordinals",
    'SELECT event_id, n, "of", n = "of" AS latest FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id, event_type) AS "of" FROM events) WHERE "of" >= 2',
)
def lab_ordinals(spark, sf_dir):
    return timeline.ordinals(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("event_id", "n", "of", "latest")


# ---- event time (an extension over the events table) -------------------------------------------


@query("event_windows_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows_tumbling(spark, sf_dir):
    w = F.window("ts", "1 hour")
    return table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query(
    "event_windows_sliding",
    "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') - INTERVAL '30 minutes']) AS start FROM events) GROUP BY 1",
)
def event_windows_sliding(spark, sf_dir):
    w = F.window("ts", "1 hour", "30 minutes")
    return table(spark, sf_dir, "events").groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query(
    "event_sessions",
    """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
      FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s""",
)
def event_sessions(spark, sf_dir):
    w = F.session_window("ts", "30 minutes")
    return table(spark, sf_dir, "events").groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
