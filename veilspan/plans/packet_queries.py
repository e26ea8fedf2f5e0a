"""Queries over records in one form, bundles, packets, variables, imported answers and fuzzy search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bundles, packets
from .base import query, table

_T = lambda x: f"CAST({x} AS VARCHAR)"
_L = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
s = lambda c: c.cast("string")
pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


# ---- records in one form ----------------------------------------------------------------------

_LABELS = ["Labs", " Medications ", "My own", "", "interval events", "Other"]
_GIVEN = ["", "admission_reason", "key_results", "nothing known"]
_LEGACY = "CASE " + " ".join(f"WHEN scope = '{a}' AND lower(trim(label)) = '{b}' THEN '{r}'" for (a, b), r in packets.LEGACY_ROLES.items()) + " END"
_ROLE = f"""CASE WHEN list_contains(CASE WHEN scope = 'daily' THEN {_L(packets.DAILY_ROLES)} ELSE {_L(packets.CONTEXT_ROLES)} END, given) THEN given
  ELSE coalesce({_LEGACY}, CASE WHEN trim(label) <> '' THEN CASE WHEN scope = 'daily' THEN 'additional_daily_source' ELSE 'additional_admission_source' END END,
    (CASE WHEN scope = 'daily' THEN {_L(packets.DAILY_ROLES)} ELSE {_L(packets.CONTEXT_ROLES)} END)[idx + 1], CASE WHEN scope = 'daily' THEN 'additional_daily_source' ELSE 'additional_admission_source' END) END"""
_ROLE_ROWS = f"""(SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'context' ELSE 'daily' END AS scope, {_L(_GIVEN)}[p_partkey // 3 % 4 + 1] AS given, {_L(_LABELS)}[p_partkey // 2 % 6 + 1] AS label, CAST(p_partkey % 9 AS INTEGER) AS idx FROM part)"""


@query("packet_roles", f"SELECT id, {_ROLE} AS role FROM {_ROLE_ROWS}")
def packet_roles(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    scope = F.when(k % 2 == 0, "context").otherwise("daily")
    return p.select(k.alias("id"), packets.role(scope, pick(_GIVEN, F.floor(k / 3)), pick(_LABELS, F.floor(k / 2)), k % 9).alias("role"))


_WARN = "[{'severity': CASE WHEN event_id % 3 = 0 THEN '' ELSE 'high' END, 'type': CASE WHEN event_id % 4 = 0 THEN 'Possible full name ' ELSE event_type END, 'reason': props}, {'severity': 'medium', 'type': '', 'reason': NULL}]"


@query(
    "section_warnings",
    f"""SELECT event_id, severity, type, reason FROM (SELECT event_id, coalesce(nullif(trim(w.severity), ''), 'review') AS severity, coalesce(nullif(trim(w.type), ''), 'warning') AS type, coalesce(w.reason, '') AS reason
    FROM (SELECT event_id, unnest({_WARN}) AS w FROM events)) WHERE lower(trim(type)) <> 'possible full name'""",
)
def section_warnings(spark, sf_dir):
    k = F.col("event_id")
    w = lambda a, b, c: F.struct(a.alias("severity"), b.alias("type"), c.alias("reason"))
    found = F.array(w(F.when(k % 3 == 0, "").otherwise("high"), F.when(k % 4 == 0, "Possible full name ").otherwise(F.col("event_type")), F.col("props")), w(F.lit("medium"), F.lit(""), F.lit(None).cast("string")))
    return table(spark, sf_dir, "events").select("event_id", F.inline(packets.warnings(found)))


_DEFAULTS = ["Admission context", "Medications", "Labs"]


@query(
    "patient_records",
    f"""WITH s AS (SELECT o_custkey AS id, CAST(o_orderkey AS INTEGER) AS idx, o_orderpriority AS label FROM orders WHERE o_orderkey % 5 = 0)
    SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'Patient ' || (c_custkey + 1) ELSE c_name END AS label, CASE WHEN n IS NULL THEN {len(_DEFAULTS)} ELSE n END AS sections, coalesce(first, '{_DEFAULTS[0]}') AS first
    FROM customer LEFT JOIN (SELECT id, count(*) AS n, arg_min(label, idx) AS first FROM s GROUP BY id) x ON x.id = c_custkey""",
)
def patient_records(spark, sf_dir):
    own = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").cast("int").alias("idx"), F.col("o_orderpriority").alias("label"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("idx"), F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_name")).alias("label"))
    made = packets.patients(rows, packets.sections(own, "context"), _DEFAULTS)
    return made.select("id", "label", F.size("sections").cast("long").alias("sections"), F.col("sections")[0]["label"].alias("first"))


@query(
    "migrated_states",
    """WITH p AS (SELECT n_regionkey AS state, n_nationkey AS id, n_nationkey % 3 = 0 AS gone FROM nation)
    SELECT state, CASE WHEN bool_or(id = state * 2 + 1 AND NOT gone) THEN CAST(state * 2 + 1 AS VARCHAR) ELSE coalesce(CAST(min(id) FILTER (NOT gone) AS VARCHAR), '') END AS active,
      coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (NOT gone), '') AS patients, CAST(state AS VARCHAR) || ',7' AS hidden FROM p GROUP BY state""",
)
def migrated_states(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("state"), F.col("n_nationkey").alias("id"))
    made = n.groupBy("state").agg(F.sort_array(F.collect_list(F.struct("id", (F.col("id") % 3 == 0).alias("gone")))).alias("x"))
    states = made.select(
        "state", s(F.col("state") * 2 + 1).alias("active"), F.transform("x", lambda p: F.struct(s(p.id).alias("id"), F.when(p.gone, "2020-01-01").alias("archived"))).alias("patients"),
        F.array("state", F.lit(7), F.col("state")).alias("hidden"), F.array("state").alias("selected"),
    )
    return packets.migrate_state(states).select("state", "active", F.array_join("patients", ",").alias("patients"), F.array_join("hidden", ",").alias("hidden"))


@query(
    "workup_drafts",
    """SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS id, p_brand || '|' || p_type AS aliases, trim(regexp_replace(lower('Ask of ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS item, 'no|yes' AS choices, CAST(1 AS BIGINT) AS items FROM part""",
)
def workup_drafts(spark, sf_dir):
    items = F.array(F.struct(F.concat(F.lit("Ask of "), "p_type").alias("text"), F.lit("no, yes\nno").alias("choices")), F.struct(F.lit("  ").alias("text"), F.lit("a").alias("choices")))
    d = packets.draft(F.col("p_name"), F.concat("p_brand", F.lit(", ,"), "p_type", F.lit(" ,"), "p_brand"), items)
    made = table(spark, sf_dir, "part").select("p_partkey", d.alias("d"))
    return made.select("p_partkey", "d.id", F.array_join("d.aliases", "|").alias("aliases"), F.col("d.items")[0]["id"].alias("item"), F.array_join(F.col("d.items")[0]["choices"], "|").alias("choices"), F.size("d.items").cast("long").alias("items"))


# ---- bundles ----------------------------------------------------------------------------------

_ANSWERS_SQL = "SELECT l_orderkey, count(*) FILTER (l_linenumber % 3 > 0) AS answers, CAST(coalesce(sum(l_partkey) FILTER (l_linenumber % 3 = 1), 0) AS BIGINT) AS noted FROM lineitem GROUP BY l_orderkey"


def _answers(spark, sf_dir):
    n = F.col("l_linenumber") % 3
    one = F.struct(F.concat(F.lit("q\""), s(F.col("l_linenumber"))).alias("item"), F.when(n == 2, F.array(F.lit("yes"), F.col("l_returnflag"))).otherwise(F.array().cast("array<string>")).alias("selected"), F.when(n == 1, s(F.col("l_partkey"))).otherwise("").alias("note"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one)).alias("answers"))


def _decoded(given, column):
    a = F.col(column)["answers"]
    noted = F.aggregate(F.filter(a, lambda x: x.note != ""), F.lit(0).cast("long"), lambda t, x: t + x.note.cast("long"))
    return given.select("l_orderkey", F.size(a).cast("long").alias("answers"), noted.alias("noted"))


@query("return_codes", _ANSWERS_SQL)
def return_codes(spark, sf_dir):
    coded = _answers(spark, sf_dir).select("l_orderkey", bundles.encode_return(s(F.col("l_orderkey")), F.col("answers"), F.lit("2026-01-01")).alias("code"))
    return _decoded(coded.select("l_orderkey", bundles.decode_return(F.concat(F.lit(" #return="), "code")).alias("d")).where("d.error is null and d.checklist = cast(l_orderkey as string)"), "d")


@query("return_inputs", f"SELECT kind, count(*) AS n, CAST(coalesce(sum(answers), 0) AS BIGINT) AS answers FROM (SELECT CASE l_orderkey % 4 WHEN 3 THEN 'not a returned checklist' ELSE 'ok' END AS kind, CASE WHEN l_orderkey % 4 < 3 THEN answers END AS answers FROM ({_ANSWERS_SQL})) GROUP BY kind")
def return_inputs(spark, sf_dir):
    k = F.col("l_orderkey") % 4
    coded = _answers(spark, sf_dir).select("l_orderkey", bundles.encode_return(s(F.col("l_orderkey")), F.col("answers"), F.lit("2026-01-01")).alias("code"))
    file = F.concat(F.lit('{"schema":"' + bundles.TRANSFER + '","type":"return","payload":"'), "code", F.lit('"}'))
    old = F.concat(F.lit('{"bundle":"'), "code", F.lit('"}'))
    given = F.when(k == 0, F.col("code")).when(k == 1, file).when(k == 2, old).otherwise(F.regexp_replace(file, '"return"', '"checklist"'))
    read = coded.select(bundles.decode_return_input(given).alias("d"))
    return read.groupBy(F.coalesce("d.error", F.lit("ok")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("d.answers")), F.lit(0)).alias("answers"))


@query(
    "checklist_codes",
    """SELECT p_brand, 'Patient' AS label, count(*) AS items, count(*) FILTER (p_partkey % 2 = 0) AS exams, count(*) FILTER (p_partkey % 3 = 0) AS many, string_agg(p_type || ':' || p_name, ';' ORDER BY p_partkey) AS texts FROM part GROUP BY p_brand""",
)
def checklist_codes(spark, sf_dir):
    k = F.col("p_partkey")
    item = F.struct(k.alias("k"), s(k).alias("id"), F.col("p_type").alias("title"), F.when(k % 2 == 0, "exam").otherwise("history").alias("kind"), F.col("p_name").alias("text"), F.array(F.lit("no"), F.lit("y,\"es")).alias("choices"), F.when(k % 3 == 0, "many").otherwise("one").alias("select"), F.lit("x").alias("system"))
    nested = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(item)).alias("items"), F.sort_array(F.collect_set("p_type")).alias("titles"))
    coded = nested.select("p_brand", bundles.encode_checklist(F.lit(""), F.col("p_brand"), F.col("items"), F.col("titles"), F.lit("")).alias("code"))
    d = coded.select("p_brand", bundles.decode_checklist(F.col("code")).alias("d")).where("d.snapshot = p_brand and d.items[0].choices[1] = 'y,\"es'")
    items = F.col("d.items")
    return d.select(
        "p_brand", "d.label", F.size(items).cast("long").alias("items"), F.size(F.filter(items, lambda i: i.kind == "exam")).cast("long").alias("exams"),
        F.size(F.filter(items, lambda i: i.select == "many")).cast("long").alias("many"), F.array_join(F.transform(items, lambda i: F.concat(i.title, F.lit(":"), i.text)), ";").alias("texts"),
    )


# ---- packets ----------------------------------------------------------------------------------

_ROLES = packets.CONTEXT_ROLES + packets.DAILY_ROLES
_SECTION = f"(SELECT o_custkey AS id, o_orderkey AS idx, {_L(_ROLES)}[o_orderkey % {len(_ROLES)} + 1] AS role, o_orderpriority AS title, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE repeat(o_orderstatus || '{{x}} ', CAST(o_orderkey % 40 + 1 AS INTEGER)) || 'end' END AS text FROM orders)".replace("{{", "{").replace("}}", "}")


def _sections(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 7 == 0, " ").otherwise(F.concat(F.repeat(F.concat("o_orderstatus", F.lit("{x} ")), (k % 40 + 1).cast("int")), F.lit("end")))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), k.alias("idx"), pick(_ROLES, k).alias("role"), F.col("o_orderpriority").alias("title"), text.alias("text"), (k % 2).alias("warned"))


@query(
    "admission_packet",
    f"""SELECT id, string_agg('## ' || title || chr(10) || CASE WHEN length(trim(text)) <= 60 THEN trim(text) ELSE substr(trim(text), 1, 33) || chr(10) || '[...]' || chr(10) || right(trim(text), 21) END, chr(10) || chr(10) ORDER BY coalesce(nullif(list_position({_L(_ROLES[:4])}, role), 0), 5), idx) AS text
    FROM {_SECTION} WHERE trim(text) <> '' GROUP BY id""",
)
def admission_packet(spark, sf_dir):
    return packets.assemble(_sections(spark, sf_dir), "id", _ROLES[:4], 60)


@query(
    "progress_packet",
    f"""WITH s AS (SELECT *, CASE WHEN list_contains({_L(packets.CONTEXT_ROLES)}, role) THEN 0 ELSE 1 END AS part, list_position({_L(_ROLES)}, role) AS r FROM {_SECTION} WHERE role <> '{packets.CONTEXT_ROLES[-1]}'),
    b AS (SELECT id, coalesce(string_agg(role || ': ' || trim(text), chr(10) ORDER BY part, r, idx) FILTER (trim(text) <> ''), '') AS body,
      array_to_string(list_filter({_L(packets.DAILY_ROLES[:-1])}, lambda x: NOT list_contains(coalesce(list(DISTINCT role) FILTER (trim(text) <> ''), []), x)), ',') AS missing, CAST(sum(idx % 2) AS BIGINT) AS warnings FROM s GROUP BY id)
    SELECT id, body || CASE WHEN id % 3 = 2 THEN '' ELSE chr(10) || 'exam: ' || CASE WHEN id % 3 = 0 THEN 'clear' ELSE 'note ' || id END END AS text, missing, warnings FROM b""",
)
def progress_packet(spark, sf_dir):
    rows = _sections(spark, sf_dir)
    k = F.col("c_custkey")
    exam = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 3 == 0, "clear").otherwise(" ").alias("checklist"), F.when(k % 3 == 1, F.concat(F.lit("note "), s(k))).alias("note"))
    return packets.packet(rows.where(F.col("role").isin(*packets.CONTEXT_ROLES)), rows.where(F.col("role").isin(*packets.DAILY_ROLES)), exam)


@query(
    "prompt_variables",
    f"""SELECT id, CASE WHEN n > 1 THEN token || '_' || n ELSE token END AS token, text FROM (SELECT *, row_number() OVER (PARTITION BY id, token ORDER BY name, text) AS n FROM (
      SELECT id, 'section.' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_') AS token, title AS name, text FROM {_SECTION} WHERE trim(text) <> ''
      UNION ALL SELECT c_custkey, 'who.' || trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '_', 'g'), '_'), c_mktsegment, c_name FROM customer))""",
)
def prompt_variables(spark, sf_dir):
    sections = _sections(spark, sf_dir).select("id", F.col("title").alias("name"), "text")
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.col("c_name").alias("text"))
    return packets.variables({"section": sections, "who": who})


@query(
    "prompt_templates",
    """SELECT p_partkey, CASE WHEN contains(t, '{{' || p_type || '}}') THEN t ELSE '{{' || p_type || '}}' || CASE WHEN t = '' THEN '' ELSE chr(10) || t END END AS text
    FROM (SELECT p_partkey, p_type, CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 = 1 THEN p_brand || ' {{' || p_type || '}}' WHEN p_partkey % 4 = 2 THEN 'guide' ELSE '' END AS t FROM part)""",
)
def prompt_templates(spark, sf_dir):
    k = F.col("p_partkey") % 4
    saved, default = F.when(k == 0, F.col("p_name")), F.when(k == 1, F.concat("p_brand", F.lit(" {{"), "p_type", F.lit("}}"))).otherwise(" ")
    return table(spark, sf_dir, "part").select("p_partkey", packets.template(saved, default, F.when(k == 2, "guide"), F.col("p_type")).alias("text"))


@query("saved_outputs", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'a,b' END AS names FROM events")
def saved_outputs(spark, sf_dir):
    given = F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("y"))
    kept = packets.set_output(given, F.lit("b"), F.when(F.col("event_id") % 2 == 0, " ").otherwise("new"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.sort_array(F.map_keys(kept)), ",").alias("names"))


# ---- answers, ids, search ---------------------------------------------------------------------

_VALUES = {0: ["YES ", "no"], 1: ["maybe", "Yes"], 2: ["  "], 3: ["not assessed"]}


@query(
    "imported_answers",
    """SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN CASE WHEN many THEN 'yes|no' ELSE 'yes' END WHEN 1 THEN 'yes' ELSE '' END AS selected,
    CASE k WHEN 1 THEN 'said; maybe' WHEN 3 THEN 'said; not assessed' ELSE 'said' END AS note FROM (SELECT l_orderkey, l_linenumber, l_partkey % 4 AS k, l_linenumber % 2 = 0 AS many FROM lineitem)""",
)
def imported_answers(spark, sf_dir):
    k = F.col("l_partkey") % 4
    values = F.array().cast("array<string>")
    for n, v in _VALUES.items():
        values = F.when(k == n, F.array(*[F.lit(x) for x in v])).otherwise(values)
    got = packets.imported(F.array(F.lit("no"), F.lit("yes")), F.col("l_linenumber") % 2 == 0, values, F.lit(" said "))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", got.alias("g")).select("l_orderkey", "l_linenumber", F.array_join("g.selected", "|").alias("selected"), "g.note")


@query("meaningful_answers", "SELECT l_orderkey, count(*) FILTER (l_partkey % 3 <> 0) AS answers FROM lineitem GROUP BY l_orderkey")
def meaningful_answers(spark, sf_dir):
    k = F.col("l_partkey") % 3
    one = F.struct(F.col("l_linenumber").alias("item"), F.when(k == 1, F.array(F.lit("yes"), F.lit("Not assessed"))).otherwise(F.array(F.lit("not assessed "))).alias("selected"), F.when(k == 2, "seen").otherwise(" ").alias("note"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(one).alias("a")).select("l_orderkey", F.size(packets.meaningful(F.col("a"))).cast("long").alias("answers"))


@query("local_ids", "SELECT o_orderkey, 'note_' || substr(sha256(o_custkey || chr(31) || o_orderstatus), 1, 16) AS id FROM orders")
def local_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", packets.local_id("note", F.col("o_custkey"), F.col("o_orderstatus")).alias("id"))


_LIKE = lambda x, q: f"CASE WHEN contains(lower({x}), '{q}') THEN 1.0 ELSE greatest(list_max(list_transform(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: 1 - levenshtein(w, '{q}') / greatest(length(w), {len(q)}, 1))), 0.0) END"


def _search_sql(weights, q):
    score = " + ".join(f"{_LIKE(f, q)} * {w}" for f, w in weights.items())
    top = ", ".join(_LIKE(f, q) for f in weights)
    return f"SELECT p_partkey, round({score}, 6) AS score FROM part WHERE greatest({top}) >= 0.65"


_TITLE, _TEXT = {"p_name": 0.55, "p_type": 0.3, "p_brand": 0.15}, {"p_name": 0.6, "p_brand": 0.25, "p_type": 0.15}


def _search(spark, sf_dir, weights, q):
    score, hit = packets.fuzzy(q, weights)
    return table(spark, sf_dir, "part").where(hit).select("p_partkey", score.alias("score"))


@query("catalog_search", _search_sql(_TITLE, "widgit"))
def catalog_search(spark, sf_dir):
    return _search(spark, sf_dir, _TITLE, " Widgit")


@query("checklist_search", _search_sql(_TEXT, "econmy"))
def checklist_search(spark, sf_dir):
    return _search(spark, sf_dir, _TEXT, "econmy")
