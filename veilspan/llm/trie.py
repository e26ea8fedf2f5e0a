"""Prefix trie of conversations, built as a Patricia tree: points first, unary nodes last.

Turns are sorted over the cluster and numbered where they lie, so that no conversation has to fit a
task. A prefix is known by a sum over its turns of hashes of place, role and text, 120 bits of SHA-256
in all; the sums run in blocks of ``BLOCK`` turns that are then added up.

Rows are grouped by the prefix that they continue, and only the root, branches (prefixes continued in
two ways) and ends are kept: the points. What lies between two points is an edge, and all of its nodes
have the members of the point below. Each edge is represented by its smallest conversation. Leaves and
saved tokens are sums over the edges below a point, taken along the paths of distinct
conversations, each edge once, on the path of its representative. A path through k points takes about
k*k/2 turns to make, so the windows along paths stay short. Last, unary nodes are made from edges:
their saved tokens are the lower point's and a suffix sum of the edge's words.

Defined cases: rows without a conv_id are in no conversation; turns of equal number (or none) are
ordered by role, then text, repeated rows follow one another; null roles and texts are empty; a
conversation that is left without turns ends at the root; other columns are ignored; an empty table has
no nodes, not even the root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, sized, table

BLOCK = 4096
#: Conversations whose ids lie in one stretch of so many are named together when ends are hashed.
STRETCH = 512
#: Conversations whose ids differ only below this share their first turns.
FAMILY, MOST_SHARED = 20, 3
WORD = r"[^\x20\x09-\x0D]+"


def _repeat(df: DataFrame, times: Column, name: str) -> DataFrame:
    """Each row ``times`` times, numbered from 0 in ``name``; in steps, so that no long array is made."""
    step = 1 << 16
    out = df.withColumn("_n", times).where("_n > 0").withColumn("_high", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {step}"))))
    low = F.sequence(F.lit(0).cast("long"), F.least(F.lit(step - 1).cast("long"), F.col("_n") - 1 - F.col("_high") * step))
    return out.withColumn("_low", F.explode(low)).withColumn(name, F.col("_high") * step + F.col("_low")).drop("_n", "_high", "_low")


def numbered(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, said, w)``: the turns of each conversation from 1, what they say as a hash, and their words."""
    t = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    once = t.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))  # repeated rows can't be told apart by sorting
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    placed = once.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = _repeat(placed.select("conv_id", said.alias("said"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("w"), "times"), F.col("times"), "again")
    placed = materialize(placed.select("conv_id", "said", "w", F.monotonically_increasing_id().alias("at"))).withColumn("share", F.shiftright("at", 33))
    begun = placed.groupBy("conv_id", "share").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("conv_id").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(begun.select("conv_id", "share", "begin", before.alias("before")), ["conv_id", "share"]).select(
        "conv_id", (F.col("before") + F.col("at") - F.col("begin") + 1).alias("pos"), "said", "w"
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns after the first ones were taken from the family's first conversation, and ``(conv_id, n)``, how many each has.

    ``turns`` is :func:`numbered` and written.
    """
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumns({"h": shared, "head": F.col("conv_id") - F.col("conv_id") % FAMILY})
    heads = own.where("conv_id = head").select("head", F.col("own").alias("has"))
    each = own.join(heads, "head", "left").withColumn("given", F.least("h", F.coalesce("has", F.lit(0))))
    each = materialize(each.select("conv_id", "head", "h", "given", (F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"), "own"))
    first = turns.where(f"pos <= {MOST_SHARED} and conv_id % {FAMILY} = 0").withColumnRenamed("conv_id", "head")
    taken = each.join(first, "head").where("pos <= h").select("conv_id", "pos", "said", "w")
    # own turns move where the family's first conversation had too few; joined by blocks of turns, so that no conversation is one key
    moved = each.where("given < h").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"own div {BLOCK}")))).select("conv_id", "b", (F.col("h") - F.col("given")).alias("back"))
    rest = turns.withColumn("b", F.expr(f"pos div {BLOCK}")).where(F.col("pos") > shared).join(moved, ["conv_id", "b"], "left")
    rest = rest.select("conv_id", (F.col("pos") - F.coalesce("back", F.lit(0))).alias("pos"), "said", "w")
    return taken.unionByName(rest), each.select("conv_id", "n")


def _key(pos: Column, a: Column, b: Column) -> Column:
    return F.unhex(F.substr(F.sha2(F.concat_ws(":", pos, a, b), 256), F.lit(1), F.lit(32)))


def prefixes(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, key, parent, w, words)``: each turn's prefix and the one before, its words, and those of all turns so far."""
    part = lambda at: F.conv(F.substr("h", F.lit(at), F.lit(15)), 16, 10).cast("decimal(20,0)")
    t = turns.withColumn("h", F.sha2(F.concat_ws(":", F.col("pos").cast("string"), "said"), 256))
    t = t.select("conv_id", "pos", "w", part(1).alias("a"), part(16).alias("b"), F.expr(f"(pos - 1) div {BLOCK}").alias("block"))
    sums = lambda w: [F.sum(c).over(w).alias(f"{c}_") for c in ("a", "b", "w")]
    inner = t.select("*", *sums(Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    whole = t.groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in ("a", "b", "w")])
    before = whole.select("conv_id", "block", *[x.alias(n) for x, n in zip(sums(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), ("a0", "b0", "w0"), strict=True)])
    j = inner.join(before, ["conv_id", "block"])
    total = lambda c: F.col(f"{c}_") + F.coalesce(f"{c}0", F.lit(0))
    a, b = total("a"), total("b")
    return j.select(
        "conv_id", "pos", _key(F.col("pos"), a, b).alias("key"), _key(F.col("pos") - 1, a - F.col("a"), b - F.col("b")).alias("parent"), "w", total("w").alias("words")
    )


def hashed_ends(ends: DataFrame) -> DataFrame:
    """``(key, ends_sha256)`` of ``ends(key, conv_id)``: hash of the ids in order, comma-joined.

    Ids are joined by stretches, and the stretches of a key run through one hash in order, so no list of ids is ever whole.
    """
    near = ends.groupBy("key", F.floor(F.col("conv_id") / STRETCH).alias("stretch")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    placed = near.repartition("key").sortWithinPartitions("key", "stretch")

    def run(batches):
        last, state = None, None
        for b in batches:
            keys, hashes = [], []
            for key, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if key != last:
                    if state is not None:
                        keys.append(last)
                        hashes.append(state.hexdigest())
                    last, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    return placed.select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def nodes(turns: DataFrame) -> DataFrame:
    """All nodes: ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``."""
    moved, convs = rebuilt(materialize(numbered(turns)))
    rows = materialize(prefixes(moved))
    root = _key(F.lit(0), F.lit(0), F.lit(0))
    ends = materialize(convs.join(rows.select("conv_id", F.col("pos").alias("n"), "key"), ["conv_id", "n"], "left").select("conv_id", F.col("n").alias("pos"), F.when(F.col("n") == 0, root).otherwise(F.col("key")).alias("key")))

    # points: what is continued in two ways, or ended at
    on = rows.groupBy(F.col("parent").alias("key"), (F.col("pos") - 1).alias("pos")).agg(F.count(F.lit(1)).alias("go"), F.min("conv_id").alias("go_id"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    done = ends.groupBy("key", "pos").agg(F.count(F.lit(1)).alias("stop"), F.min("conv_id").alias("stop_id"))
    points = on.join(done, ["key", "pos"], "full").where("pos = 0 or lo <> hi or stop > 0")
    points = materialize(points.select("key", "pos", (F.coalesce("go", F.lit(0)) + F.coalesce("stop", F.lit(0))).alias("n_convs"), F.least("go_id", "stop_id").alias("conv_id"), F.col("go").isNull().alias("leaf")))

    # distinct conversations are those that are smallest where they end; their paths through the points
    distinct = ends.join(done.select("key", F.col("stop_id").alias("conv_id")), ["key", "conv_id"]).select("conv_id")
    known = points.where("pos > 0").select("key", "n_convs", F.col("conv_id").alias("own_id"), "leaf")
    path = rows.select("conv_id", "pos", "key", "w", "words").join(sized(known), "key").join(distinct, "conv_id", "left_semi")
    top = points.where("pos = 0").select("key", "n_convs", F.col("conv_id").alias("own_id"), "leaf")
    nil = F.lit(0).cast("long")
    zero = distinct.withColumn("key", root).join(F.broadcast(top), "key")  # one row: the root
    zero = zero.select("conv_id", nil.alias("pos"), "key", nil.alias("w"), nil.alias("words"), "n_convs", "own_id", "leaf")
    down = Window.partitionBy("conv_id").orderBy("pos")
    path = path.select(zero.columns).unionByName(zero)
    path = path.withColumns({"up": F.lag(F.struct("pos", "key", "words", "own_id")).over(down), "own": F.col("conv_id") == F.col("own_id")})
    edge = F.when(F.col("own") & F.col("up").isNotNull(), (F.col("n_convs") - 1) * (F.col("words") - F.col("up.words"))).otherwise(0)
    below = F.sum("edge").over(Window.partitionBy("conv_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1))
    ending = F.max("leaf").over(Window.partitionBy("conv_id"))
    path = materialize(path.withColumn("edge", edge).withColumns({"below": F.coalesce(below, F.lit(0)), "ending": ending.cast("long")}))
    sums = path.groupBy("key").agg(F.sum("below").alias("below"), F.sum("ending").alias("n_leaves"))
    mine = path.where("own")  # one row for each point
    children = mine.where("up is not null").groupBy(F.col("up.key").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    made = mine.select("key", "conv_id", "pos", "n_convs", "w", "words", "up").join(sums, "key").join(children, "key", "left").join(hashed_ends(ends.select("key", "conv_id")), "key", "left")
    made = materialize(made.withColumn("saved", F.col("below") + (F.col("n_convs") - 1) * F.col("w")))

    none = hashlib.sha256(b"").hexdigest()
    over = lambda first: F.when(F.col("up").isNotNull(), F.when(first, F.col("up.own_id")).otherwise(F.col("conv_id")))
    out = made.select(
        "conv_id", F.col("pos").alias("depth"), over(F.col("up.pos") == F.col("pos") - 1).alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
    # unary nodes: the lower point's members, and the words of the edge from the node down to it
    inner = _repeat(made, F.when(F.col("up").isNotNull(), F.col("pos") - F.col("up.pos") - 1).otherwise(0), "i").withColumn("depth", F.col("up.pos") + 1 + F.col("i"))
    inner = inner.select("conv_id", "depth", "n_convs", "n_leaves", "saved", (F.col("words") - F.col("w")).alias("until"), "up", "i")
    inner = inner.join(rows.select("conv_id", F.col("pos").alias("depth"), "w", "words"), ["conv_id", "depth"])
    more = inner.select(
        "conv_id", "depth", over(F.col("i") == 0).alias("parent_conv_id"), "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") + (F.col("n_convs") - 1) * (F.col("until") - F.col("words") + F.col("w"))).alias("saved_tokens"), F.lit(none).alias("ends_sha256"),
    )
    return out.unionByName(more)


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
with recursive bit(i, x, n) as (
    select i::ubigint, i::ubigint, 0 from range(256) t(i)
    union all select i, xor(x >> 1, (x & 1) * 3988292384::ubigint), n + 1 from bit where n < 8),
tab as (select list(x order by i) as tab from bit where n = 8),
own as (
    select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos,
        {'role': coalesce(role, ''), 'text': coalesce(text, '')} as said
    from conversations where conv_id is not null),
conv as (
    select conv_id, conv_id - conv_id % 20 as head,
        xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::ubigint)),
            lambda crc, b: xor(tab[(xor(crc, b) & 255)::int + 1], crc >> 8)), 4294967295::ubigint) % 4 as h
    from (select distinct conv_id from own), tab),
size as (select c.conv_id, c.head, c.h, (select count(*) from own o where o.conv_id = c.head and o.pos <= c.h) as given from conv c),
moved as (
    select s.conv_id, o.pos, o.said from size s join own o on o.conv_id = s.head and o.pos <= s.h
    union all select s.conv_id, o.pos - s.h + s.given, o.said from size s join own o on o.conv_id = s.conv_id and o.pos > s.h),
path as (
    select conv_id, 0 as depth, []::struct(role varchar, text varchar)[] as path from conv
    union all select conv_id, pos, list(said) over (partition by conv_id order by pos) from moved),
long as (select conv_id, max(depth) as depth from path group by conv_id),
node as (
    select path, depth, count(*) as n, min(conv_id) as conv_id,
        case when depth = 0 then 0 else len(regexp_extract_all(path[-1].text, '[^\x20\x09-\x0D]+')) end as w from path group by path, depth),
kids as (select path[1:depth - 1] as path, count(*) as n_children from node where depth > 0 group by 1),
full_ as (select node.*, coalesce(n_children, 0) as n_children from node left join kids using (path)),
under as (
    select p.path, sum((m.n - 1) * m.w) as saved, count(*) filter (m.n_children = 0) as leaves
    from (select x.path as low, unnest(generate_series(0, x.depth)) as d from node x) y join full_ m on m.path = y.low join node p on p.path = y.low[1:y.d] group by p.path),
ended as (select p.path, sha256(string_agg(p.conv_id::varchar, ',' order by p.conv_id)) as ends from path p join long using (conv_id, depth) group by p.path)
select f.conv_id, f.depth::bigint as depth, up.conv_id as parent_conv_id, f.n::bigint as n_convs, f.n_children::bigint as n_children,
    u.leaves::bigint as n_leaves, u.saved::bigint as saved_tokens, coalesce(e.ends, sha256('')) as ends_sha256
from full_ f join under u using (path) left join ended e using (path) left join node up on f.depth > 0 and up.path = f.path[1:f.depth - 1]
"""
