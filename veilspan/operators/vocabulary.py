"""Vocabularies of any size up to a stated bound, compiled into one hash table that expressions look terms up in.

A vocabulary is a table ``(term, kind)``. Compiled, it is one array of buckets that a scalar subquery
makes once for a query; tasks get it with the plan's constants. Expressions see it as a
name, so a plan is as large with ten terms as with a hundred thousand, and looking a term up
takes the time of its bucket.

Defined cases: terms are compared in the form of :func:`normal`; null and empty terms, and kinds that
are not in :data:`KINDS`, are left out; a term of several kinds has them all; with no terms nothing is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import let

#: What a term may be; each kind is a bit of a term's number.
KINDS = ["clinical", "anchor", "eponym", "companion", "heading", "service", "medication", "place", "facility", "common", "given", "surname", "relation", "title", "field", "analyte"]
#: Most terms of a compiled vocabulary, about 16 MB; a larger one has to be joined by word.
LIMIT = 200_000
_TABLE = "array<array<struct<term:string,kinds:int>>>"


def bit(*kinds: str) -> int:
    return sum(1 << KINDS.index(k) for k in kinds)


def normal(text: Column) -> Column:
    """Lower case, letters and digits only, words one space apart."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def terms(spark: SparkSession, lists: dict[str, Iterable[str]]) -> DataFrame:
    """A vocabulary of given lists by kind."""
    return spark.createDataFrame([(t, k) for k, words in lists.items() for t in words], "term string, kind string")


def folded(vocabulary: DataFrame) -> DataFrame:
    """``(term, kinds)``: each term once, with the bits of its kinds."""
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    each = vocabulary.select(normal(F.col("term")).alias("term"), kind.cast("int").alias("k")).where("term <> '' and k > 0")
    return each.groupBy("term").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("k") - 1)).alias("kinds"))


def compiled(vocabulary: DataFrame, limit: int = LIMIT) -> Column:
    """The vocabulary as a scalar subquery. More than ``limit`` terms are an error."""
    spark = vocabulary.sparkSession
    rows = folded(vocabulary)
    n = rows.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"the vocabulary has more than {limit} terms; raise the limit, or look terms up by a join")
    size = 1 << max(n, 1).bit_length()
    kept = rows.withColumn("b", F.pmod(F.xxhash64("term"), F.lit(size))).groupBy("b").agg(F.collect_list(F.struct("term", "kinds")).alias("e"))
    every = spark.range(size).withColumnRenamed("id", "b").join(kept, "b", "left").select("b", F.coalesce("e", F.array().cast("array<struct<term:string,kinds:int>>")).alias("e"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "e"))), lambda x: x.e).cast(_TABLE).alias("v")).scalar()


def looked_up(df: DataFrame, vocabulary: DataFrame, name: str, body: Callable[[str], str], limit: int = LIMIT) -> DataFrame:
    """``df`` with a column ``name``: ``body`` of the compiled vocabulary's name, as SQL text.

    The subquery's column is named once, so that the optimiser puts the subquery into the expression
    and no row carries the table.
    """
    column = "_vocabulary"
    while column in df.columns:
        column = "_" + column
    return df.withColumn(column, compiled(vocabulary, limit)).withColumn(name, F.expr(let("voc", column, body("voc")))).drop(column)


def kinds_expr(table: str, term: str) -> str:
    """The bits of a term in normal form, 0 if it is not in the vocabulary."""
    return f"coalesce(get(filter(get({table}, cast(pmod(xxhash64({term}), size({table})) as int)), e -> e.term = {term}), 0).kinds, 0)"


def has_expr(bits: str, *which: str) -> str:
    return f"(({bits}) & {bit(*which)}) <> 0"


def normal_expr(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' '))"


def words_expr(norm: str) -> str:
    return f"filter(split({norm}, ' '), w -> w <> '')"
