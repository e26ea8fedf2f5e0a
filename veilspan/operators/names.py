"""Names: dictionary recall by weighted evidence, aliases and their repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import settled

THRESHOLD = 4
HONORIFICS = ("mr", "mrs", "ms", "dr", "prof")
FIELDS = ("patient", "name", "contact", "provider")


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n, token)``: the words of each text."""
    return docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z'-]*"), F.lit(0))).alias("n", "token"))


def recall(docs: DataFrame, given: DataFrame, surnames: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of words whose evidence reaches the threshold: ``(key, n, name, score)``.

    Each dictionary word gives 2, the shape of a full name 2, capitals 1, a title or field before 4.
    The dictionaries ``given(token)`` and ``surnames(token)`` are joined by the lower-cased word.
    """
    # neighbours are paired in the row, and only capitalised pairs become rows
    words = F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z'-]*"), F.lit(0))
    cased = lambda x: F.coalesce(x.rlike("^[A-Z]"), F.lit(False))
    near = lambda t, i: F.struct(i.alias("n"), t.alias("token"), F.get("_w", i + 1).alias("second"), F.lower(F.get("_w", i - 1)).alias("before"))
    pairs = F.filter(F.transform("_w", near), lambda p: cased(p.token) & cased(p.second))
    t = docs.select(key, words.alias("_w")).select(key, F.inline(pairs))
    mark = lambda d, c: d.select(F.lower("token").alias(c)).distinct().withColumn(f"is_{c}", F.lit(2))
    t = t.withColumns({"g": F.lower("token"), "s": F.lower("second")}).join(mark(given, "g"), "g", "left").join(mark(surnames, "s"), "s", "left")
    full = F.when(F.col("is_g").isNotNull() & F.col("is_s").isNotNull(), 2).otherwise(0)
    caps = F.when(F.col("token").rlike("^[A-Z][a-z]") & F.col("second").rlike("^[A-Z][a-z]"), 1).otherwise(0)
    lead = F.when(F.col("before").isin(*HONORIFICS, *FIELDS), 4).otherwise(0)
    score = F.coalesce("is_g", F.lit(0)) + F.coalesce("is_s", F.lit(0)) + full + caps + lead
    return t.withColumn("score", score).where(F.col("score") >= THRESHOLD).select(key, "n", F.concat_ws(" ", "token", "second").alias("name"), "score")


def aliases(names: DataFrame, key: str = "doc_id", name: str = "name") -> DataFrame:
    """``(key, alias, strong)``: the full name, and the surname, which is strong from nine letters on."""
    last = F.element_at(F.split(name, " "), -1)
    full = F.struct(F.col(name).alias("alias"), F.lit(True).alias("strong"))
    short = F.struct(last.alias("alias"), (F.length(last) >= 9).alias("strong"))
    each = names.select(key, F.explode(F.array(full, short)).alias("a")).select(key, "a.*")
    return each.groupBy(key, "alias").agg(F.max("strong").alias("strong"))


def repeats(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, alias, times)``: how often each alias stands as a whole word in its own text.

    The aliases of a key meet its text once, as a set. Keys that are null have no aliases.
    """
    each = found.groupBy(key).agg(F.collect_set("alias").alias("_aliases"))
    pattern = lambda a: F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), a, F.lit(r"\E(?![A-Za-z0-9_])"))
    counted = F.transform("_aliases", lambda a: F.struct(a.alias("alias"), F.regexp_count(text, pattern(a)).cast("long").alias("times")))
    return docs.select(key, text).join(each, key).select(key, F.inline(counted)).where("times > 0")


def near(rows: DataFrame, id_: str, name: str, group: str) -> DataFrame:
    """Pairs ``(a, b)`` of ids of a group whose names are at most one edit apart, the smaller first.

    Names that are one edit apart share the name or a form of it that lacks one letter, so rows meet
    by group and form; no group is compared pair by pair.
    """
    n = F.col(name)
    lacking = F.transform(F.sequence(F.lit(1), F.length(n)), lambda i: F.concat(F.substr(n, F.lit(1), i - 1), F.substr(n, i + 1)))
    forms = F.array_distinct(F.concat(F.array(n), F.when(F.length(n) > 0, lacking).otherwise(F.array().cast("array<string>"))))
    each = rows.where(n.isNotNull()).select(F.col(group).alias("_g"), F.col(id_).alias("_id"), n.alias("_name"), F.explode(forms).alias("_form"))
    a, b = (each.select("_g", "_form", F.col("_id").alias(x), F.col("_name").alias(f"{x}_name")) for x in "ab")
    met = a.join(b, ["_g", "_form"]).where("a < b").where(F.levenshtein("a_name", "b_name", 1) >= 0)
    return met.select("a", "b").distinct()


def fixpoint(docs: DataFrame, seeds: DataFrame, grow, rounds: int = 3, key: str = "doc_id") -> DataFrame:
    """Names that ``grow(docs, names)`` adds to the seeds, until a round adds none, at most ``rounds`` times.

    Each round is written to the shared folder, so that the next one does not run it again. A last
    round that still adds names is an error: raise ``rounds``, or bound what ``grow`` adds.
    """
    names = settled(seeds.select(key, "name").distinct())
    have = names.count()
    for _ in range(rounds):
        names = settled(names.union(grow(docs, names).select(key, "name")).distinct())
        now = names.count()
        if now == have:
            return names
        have = now
    if names.union(grow(docs, names).select(key, "name")).distinct().count() != have:
        raise RuntimeError(f"names have not settled in {rounds} rounds")
    return names


def same_surname(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, name)``: capitalised pairs of words of a text whose second word is the surname of a name already found there."""
    pairs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"), F.lit(0)))
    surnames = found.groupBy(key).agg(F.collect_set(F.element_at(F.split("name", " "), -1)).alias("_s"))
    each = docs.select(key, pairs.alias("_p")).join(surnames, key)
    return each.select(key, F.explode(F.filter("_p", lambda p: F.array_contains("_s", F.substring_index(p, " ", -1)))).alias("name"))
