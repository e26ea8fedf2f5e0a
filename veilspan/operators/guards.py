"""Predicates that keep clinical wording from being taken for identifiers, and parts of person names.

The patterns use only what both Java's and RE2's engines know.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
#: A date span that says no day: a month alone, an ordinal with a month, a clock time, an age.
NO_DAY = rf"(?i)^(?:(?:{MONTHS})|[0-9]{{1,2}}(?:st|nd|rd|th) (?:of )?(?:{MONTHS})|[0-9]{{1,2}}:[0-9]{{2}}|age[d]? [0-9]{{1,3}})$"
#: Two short numbers that may be a range or a decimal rather than a day and month.
RANGE = r"^[0-9]{1,2}[-.][0-9]{1,2}$"
DATE_CONTEXT = r"(?i)(?:on|dated|since|from|until|seen|admitted)[: ]+$"
DURATION = r"(?i)\bfor (?:the (?:past|last) )?(?:[0-9]+|a|several) (?:hour|day|week|month|year)s?(?: of [a-z]+)?\b"
DOSAGE = r"(?i)\b[0-9]+(?:\.[0-9]+)? ?(?:mg|mcg|g|ml|units?|tabs?)\b|\b(?:po|iv|bid|tid|qid|qhs|prn|daily)\b"
NAME_CONTEXT = r"(?i)(?:\b(?:mr|mrs|ms|dr|prof)\.? |\b(?:patient|name|seen by|signed by|daughter|son|wife|husband)[: ]+)$"
TITLE = r"^(Dr|Mr|Mrs|Ms|Prof)\.? "
SUFFIX = r",? (?:Jr|Sr|II|III|IV)\.?$"
CREDENTIAL = r", (?:MD|DO|RN|NP|PA|PhD)$"
PLACEHOLDER = r"\[([A-Z][A-Z /-]*)\]"


def date_false_positive(span: Column, before: Column) -> Column:
    """Whether a span that looks like a date is none: it names no day, or is a range without a word of date before it."""
    return span.rlike(NO_DAY) | (span.rlike(RANGE) & ~before.rlike(DATE_CONTEXT))


def name_parts(name: Column) -> Column:
    """title, first, middle, surname and key of a person's name, without suffix and credentials; missing parts are empty."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(name), CREDENTIAL, ""), SUFFIX, ""), TITLE, "")
    words = F.filter(F.split(bare, " +"), lambda w: w != "")
    many = F.size(words) > 1
    surname = F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))
    return F.struct(
        F.regexp_extract(F.trim(name), TITLE, 1).alias("title"),
        F.when(many, words[0]).otherwise("").alias("first"),
        F.when(many, F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), " ")).otherwise("").alias("middle"),
        surname.alias("surname"),
        F.regexp_replace(F.lower(surname), "[^a-z]", "").alias("key"),
    )


def alias_variants(identities: DataFrame) -> DataFrame:
    """Rows ``(doc_id, alias, strong)`` of identities ``(doc_id, title, first, surname)``.

    A first name alone is weak; a surname alone is weak unless it is hyphenated or of nine letters or
    more. The strong form of an alias wins over a weak one.
    """
    full = F.concat_ws(" ", "first", "surname")
    long = F.col("surname").contains("-") | (F.length("surname") >= 9)
    forms = F.array(
        F.struct(full.alias("alias"), F.lit(True).alias("strong")),
        F.struct(F.when(F.col("title") != "", F.concat_ws(" ", "title", "surname")).alias("alias"), F.lit(True).alias("strong")),
        F.struct(F.col("first").alias("alias"), F.lit(False).alias("strong")),
        F.struct(F.col("surname").alias("alias"), long.alias("strong")),
    )
    each = identities.select("doc_id", F.explode(forms).alias("f")).select("doc_id", "f.*").where("alias <> ''")
    return each.groupBy("doc_id", "alias").agg(F.max("strong").alias("strong"))


def placeholders(docs: DataFrame, known: list[str]) -> DataFrame:
    """``(doc_id, label, known, times)``: bracketed labels of already safe texts."""
    each = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(1))).alias("label"))
    return each.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("times")).withColumn("known", F.col("label").isin(*known))


def neighbours(tokens: DataFrame, before: int = 4) -> DataFrame:
    """``tokens(doc_id, n, token)`` with the tokens before, joined, and the next one."""
    w = Window.partitionBy("doc_id").orderBy("n")
    lead = F.concat_ws(" ", *[F.lag("token", i).over(w) for i in range(before, 0, -1)])
    return tokens.select("doc_id", "n", "token", lead.alias("before"), F.coalesce(F.lead("token").over(w), F.lit("")).alias("next"))


def reconcile(defaults: DataFrame, stored: DataFrame, legacy: str) -> DataFrame:
    """Defaults with the first stored text of their token, then stored rows of other tokens; tokens that match ``legacy`` go.

    ``defaults(token, text)``, ``stored(token, text, ord)``.
    """
    first = stored.groupBy("token").agg(F.min_by("text", "ord").alias("own"))
    seeded = defaults.join(first, "token", "left").select("token", F.coalesce("own", "text").alias("text"), F.lit(True).alias("is_default"))
    custom = first.join(defaults, "token", "left_anti").where(~F.col("token").rlike(legacy))
    return seeded.union(custom.select("token", F.col("own").alias("text"), F.lit(False).alias("is_default")))
