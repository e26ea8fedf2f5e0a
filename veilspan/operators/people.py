"""Persons in text: names parsed, recovered from context and dictionaries, and promoted where they were left over.

Dictionaries are tables or lists that the caller gives; words are compared in lower case. Names that
are null or blank parse to empty parts. All that looks at a text works in its row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import cut, empty, fold, let, literal, struct
from ..functions.rules import Rule
from . import clinical, spans, vocabulary

_PART = r"[A-Z][a-z]+(?:['-][A-Z][a-z]+)*"
_FULL = rf"{_PART}(?: [A-Z]\.)? {_PART}"
_AGED = r",? (?:who )?(?:is|was)? ?(?:an? )?[0-9]{1,3}(?:[- ]years?[- ]old|[ -]?y/?o)\b"
_RELATIVE = "mother|father|sister|brother|daughter|son|wife|husband|partner|neighbor"
#: Names by what stands before and after them.
CONTEXT_RULES = [
    Rule(name, label, rf"({before})({value})({after})", field=True, tail=True, words=words)
    for name, label, before, value, after, words in (
        ("honorific_age", "PATIENT NAME", r"\b", rf"(?:Mr|Mrs|Ms|Miss)\.? {_PART}(?: {_PART})?", _AGED, ("mr", "ms", "miss")),
        ("name_age", "PATIENT NAME", r"\b", _FULL, _AGED, ("year", "yo", "y/o")),
        ("summary", "PATIENT NAME", r"\b(?:Summary|Impression|Subjective|History|HPI):[ \t]+", rf"(?:(?:Mr|Mrs|Ms)\.? )?{_FULL}", r" [a-z]+s\b", ("summary:", "impression:", "subjective:", "history:", "hpi:")),
        ("provider_verb", "PROVIDER NAME", r"\b(?i:referred to|follow[- ]?up with|appointment with|discussed with|seen by|signed by|read by|per) ", rf"(?:Dr|Doctor)\.? {_PART}(?: {_PART})?", r"", ("dr", "doctor")),
        ("contact_verb", "CONTACT NAME", r"\b(?i:spoke with|spoke to|called|phoned|updated|met with) ", _FULL, r"\b", ("spoke ", "called ", "phoned ", "updated ", "met with ")),
        ("relative", "CONTACT NAME", rf"\b(?i:{_RELATIVE}) \(?", rf"{_PART}(?: {_PART})?", r"\b", tuple(_RELATIVE.split("|"))),
    )
]


def contextual(text: str) -> Column:
    """Names that their surroundings give away: an array of (rule, label, severity, start, end, value)."""
    return spans.find(text, CONTEXT_RULES)


# ---- parsing ----------------------------------------------------------------------------------

_FOLD_FROM = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
_FOLD_TO = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"


def folded(text: Column) -> Column:
    """Latin letters without their accents."""
    return F.translate(text, _FOLD_FROM, _FOLD_TO)


def key(text: Column) -> Column:
    """The letters of a name, folded, in lower case."""
    return F.regexp_replace(F.lower(folded(text)), "[^a-z]", "")


def parsed(name: Column) -> Column:
    """(title, first, middle, surname, initials, first_key, surname_key) of a name, also one written surname first."""
    x = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    title = F.regexp_extract(x, r"^((?:Dr|Mr|Mrs|Ms|Miss|Prof)\.?) ", 1)
    bare = F.regexp_replace(x, r"^(?:Dr|Mr|Mrs|Ms|Miss|Prof)\.? ", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r",? +(?:MD|DO|RN|NP|PA|PhD|PharmD)\.?$", ""), r",? +(?:Jr|Sr|II|III|IV)\.?$", "")
    turned = F.regexp_replace(bare, r"^([^,]+), *(.+)$", "$2 $1")
    words = F.filter(F.split(turned, " "), lambda w: w != "")
    many = F.size(words) > 1
    first, surname = F.when(many, F.get(words, 0)).otherwise(""), F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))
    middle = F.when(F.size(words) > 2, F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), " ")).otherwise("")
    initials = F.array_join(F.transform(words, lambda w: F.upper(F.substr(folded(w), F.lit(1), F.lit(1)))), "")
    return F.struct(
        F.regexp_replace(title, r"\.$", "").alias("title"), first.alias("first"), middle.alias("middle"), surname.alias("surname"), initials.alias("initials"),
        key(first).alias("first_key"), key(surname).alias("surname_key"),
    )


# ---- dictionary runs --------------------------------------------------------------------------

#: Words of a text with their places; capitals decide what joins.
WORD = Rule("word", "WORD", r"[A-Za-z][A-Za-z'-]*")
#: Those of them that begin with a capital: a word starts at the first letter of a stretch of letters, quotes and dashes.
CAPITAL = Rule("capital", "WORD", r"((?=['A-Z-])(?<![A-Za-z'-])['-]*)([A-Z][A-Za-z'-]*)", True)
LONGEST = 4
#: A run of the ``n`` words up to the one of number ``upto``.
_RUN = "struct<start:bigint,end:bigint,upto:int,n:int,comma:boolean>"


def runs_expr(text: str, bare: str | None = None) -> str:
    """Runs of capitalised words that blanks or one comma join, of at most four: an array of (start, end, tokens, comma), by place."""

    def step(run: str, w: str) -> tuple[str, str]:
        gap = f"if({w}.start - {run}.end <= 4, {cut(text, f'{run}.end', f'greatest({w}.start - {run}.end, 0)', bare)}, null)"
        blank, comma = literal(r"^(?:[ \t]+|\.[ \t]+)$"), literal(r"^,[ \t]+$")
        near = f"{run}.end is not null and {w}.start - {run}.end <= 4 and {run}.n < {LONGEST}"
        joins = f"coalesce({near} and (rg rlike {blank} or (rg rlike {comma} and not {run}.comma)), false)"
        longer = struct(start=f"{run}.start", end=f"{w}.end", upto=f"{run}.upto + 1", n=f"{run}.n + 1", comma=f"({run}.comma or contains(rg, ','))")
        alone = struct(start=f"{w}.start", end=f"{w}.end", upto=f"coalesce({run}.upto, 0) + 1", n="1", comma="false")
        return let("rg", gap, f"if({joins}, {longer}, {alone})"), let("rg", gap, f"if(not {joins} and {run}.end is not null, array({run}), {empty(_RUN)})")

    words = spans.find_expr(text, [CAPITAL])
    far = let("rl", "element_at(rw, -1)", "named_struct('rule', '', 'label', '', 'severity', '', 'start', rl.end + 99, 'end', rl.end + 100, 'value', '')")  # puts out the last run
    runs = fold(f"if(size(rw) > 0, concat(rw, array({far})), rw)", f"cast(null as {_RUN})", _RUN, step, "run")
    tokens = "transform(slice(rw, r.upto - r.n + 1, r.n), w -> w.value)"
    return let("rw", words, f"transform({runs}, r -> {struct(start='r.start', end='r.end', tokens=tokens, comma='r.comma')})")


#: Points of evidence (fixed values), and what they are given for, in the facts of :mod:`clinical` and those of :func:`evidence_expr`.
POINTS = [
    (2, "full_name"), (2, "turned AND cased"), (1, "cased"), (4, "title_before OR titled"), (4, "relation_before"), (4, "explicit"), (4, "signed OR credential"), (3, "spoken"),
    (2, "acted"), (2, "aged"), (1, "possessive"), (-5, "companion_after AND NOT said_who"), (-2, "NOT vouched AND NOT cased"), (-2, "lone AND NOT vouched"), (-3, "zoned AND NOT vouched"),
]
#: Points of each word that a dictionary of names has, and of each clinical word where no title or field stands before.
PER_NAME, PER_CLINICAL = 2, -4
LEAST = 4
_POSSESSIVE = r"^'s\b"
#: Facts that the points need besides; they may name those above them.
GROUNDS = {
    "titled_or_labelled": "title_before OR titled OR explicit",
    "said_who": "titled_or_labelled OR relation_before",
    "vouched": "said_who OR signed OR credential OR spoken",
}


def evidence_expr(text: str, table: str, least_known: int = 0, bare: str | None = None) -> str:
    """Runs of :func:`runs_expr` with ``least_known`` known names or more, as (start, end, name, known, score): how many words a compiled vocabulary has as names only, and
    the points that it and the words around give."""
    known = f"filter(ew, k -> {vocabulary.has_expr('k', 'given', 'surname')} and not {vocabulary.has_expr('k', 'common')})"
    own = {
        "full_name": f"size(ew) >= 2 and {vocabulary.has_expr('ew[0]', 'given')} and {vocabulary.has_expr('element_at(ew, -1)', 'surname')}",
        "turned": "ec.comma",
        "cased": "forall(ec.tokens, t -> t rlike '^[A-Z][a-z]')",
        "possessive": f"ec.after rlike {literal(_POSSESSIVE)}",
        "lone": "size(ew) = 1 and size(en) = 0",
    }
    asked = {w for e in (*GROUNDS.values(), *(e for _, e in POINTS)) for w in re.findall(r"[a-z_]+", e)}
    wanted = [n for n in clinical.FACTS if n in asked and n != "zoned"]
    facts = struct(**own, **{n: f"ef.{n}" for n in wanted})
    names = [*own, *wanted]
    for n, expression in GROUNDS.items():
        facts = let("eo", facts, struct(**{m: f"eo.{m}" for m in names}, **{n: clinical.named_in(expression, "eo", "")}))
        names.append(n)
    medical = f"if(eg.titled_or_labelled, 0, size(filter(ew, k -> {vocabulary.has_expr('k', 'clinical')})) * {PER_CLINICAL})"
    zoned = clinical.plain_expr("ec", "zoned")  # dear, so asked for last
    late = lambda e: f"{clinical.named_in(e.removeprefix('zoned AND '), 'eg', '')} AND {zoned}" if e.startswith("zoned AND ") else clinical.named_in(e, "eg", "")
    points = " + ".join([f"size(en) * {PER_NAME}", medical, *(f"if({late(e)}, {n}, 0)" for n, e in POINTS)])
    scored = let("eg", facts, struct(start="ec.start", end="ec.end", name="array_join(ec.tokens, ' ')", known="size(en)", score=points))
    looked = f"transform({runs_expr(text, bare)}, r -> {struct(start='r.start', end='r.end', tokens='r.tokens', comma='r.comma', bits='transform(r.tokens, w -> ' + let('lw', 'lower(w)', vocabulary.kinds_expr(table, 'lw')) + ')')})"
    if least_known:
        looked = f"filter({looked}, r -> size({known.replace('ew', 'r.bits')}) >= {least_known})"
    body = let("ew", "ec.bits", let("en", known, let("ef", clinical.signals_expr("ec", table, wanted), scored)))
    keep = {"start": "er.start", "end": "er.end", "tokens": "er.tokens", "comma": "er.comma", "bits": "er.bits", "label": "'NAME'", "source": "'dictionary'"}
    return f"transform({looked}, er -> {let('ec', clinical.context_expr(text, 'er', keep, bare=bare), body)})"


# ---- what is left over ------------------------------------------------------------------------


def promoted(found: DataFrame, left: DataFrame, key_: str = "doc_id") -> DataFrame:
    """``(key, name, reason)``: capitalised runs of ``left(key, name)`` that share a surname with a found name, or are one edit from it.

    ``found(key, name)``. Surnames of under seven letters must be equal.
    """
    own = found.select(F.col(key_), key(F.substring_index("name", " ", -1)).alias("_s")).where("_s <> ''").distinct()
    names = own.groupBy(key_).agg(F.collect_set("_s").alias("_known"))
    each = left.select(key_, "name", key(F.substring_index("name", " ", -1)).alias("_k")).where("_k <> ''").join(names, key_)
    close = F.exists("_known", lambda s: (F.length(s) >= 7) & (F.levenshtein(s, F.col("_k"), 1) >= 0))
    reason = F.when(F.array_contains("_known", F.col("_k")), "alias").when(close, "fuzzy")
    return each.select(key_, "name", reason.alias("reason")).where("reason is not null").distinct()


def dictionary(counts: DataFrame, clinical_words: Sequence[str], common: DataFrame, least: int = 500, most_rank: int = 60_000) -> DataFrame:
    """``(token, n, ambiguous)`` of ``counts(token, n)``: clean words that occur often enough; short, clinical, eponymous and common words are ambiguous.

    ``common(token, rank)`` ranks everyday words.
    """
    word = F.lower(F.trim("token"))
    kept = counts.where(word.rlike("^[a-z][a-z'-]+$")).groupBy(word.alias("token")).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    everyday = common.where(F.col("rank") <= most_rank).select(F.lower("token").alias("token")).distinct().withColumn("_c", F.lit(True))
    odd = (F.length("token") <= 3) | F.col("token").isin(*clinical_words) | F.col("token").isin(*clinical.EPONYMS) | F.col("_c").isNotNull()
    return kept.join(everyday, "token", "left").select("token", "n", odd.alias("ambiguous"))


def vocabulary_of(sources: Sequence[DataFrame], banned: Sequence[str], least: int = 2, most: int = 40) -> DataFrame:
    """``(token, sources)``: the words of all ``sources(name)``, of a fit length, without banned ones, and how many sources have them."""
    out = None
    for i, rows in enumerate(sources):
        each = rows.select(F.explode(F.split(F.lower("name"), "[^a-z0-9]+")).alias("token"), F.lit(i).alias("i"))
        out = each if out is None else out.union(each)
    fit = F.length("token").between(least, most) & ~F.col("token").isin(*banned) & ~F.col("token").rlike("^[0-9]+$")
    return out.where(fit).groupBy("token").agg(F.count_distinct("i").alias("sources"))


def anchors(words: DataFrame, banned: Sequence[str], endings: str = "(?:itis|osis|emia|oma|pathy|ectomy)$") -> DataFrame:
    """``(token, strong)`` of ``words(token)``: those not banned; strong by their ending."""
    return words.where(~F.col("token").isin(*banned)).select("token", F.col("token").rlike(endings).alias("strong"))
