"""SQL of the guards: what stands around spans, facts, verdicts and points, in the conditions that the operators state."""

from __future__ import annotations

import re

from ..operators import clinical, people, vocabulary
from ..sources.corpus import FIRST, LAST
from .span_queries import _kind_sql


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def vocabulary_sql(lists: dict) -> str:
    """``(term, kind)`` of lists by kind."""
    return "SELECT * FROM (VALUES " + ", ".join(f"({text(t)}, '{k}')" for k, words in lists.items() for t in words) + ") v(term, kind)"


#: The base vocabulary with the names of the made-up notes; grant is also a word.
NAMED = clinical.BASE | {"given": FIRST, "surname": LAST, "common": ["grant"]}
NAMED_VOCABULARY = vocabulary_sql(NAMED)


def named_vocabulary(spark):
    return vocabulary.terms(spark, NAMED)


_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_HAS = lambda x, which: f"({x} & {vocabulary.bit(*which)}) <> 0"
_WORDS = lambda x: f"list_filter(string_split({x}, ' '), lambda y: y <> '')"
_LOOK = lambda x: f"coalesce(m[{x}], 0)"


def ctx_sql(found: str, docs: str) -> str:
    """All columns of ``found`` with what stands around each span in its text."""
    left = lambda n: f"substr(text, CAST(greatest(f.\"start\" - {n}, 0) + 1 AS INTEGER), CAST(least(f.\"start\", {n}) AS INTEGER))"
    right = lambda n: f"substr(text, CAST(f.\"end\" + 1 AS INTEGER), {n})"
    inner = 'substr(text, CAST(f."start" + 1 AS INTEGER), CAST(f."end" - f."start" AS INTEGER))'
    return f"""SELECT *, {_NORM.format('span')} AS norm, prefix || string_split("inner", chr(10))[1] || string_split(r400, chr(10))[1] AS line FROM (
      SELECT f.*, trim(regexp_replace({inner}, '\\s+', ' ', 'g')) AS span, {inner} AS "inner", {left(80)} AS before, {right(80)} AS after, {right(400)} AS r400,
        string_split({left(400)}, chr(10))[-1] AS prefix, {left(400)} || {inner} || {right(400)} AS around FROM {found} f JOIN {docs} d ON d.doc_id = f.doc_id)"""


def facts_sql(found: str, docs: str, vocab: str) -> str:
    """All columns of ``found(doc_id, start, end, label, source)`` with context and a column for each fact."""
    bits = "CASE kind " + " ".join(f"WHEN '{k}' THEN {vocabulary.bit(k)}" for k in vocabulary.KINDS) + " END"
    table = f"(SELECT map_from_entries(list({{'k': term, 'v': kinds}})) AS m FROM (SELECT {_NORM.format('term')} AS term, bit_or({bits}) AS kinds FROM {vocab} GROUP BY 1))"
    near = f"""SELECT c.*, m, {_LOOK('norm')} AS k_p, list_transform({_WORDS('norm')}, lambda w: {_LOOK('w')}) AS k_w,
      {_LOOK("coalesce(" + _WORDS(_NORM.format("string_split(before, chr(10))[-1]")) + "[-1], '')")} AS k_b, {_LOOK("coalesce(" + _WORDS(_NORM.format("regexp_replace(after, '^''s', '')")) + "[1], '')")} AS k_a
      FROM ({ctx_sql(found, docs)}) c, {table} t"""
    names = ", ".join(f"'{n}'" for n in clinical.NAME_LABELS)
    made = {
        "is_name": f"label IN ({names})", "model": "contains(coalesce(source, ''), 'model')", "in_place": "label IN ('LOCATION', 'ORGANIZATION', 'FACILITY')", "many_words": "len(k_w) > 2",
        "young": "label = 'AGE' AND coalesce(TRY_CAST(regexp_extract(span, '[0-9]{1,3}') AS INTEGER), 0) < 90", "tiny": "length(span) <= 2", "zoned": f"{_kind_sql('line')} IN ('lab', 'vitals', 'meds', 'imaging')",
    }
    asked = lambda n: f"label IN ({', '.join(map(text, clinical.ONLY[n]))}) AND " if n in clinical.ONLY else ""
    made |= {n: f"{asked(n)}regexp_matches({field}, {text(p)})" for n, (field, p) in clinical.PATTERNS.items()}
    for n, (of, how, which) in clinical.WORDS.items():
        some = f"len(list_filter(k_w, lambda x: {_HAS('x', which)}))"
        made[n] = {"all": f"len(k_w) > 0 AND {some} = len(k_w)", "any": f"{some} > 0", "last": _HAS("coalesce(k_w[-1], 0)", which)}.get(how) or _HAS(f"k_{of}", which)
    out = f"SELECT *, {', '.join(f'({e}) AS f_{n}' for n, e in made.items())} FROM ({near})"
    for n, e in clinical.DERIVED.items():
        out = f"SELECT *, ({fact_names(e)}) AS f_{n} FROM ({out})"
    return out


def fact_names(expression: str) -> str:
    """An expression over facts with the columns' names."""
    word = lambda m: m[0] if m[0] in ("NOT", "AND", "OR", "IN", "label") or m[0].startswith("'") else f"f_{m[0]}"
    return re.sub(r"'[^']*'|[A-Za-z_]+", word, expression)


REASON = "CASE " + " ".join(f"WHEN {fact_names(test)} THEN '{name}'" for name, _, test in clinical.CASES) + " ELSE 'keep' END"
NAMED_AS = "CASE " + " ".join(f"WHEN {fact_names(test)} THEN '{becomes}'" for becomes, test in clinical.LABELS) + " ELSE label END"
BECOMES = "CASE reason " + " ".join(f"WHEN '{name}' THEN '{becomes}'" for name, becomes, _ in clinical.CASES if becomes != "drop") + " WHEN 'keep' THEN named END"


def judged_sql(found: str, docs: str, vocab: str) -> str:
    """:func:`facts_sql` with ``reason`` and ``becomes``, the label that a span has then, null if it goes."""
    return f"SELECT *, {BECOMES} AS becomes FROM (SELECT *, {REASON} AS reason, {NAMED_AS} AS named FROM ({facts_sql(found, docs, vocab)}))"


def evidence_sql(found: str, docs: str, vocab: str) -> str:
    """A CTE ``scored``: ``found`` (with tokens and comma) and its points."""
    known = f"len(list_filter(low, lambda k: {_HAS('k', ('given', 'surname'))} AND NOT {_HAS('k', ('common',))}))"
    own = {
        "full_name": f"len(low) >= 2 AND {_HAS('low[1]', ('given',))} AND {_HAS('low[-1]', ('surname',))}", "turned": "comma", "cased": "len(list_filter(tokens, lambda t: regexp_matches(t, '^[A-Z][a-z]'))) = len(tokens)",
        "possessive": "regexp_matches(after, '^''s\\b')", "lone": f"len(low) = 1 AND {known} = 0",
    }
    out = f"SELECT *, list_transform(tokens, lambda w: {_LOOK('lower(w)')}) AS low FROM ({facts_sql(found, docs, vocab)})"
    out = f"SELECT *, {known} AS known, {', '.join(f'({e}) AS f_{n}' for n, e in own.items())} FROM ({out})"
    for n, e in people.GROUNDS.items():
        out = f"SELECT *, ({fact_names(e)}) AS f_{n} FROM ({out})"
    medical = f"CASE WHEN f_titled_or_labelled THEN 0 ELSE len(list_filter(low, lambda k: {_HAS('k', ('clinical',))})) * {people.PER_CLINICAL} END"
    points = " + ".join([f"known * {people.PER_NAME}", medical, *(f"CASE WHEN {fact_names(e)} THEN {n} ELSE 0 END" for n, e in people.POINTS)])
    return f"scored AS MATERIALIZED (SELECT *, {points} AS score FROM ({out}))"


TRIMMED = f"""SELECT *, length(regexp_extract(value, {text(clinical.LEAD)})) AS lead, substr(value, length(regexp_extract(value, {text(clinical.LEAD)})) + 1) AS rest FROM"""
KEPT = (
    f"regexp_replace(substr(rest, 1, length(regexp_replace(regexp_replace(rest, {text(clinical.DOTTED)}, '\\1~', 'g'), {text(clinical.END)}, ''))), {text(clinical.POINTS_OFF)}, '')"
)
