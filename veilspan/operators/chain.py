"""The whole way from a text to a safe one, in the row: find, trim, judge, grow aliases to a fixpoint, date, render.

Seeds are what the rules find (values trimmed of what follows them), names that their surroundings
give away, names that a dictionary recalls, dates, and a model's spans if there are any. Then passes
repeat: all spans are merged, guards judge them, and names that stay give aliases, whose repeats, and
capitalised pairs with a known surname, are spans of the next pass. A fold carries the spans from pass
to pass and stops working when they no longer change. A text's spans never leave its row: nothing is
shuffled, and the plan has one pass only.

Defined cases: a null text stays null and has no spans; rows need no key; a text may have any spans of
a model, also none; passes end after :data:`PASSES` even where names would still grow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import cut, empty, fold, let, literal, plain, struct
from ..functions.rules import DIRECT_RULES, FIELD_RULES, Rule
from . import clinical, dates, people, spans
from .vocabulary import LIMIT, has_expr, kinds_expr, looked_up

#: A pass that finds the seeds' spans, and at most three that grow them.
PASSES = 4
#: Shortest surname that stands for a person by itself.
SHORTEST = 4
#: Labels whose values are cut where something else begins.
TRIMMED = (*clinical.NAME_LABELS, "ORGANIZATION", "FACILITY", "OCCUPATION")
PAIR = Rule("pair", "NAME", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b")
TITLES = r"^(?:Dr|Doctor|Mr|Mrs|Ms|Miss|Prof)\.? +"
TURNED = r"^([^,]+), *(.+)$"
PART = r"^[A-Za-z'-]{2,}$"
WORDY = r"[A-Za-z0-9_]"
_SPAN = "struct<start:bigint,end:bigint,label:string,source:string>"
_ALIAS = "struct<form:string,label:string>"
_BLANKS = literal(r"\s+")


def _span(start: str, end: str, label: str, source: str) -> str:
    return struct(start=f"cast({start} as bigint)", end=f"cast({end} as bigint)", label=label, source=source)


def _in(labels: Sequence[str]) -> str:
    return "(" + ", ".join(map(literal, labels)) + ")"


def ruled(found: str) -> str:
    """Spans of rules, trimmed where their labels ask for it."""
    whole = _span("s.start", "s.end", "s.label", "'structured'")
    short = let("cut", clinical.trimmed_expr("s.value"), _span("s.start + cut.lead", "s.start + cut.lead + length(cut.kept)", "s.label", "'structured'"))
    return f"filter(transform({found}, s -> if(s.label in {_in(TRIMMED)}, {short}, {whole})), s -> s.end > s.start)"


def ordered(found: str) -> str:
    """Spans in an order that does not depend on where they came from, so that merging does not either."""
    row = struct(p=spans.priority_expr("s.label"), label="s.label", source="s.source", start="s.start", s="s")
    return f"transform(sort_array(transform({found}, s -> {row})), x -> x.s)"


def positions(text: str, value: str, label: str) -> str:
    """Spans of a value wherever it stands as whole words."""
    before = f"if(x = '', i = 0, not right(x, 1) rlike '{WORDY}')"
    after = let("ga", "element_at(gaps, i + 2)", f"if(ga = '', i + 2 = size(gaps), not left(ga, 1) rlike '{WORDY}')")
    items = f"transform(slice(gaps, 1, size(gaps) - 1), (x, i) -> {struct(gap='cast(length(x) as bigint)', free=f'{before} and {after}')})"

    def step(at: str, x: str) -> tuple[str, str]:
        end = f"{at} + {x}.gap + length({value})"
        return end, f"if({x}.free, array({_span(f'{at} + {x}.gap', end, label, literal('alias'))}), {empty(_SPAN)})"

    gaps = rf"if(contains({text}, {value}), split({text}, concat('\\Q', {value}, '\\E'), -1), array({text}))"
    return let("gaps", gaps, fold(items, "cast(0 as bigint)", _SPAN, step, "pos"))


def forms(value: str, label: str, table: str) -> str:
    """The names that a person found as ``value`` may go by: an array of (form, label).

    The full name in either order, the surname by itself if it is long enough and no word of the
    vocabulary, and all of them in capitals.
    """
    bare = f"regexp_replace(trim(regexp_replace({value}, {_BLANKS}, ' ')), {literal(TITLES)}, '')"
    words = f"filter(split(regexp_replace({bare}, {literal(TURNED)}, '$2 $1'), ' '), w -> w rlike {literal(PART)})"
    known = let("nk", "lower(nl)", has_expr(kinds_expr(table, "nk"), "clinical", "eponym", "common", "medication"))
    own = f"if(length(nl) >= {SHORTEST} and not {known}, array(nl), {empty('string')})"
    full = f"if(size(nw) > 1, array(concat(nw[0], ' ', nl), concat(nl, ' ', nw[0]), concat(nl, ', ', nw[0])), {empty('string')})"
    each = let("ne", f"concat({full}, {own})", f"transform(concat(ne, transform(ne, x -> upper(x))), x -> {struct(form='x', label=label)})")
    return let("nw", words, f"if(size(nw) > 0, {let('nl', 'element_at(nw, -1)', each)}, {empty(_ALIAS)})")


def promoted(pairs: str, names: str) -> str:
    """Capitalised pairs of words whose second word is the last word of a known name, or, if long, one letter from it."""
    close = "exists(kl, k -> k = po or (length(k) >= 7 and levenshtein(k, po, 1) >= 0))"
    last = f"array_distinct(transform(filter({names}, n -> contains(n.form, ' ')), n -> substring_index(n.form, ' ', -1)))"
    kept = f"filter({pairs}, p -> {let('po', last_word('p.value'), close)})"
    return let("kl", last, f"transform({kept}, p -> {_span('p.start', 'p.end', literal('NAME'), literal('alias'))})")


def last_word(x: str) -> str:
    return f"substring_index({x}, ' ', -1)"


def _judged(text: str, found: str, before: str, table: str, bare: str | None = None) -> str:
    """(s, becomes) of each span, becomes being its label after the guards, null if it goes. Spans that ``before`` holds are not judged again."""
    old = f"transform({before}, j -> {struct(s='j.s', new='false', becomes='j.becomes')})"
    new = f"transform({found}, s -> {struct(s='s', new='true', becomes='cast(null as string)')})"
    last = f"transform(jl, (x, i) -> {struct(s='x.s', new='x.new', last='if(i > 0, jl[i - 1], null)')})"
    becomes = f"if(not y.last.new and y.last.s = y.s, y.last.becomes, {clinical.becomes_expr(text, 'y.s', table, bare)})"
    each = f"transform(filter({last}, y -> y.new), y -> {struct(s='y.s', becomes=becomes)})"
    return let("jl", f"sort_array(concat({old}, {new}))", each)


def grown(text: str, seeds: str, pairs: str, table: str, passes: int = PASSES, bare: str | None = None) -> str:
    """The spans that the passes leave, disjoint and in order: an array of (start, end, label, source).

    What a pass finds follows from the names that it starts with, so the passes end where these stay the
    same; a span that the last pass merged to is not judged anew.
    """
    value = cut(text, "s.start", "s.end - s.start", bare)
    persons = f"array_distinct(transform(filter(st.spans, s -> s.label in {_in(clinical.NAME_LABELS)}), s -> {struct(value=value, label='s.label')}))"
    names = f"array_distinct(flatten(transform({persons}, p -> {forms('p.value', 'p.label', table)})))"
    all_ = f"concat({seeds}, flatten(transform(nn, a -> {positions(text, 'a.form', 'a.label')})), {promoted(pairs, 'nn')})"
    merged = spans.merged_expr(ordered(all_), text)
    slim = f"transform({merged}, s -> {_span('s.start', 's.end', 's.label', 's.source')})"
    stay = f"transform(filter(nj, j -> j.becomes is not null), j -> {_span('j.s.start', 'j.s.end', 'j.becomes', 'j.s.source')})"
    after = let("nj", _judged(text, slim, "st.judged", table, bare), struct(spans=stay, names="nn", judged="nj", still="false"))
    same = struct(spans="st.spans", names="st.names", judged="st.judged", still="true")
    step = f"if(st.still, st, {let('nn', names, f'if(coalesce(nn = st.names, false), {same}, {after})')})"
    start = struct(spans=empty(_SPAN), names=f"cast(null as array<{_ALIAS}>)", judged=empty(f"struct<s:{_SPAN},becomes:string>"), still="false")
    return f"aggregate(sequence(1, {passes}), {start}, (st, n) -> {step}, st -> st.spans)"


def deidentify(
    docs: DataFrame, vocabulary: DataFrame, text: str = "text", reference: Column | None = None, admitted: Column | None = None,
    rules: Sequence[Rule] | None = None, model: str | None = None, mode: str = "hybrid", limit: int = LIMIT, passes: int = PASSES,
) -> DataFrame:
    """``docs`` with ``text`` made safe and a column ``spans`` of (start, end, label, source, placeholder).

    ``vocabulary(term, kind)`` is compiled; ``reference`` is the day that dates without a year are near
    to, today unless given, ``admitted`` the day that the timeline starts from, if it is known. ``model``
    names a column with a model's spans (start, end, label); ``mode`` says whether rules, the model, or
    both find spans.
    """
    if mode not in ("structured", "model", "hybrid") or (mode == "model" and model is None):
        raise ValueError(f"mode {mode} with{'out' if model is None else ''} a model")
    rules = FIELD_RULES + DIRECT_RULES if rules is None else rules
    own = docs.columns
    reference = F.current_date() if reference is None else reference
    unruled = lambda found, label="s.label", source="structured": f"transform({found}, s -> {_span('s.start', 's.end', label, literal(source))})"
    columns = {"_pairs": spans.find(text, [PAIR]), "_dates": dates.timed(text, reference, admitted, "_bare")}
    seeds = []
    if mode != "model":
        columns["_ruled"] = F.expr(f"concat({ruled(spans.find_expr(text, rules))}, {unruled(spans.find_expr(text, people.CONTEXT_RULES))})")
        seeds += ["_ruled", unruled("_dates", "if(s.context = 'birth', 'DOB', 'DATE')"), unruled("_recalled", "'NAME'")]
    if model is not None and mode != "structured":
        seeds.append(unruled(f"coalesce({model}, {empty('struct<start:bigint,end:bigint,label:string>')})", source="model"))
    found = docs.withColumn("_bare", F.expr(plain(text))).withColumns(columns)
    if mode != "model":  # a step of its own: the analyser goes no deeper into one expression
        recalled = lambda voc: let("bare", "_bare", f"filter({people.evidence_expr(text, voc, 1, 'bare')}, s -> s.score >= {people.LEAST})")
        found = looked_up(found, vocabulary, "_recalled", recalled, limit)
    kept = looked_up(found, vocabulary, "spans", lambda voc: let("pairs", "_pairs", let("seeds", f"concat({', '.join(seeds)})", let("bare", "_bare", grown(text, "seeds", "pairs", voc, passes, "bare")))), limit)
    place = "get(filter(_dates, d -> d.start = s.start and d.end = s.end), 0).label"
    shown = f"transform(spans, s -> {struct(start='s.start', end='s.end', label='s.label', source='s.source', placeholder=f'if(s.label in {_in(('DATE', 'DOB'))}, coalesce({place}, s.label), s.label)')})"
    kept = kept.withColumn("spans", F.expr(f"if({text} is null, null, {shown})"))
    safe = let("bare", "_bare", spans.splice_expr(text, f"transform(spans, s -> {struct(start='s.start', end='s.end', label='s.placeholder')})", "bare"))
    return kept.withColumn(text, dates.renamed_fields(F.expr(f"if({text} is null, null, {safe})"))).select(*own, "spans")
