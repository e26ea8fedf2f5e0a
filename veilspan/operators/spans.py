"""Detection, algebra and rendering of half-open code-point spans, in DataFrame functions.

Finding, merging and splicing work inside the row, on arrays: no key is needed, nothing is shuffled,
and rows without an id or of one id keep their own spans. The functions of tables (:func:`detect`,
:func:`overlaps`, :func:`containing`) explode these arrays where spans meet other tables.

Defined cases: a null text has no spans and stays null; rules report in their order, matches of one
rule do not overlap; spans that end where they start, or have a null end, are dropped by merging; a
null key names a row like any other in :func:`detect`, and joins nothing in the joins of tables.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import cut, empty, fold, let, literal, struct
from ..functions.rules import PRIORITY, Rule, in_lines, sought

#: Width of the bins that spans are cut into for overlap joins.
BIN = 4096
_PIECE = "struct<at:bigint,line:string,low:string,lead:string>"
#: What stands in a line before its last colon, equals or number sign.
_LEAD = r"(?s)^(.*)[:=#]"
#: A sign that marks the matches in a text that does not hold it: a text is split by a pattern only if it does, as a pattern is compiled for each split.
_MARK = "'\\u0001'"
FOUND = "struct<rule:string,label:string,severity:string,start:bigint,end:bigint,value:string>"


def _contains(text: str, words: Sequence[str]) -> str:
    """Whether a text holds one of the words. As a pattern, a longer word is looked for in steps of its length."""
    return "(" + " or ".join(f"{text} rlike {literal(w)}" if re.fullmatch("[a-z0-9 ]{5,}", w) else f"contains({text}, {literal(w)})" for w in words) + ")"


def hits_expr(text: str, rules: Sequence[Rule]) -> str:
    """Matches of rules with what lies between them, and ``at``, the place that the first gap begins from.

    A text without a match of a rule is searched once, or not at all if it lacks the rule's words. Where a rule matches within lines,
    only lines that have its words are searched. Rules that ask for the same share what they search: ``lg``.
    """
    asks = lambda r: (r.needs, r.words, r.shape, r.before)
    lined = lambda r: bool(r.needs or r.words or r.shape) and "\n" not in r.needs + "".join(r.words) and in_lines(r.pattern)
    groups = {a: f"g{n}" for n, a in enumerate(dict.fromkeys(asks(r) for r in rules if lined(r)))}
    worded = any(r.words for r in rules)

    def lines_of(needs: str, words: Sequence[str], shape: str, before: bool) -> str:
        first = [f"contains(t, {literal(needs)})"] * bool(needs) + [_contains("th" if before else "tl", words)] * bool(words)
        each = [f"contains(l.line, {literal(needs)})"] * bool(needs) + [_contains("l.lead" if before else "l.low", words)] * bool(words) + [f"l.line rlike {literal(shape)}"] * bool(shape)
        return f"if({' and '.join(first) or 'true'}, filter(ls, l -> {' and '.join(each)}), {empty(_PIECE)})"

    def one(r: Rule) -> str:
        p = literal(sought(r.pattern))
        row = struct(
            rule=literal(r.name), label=literal(r.label), severity=literal(r.severity), at="l.at", gap="cast(length(g) as bigint)", width="cast(length(x) as bigint)",
            value=f"regexp_extract(x, {p}, 2)" if r.field else "x", back=f"cast({f'length(regexp_extract(x, {p}, 3))' if r.tail else '0'} as bigint)",
        )
        found = f"flatten(transform(filter(array(regexp_extract_all(l.line, {p}, 0)), m -> size(m) > 0), m -> zip_with(m, slice(if(tm, split(l.line, {p}, -1), split(regexp_replace(l.line, {p}, {_MARK}), {_MARK}, -1)), 1, size(m)), (x, g) -> {row})))"
        holds = [f"contains(t, {literal(r.needs)})"] * bool(r.needs) + [_contains("tl", r.words)] * bool(r.words)
        pieces = f"lg.{groups[asks(r)]}" if asks(r) in groups and lined(r) else f"if({' and '.join(holds)}, tw, {empty(_PIECE)})" if holds else "tw"
        return f"flatten(transform({pieces}, l -> {found}))"

    hits = let("tw", f"array({struct(at='cast(0 as bigint)', line='t', low='tl', lead='tl')})", f"concat({', '.join(map(one, rules))})")
    if groups:
        hits = let("lg", struct(**{g: lines_of(*a) for a, g in groups.items()}), hits)
        if any(r.before for r in rules):
            hits = let("th", "array_join(transform(ls, l -> l.lead), '\\n')", hits)
        lead = f"lower(regexp_extract(x, {literal(_LEAD)}, 1))" if any(r.before for r in rules) else "''"
        row = struct(at="at", line="x", low="lower(x)" if worded else "''", lead=lead)
        begins = fold("fl", "cast(0 as bigint)", "bigint", lambda at, x: (f"{at} + length({x}) + 1", f"array({at})"), "line")
        lines = let("fl", "split(t, '\\n', -1)", f"zip_with(fl, {begins}, (x, at) -> {row})")
        hits = let("ls", lines, hits)
    return let("t", f"coalesce({text}, '')", let("tl", "lower(t)" if worded else "''", let("tm", f"contains(t, {_MARK})", hits)))


def find_expr(text: str, rules: Sequence[Rule]) -> str:
    """Spans of all rules in a text, as SQL text: an array of (rule, label, severity, start, end, value)."""

    def place(state: str, x: str) -> tuple[str, str]:
        end = f"if({x}.rule = {state}.rule and {x}.at = {state}.piece, {state}.at, {x}.at) + {x}.gap + {x}.width"
        return struct(rule=f"{x}.rule", piece=f"{x}.at", at=end), f"array({end})"

    ends = fold("fh", struct(rule="''", piece="cast(0 as bigint)", at="cast(0 as bigint)"), "bigint", place, "find")
    # the value is what a field's match ends with, but for its tail
    row = struct(rule="x.rule", label="x.label", severity="x.severity", start="e - x.back - length(x.value)", end="e - x.back", value="x.value")
    return let("fh", hits_expr(text, rules), f"zip_with(fh, {ends}, (x, e) -> {row})")


def find(text: str, rules: Sequence[Rule]) -> Column:
    """:func:`find_expr` as a Column. ``text`` is a column's name, or SQL."""
    return F.expr(find_expr(text, rules))


def detect(docs: DataFrame, rules: Sequence[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of all rules: ``(key, rule, label, severity, start, end, value)``, a row for each, without a shuffle."""
    return docs.select(key, F.inline(find(text, rules)))


def priority(label: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(x) for x in PRIORITY]), label)
    return F.when(at > 0, at).otherwise(len(PRIORITY) + 1)


def priority_expr(label: str) -> str:
    return f"coalesce(nullif(array_position(array({', '.join(map(literal, PRIORITY))}), {label}), 0), {len(PRIORITY) + 1})"


MERGED = "struct<start:bigint,end:bigint,label:string,source:string,members:bigint>"


def merged_expr(found: str, text: str) -> str:
    """The spans of one text as disjoint ones: an array of (start, end, label, source, members), by start.

    ``found`` holds (start, end, label, source). A source that says structured, alias or residual is
    structured; ``model`` alone is a bare model's. In the order of start, and longest first, each span
    meets the last one kept:

    - overlapping, the last structured and the new bare model: the new goes;
    - overlapping, the last bare model and the new structured: the new replaces it;
    - inside the last, neither of a model: the last keeps range and label, unless only the new is structured;
    - overlapping otherwise, or of one label and a model with at most four blanks, dots, quotes or
      dashes between: their union, with the label of higher priority;
    - else it is kept apart.

    A span that an earlier rule's span covers lies inside what that has become, so it needs no check of its own.
    """
    row = "named_struct('a', x.start, 'z', -x.end, 'i', i, 'x', named_struct('start', x.start, 'end', x.end, 'label', x.label, 'source', x.source))"
    ranked = f"transform(sort_array(transform(filter({found}, x -> x.end > x.start), (x, i) -> {row})), y -> y.x)"
    # one beyond all others at the end puts out the last span
    beyond = "named_struct('start', mx + 9, 'end', mx + 10, 'label', '', 'source', '')"
    items = let("ms", ranked, f"if(size(ms) > 0, {let('mx', 'array_max(transform(ms, y -> y.end))', f'concat(ms, array({beyond}))')}, ms)")

    def step(l: str, x: str) -> tuple[str, str]:  # noqa: E741
        model, bare, firm = (lambda e: f"contains({e}.source, 'model')"), (lambda e: f"{e}.source = 'model'"), (lambda e: f"{e}.source rlike 'structured|alias|residual'")
        over = f"({l}.start < {x}.end and {x}.start < {l}.end)"
        between = f"substr({text}, cast({l}.end + 1 as int), cast(greatest({x}.start - {l}.end, 0) as int))"
        gap = literal(r"^[ \t.'-]*$")
        goes_on = f"({x}.start >= {l}.end and {x}.start - {l}.end <= 4 and {l}.label = {x}.label and ({model(l)} or {model(x)}) and coalesce({between} rlike {gap}, false))"
        inside = f"({over} and {x}.end <= {l}.end and {x}.start >= {l}.start and not {model(l)} and not {model(x)})"
        make = lambda a, z, label, source, n: struct(start=f"cast({a} as bigint)", end=f"cast({z} as bigint)", label=label, source=source, members=f"cast({n} as bigint)")
        both = lambda p, q: f"if(contains({p}.source, {q}.source), {p}.source, concat({p}.source, '+', {q}.source))"
        more = f"{l}.members + 1"
        label = f"if({priority_expr(f'{x}.label')} < {priority_expr(f'{l}.label')}, {x}.label, {l}.label)"
        case = f"case when {l}.end is null or not ({over} or {goes_on}) then 'apart' when {over} and {firm(l)} and {bare(x)} then 'goes' when {over} and {bare(l)} and {firm(x)} then 'instead' when {inside} and {firm(x)} and not {firm(l)} then 'inner' when {inside} then 'outer' else 'union' end"
        alone = make(f"{x}.start", f"{x}.end", f"{x}.label", f"{x}.source", "1")
        following = f"""case mc when 'apart' then {alone} when 'goes' then {l} when 'instead' then {alone} when 'inner' then {make(f"{x}.start", f"{x}.end", f"{x}.label", both(x, l), more)}
          when 'outer' then {make(f"{l}.start", f"{l}.end", f"{l}.label", both(l, x), more)} else {make(f"least({l}.start, {x}.start)", f"greatest({l}.end, {x}.end)", label, both(l, x), more)} end"""
        return let("mc", case, following), let("mc", case, f"if(mc = 'apart' and {l}.end is not null, array({l}), {empty(MERGED)})")

    return fold(items, f"cast(null as {MERGED})", MERGED, step, "merge")


def sourced_expr(found: str, source: str = "structured") -> str:
    """Spans of :func:`find_expr` as those that :func:`merged_expr` takes."""
    return f"transform({found}, s -> {struct(start='s.start', end='s.end', label='s.label', source=literal(source))})"


def merged(text: str, rules: Sequence[Rule]) -> Column:
    """The merged spans of rules in a text."""
    return F.expr(merged_expr(sourced_expr(find_expr(text, rules)), text))


def splice_expr(text: str, spans: str, bare: str | None = None) -> str:
    """The text with each of the disjoint spans, in order, replaced by its label in brackets. ``bare`` names the text's plain bytes."""

    def step(at: str, c: str) -> tuple[str, str]:
        return f"cast({c}.end as bigint)", f"array({cut(text, at, f'{c}.start - {at}', bare)}, concat('[', {c}.label, ']'))"

    parts = fold("sp", "cast(0 as bigint)", "string", step, "splice")
    tail = f"substr({text}, cast(coalesce(try_element_at(sp, -1).end, 0) + 1 as int))"
    return let("sp", spans, f"if(coalesce(size(sp), 0) <= 0, {text}, concat(array_join({parts}, ''), {tail}))")


def splice(text: str, spans: str) -> Column:
    return F.expr(splice_expr(text, spans))


def redact(docs: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """``docs`` with the spans of all rules replaced by their labels; each row by itself."""
    safe = splice_expr(text, merged_expr(sourced_expr(find_expr(text, rules)), text))
    return docs.withColumn(text, F.expr(f"if({text} is not null, {safe}, null)"))


def merge(spans: DataFrame, docs: DataFrame | None = None, key: str = "doc_id", text: str = "text", order: Sequence[str] = ()) -> DataFrame:
    """The spans of each key as disjoint ones: ``(key, start, end, label, source, members)``, see :func:`merged_expr`.

    Spans of one range are taken by the columns ``order``, then by label and source, wherever their rows
    come from. Without a column ``source`` all are structured. Spans of a model go on across short gaps only
    where ``docs`` gives the texts.
    """
    given = spans if "source" in spans.columns else spans.withColumn("source", F.lit("structured"))
    start, end = (F.col(c).cast("long") for c in ("start", "end"))
    row = F.struct(start.alias("start"), (-end).alias("z"), *[F.col(c).alias(f"o{n}") for n, c in enumerate(order)], "label", "source", end.alias("end"))
    each = given.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("s"))
    if docs is None:
        return each.select(key, F.inline(F.expr(merged_expr("s", "cast(null as string)"))))
    return each.join(docs.select(key, text), key).select(key, F.inline(F.expr(merged_expr("s", text))))


def merge_found(docs: DataFrame, rules: Sequence[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, start, end, label, source, members)`` of the rules' spans, merged in the row."""
    return docs.select(key, F.inline(merged(text, rules)))


def overlaps(a: DataFrame, b: DataFrame, key: str = "doc_id", width: int = BIN) -> DataFrame:
    """Pairs of spans of a document that overlap: columns of ``a`` and of ``b`` with the suffixes _a and _b.

    Spans are cut into bins and joined by document and bin, which bounds what meets in one key.
    """
    cut = lambda d, s: d.select(
        F.col(key), *[F.col(c).alias(f"{c}_{s}") for c in d.columns if c != key],
        F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("bin"),
    )
    met = cut(a, "a").join(cut(b, "b"), [key, "bin"]).where("start_a < end_b and start_b < end_a")
    first = F.floor(F.greatest("start_a", "start_b") / width)  # each pair in the bin where the overlap begins
    return met.where(F.col("bin") == first).drop("bin")


def containing(inner: DataFrame, outer: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each inner span the first outer span, by start and end, that covers it."""
    met = overlaps(inner, outer, key).where("start_b <= start_a and end_b >= end_a")
    mine = [c for c in met.columns if c.endswith("_a")]
    return met.groupBy(key, *mine).agg(F.min(F.struct("start_b", "end_b")).alias("c")).select(key, *mine, "c.start_b", "c.end_b")


def render(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text)`` with each of the disjoint spans of a table replaced by its label in brackets.

    For spans that come from elsewhere; rules are applied in the row by :func:`redact`. A null key
    meets null keys. Keys must tell the rows of ``docs`` apart: a key of several rows that has spans is an error.
    """
    cuts = spans.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label"))).alias("_c"))
    counted = docs.select(key, text, F.count(F.lit(1)).over(Window.partitionBy(key)).alias("_n"))
    joined = counted.join(cuts, F.col(key).eqNullSafe(F.col("_key")), "left")
    safe = F.when(F.col("_c").isNull(), F.col(text)).when(F.col("_n") > 1, F.raise_error("several rows of one key").cast("string")).otherwise(splice(text, "_c"))
    return joined.select(key, safe.alias(text))


def occurrences(text: Column, literal: str) -> Column:
    """How often a literal occurs, without overlaps."""
    return F.size(F.split(text, F.lit("\\Q" + literal + "\\E"), -1)) - 1


def inside_bracket(text: str, found: Column) -> Column:
    """The spans with a flag ``inside``: whether an opening bracket before is closed after it, with none in between."""
    brackets = find(text, [Rule("bracket", "", r"\[[^\[\]]*\]", needs="[")])
    test = lambda b: F.transform(found, lambda s: s.withField("inside", F.exists(b, lambda x: (x.start < s.start) & (x.end > s.end))))
    return F.transform(F.array(brackets), test)[0]


def to_token_edges(text: Column, found: Column, look: int = 256) -> Column:
    """The spans with ``grown_start`` and ``grown_end``: moved outwards over the letters and digits that touch them."""

    def run(window: Column, whole: Column, pattern: str) -> Column:
        n = F.length(F.regexp_extract(window, pattern, 0))
        return F.when(n < look, n).otherwise(F.length(F.regexp_extract(whole, pattern, 0)))  # the whole only for very long runs

    def grown(s: Column) -> Column:
        near = F.greatest(s.start - look, F.lit(0))
        back = run(F.substr(text, (near + 1).cast("int"), (s.start - near).cast("int")), F.substr(text, F.lit(1), s.start.cast("int")), "[A-Za-z0-9]*$")
        on = run(F.substr(text, (s.end + 1).cast("int"), F.lit(look)), F.substr(text, (s.end + 1).cast("int")), "^[A-Za-z0-9]*")
        return s.withField("grown_start", s.start - back).withField("grown_end", s.end + on)

    return F.transform(found, grown)
