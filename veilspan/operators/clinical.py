"""Guards that keep clinical wording from being taken for personal data.

A span is looked at once: :func:`context_expr` cuts what stands around it out of the text, :func:`signals_expr`
makes named facts of that and of a compiled vocabulary, and :func:`verdict_expr` decides from the facts
alone. Each fact is worked out once for a span, and neither a plan nor a row grows with the
vocabulary. Facts that are made of others, and the cases of a verdict, are
stated as conditions.

Defined cases: a field that is null counts as empty; a span of no words is in no vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from ..functions.expr import cut, let, literal, struct
from . import lines
from .vocabulary import has_expr, kinds_expr, normal_expr, words_expr

LOOK, WIDE = 80, 400
NAME_LABELS = ("NAME", "PATIENT NAME", "PROVIDER NAME", "CONTACT NAME")

# ---- a small vocabulary; callers give their own ------------------------------------------------

CLINICAL_WORDS = tuple(
    "abdomen abdominal acute anemia angina aspirin assessment atrial bilateral biopsy bladder blood bone bowel brain breath cancer cardiac "
    "care chest chronic clear colon course cough creatinine culture decreased diabetes diastolic disease distress edema ejection elevated "
    "exam failure fever fibrillation fluids fraction gait glucose head heart hemoglobin hepatic history hypertension imaging infection "
    "insulin kidney labs left liver lung lungs lymph mental mild mobility murmur nausea neck negative neuro normal oral oxycodone pain "
    "physical plan platelet pneumonia positive potassium pressure procedure prognosis pulmonary pulse pupils rate rash reflex renal result "
    "rhythm right sepsis sign skin sodium soft spine stable stance stroke surgical symptoms syndrome systolic tachycardia temperature tests "
    "therapy thyroid trauma troponin ulcer urine vein vital vitals vomiting weakness wound".split()
)
EPONYMS = tuple("addison alzheimer babinski crohn cushing foley glasgow graves hodgkin kawasaki marfan parkinson raynaud romberg wells whipple wilson allen".split())
BASE = {
    "clinical": CLINICAL_WORDS,
    "anchor": "anemia angina cancer diabetes disease edema failure fever fibrillation hypertension infection pneumonia sepsis sign stroke syndrome ulcer".split(),
    "eponym": EPONYMS,
    "companion": "catheter coma criteria disease lymphoma phenomenon procedure reflex scale score sign stance syndrome test".split(),
    "heading": ["assessment and plan", "chief complaint", "discharge planning", "family history", "hospital course", "interval events", "physical exam", "social history", "vital signs"],
    "service": "cardiology dermatology endocrinology gastroenterology hematology nephrology neurology oncology orthopedics pediatrics psychiatry radiology surgery urology".split(),
    "medication": "amlodipine apixaban aspirin atorvastatin furosemide gabapentin heparin insulin lisinopril metformin metoprolol oxycodone prednisone vancomycin warfarin".split(),
    "place": "bedside clinic home hospital icu outpatient unit ward".split(),
    "facility": "center clinic hospice hospital institute laboratory pavilion pharmacy practice surgery".split(),
    "relation": "brother daughter father husband mother neighbor partner sister son spouse wife".split(),
    "title": "dr doctor miss mr mrs ms prof".split(),
    "field": "account address alias contact dob email employer fax member mrn name occupation patient phone policy provider room".split(),
    "analyte": "bun calcium chloride creatinine egfr glucose magnesium potassium sodium troponin".split(),
}

#: Endings of generic drug names by class (fixed values of the public nomenclature).
STEM = r"(?:olol|pril|statin|cillin|mycin|azole|sartan|oxacin|dipine|triptan)$"

# ---- what stands around a span -----------------------------------------------------------------

_BLANKS = literal(r"\s+")
FIELDS = ("span", "norm", "before", "after", "prefix", "line", "around")


def context_expr(text: str, s: str, keep: dict[str, str], look: int = LOOK, wide: int = WIDE, bare: str | None = None) -> str:
    """A struct of ``keep`` and of what guards look at: what span ``s`` says, and what stands around it.

    ``before`` and ``after`` reach ``look`` characters; ``prefix`` and ``line`` end at line ends and
    reach ``wide`` characters, as ``around`` does. A text is walked once for each span, or not at all if
    ``bare`` names its plain bytes.
    """
    lead, size = f"cast(least({s}.start, {wide}) as int)", f"cast({s}.end - {s}.start as int)"
    window = cut(text, f"{s}.start - least({s}.start, {wide})", f"{lead} + {size} + {wide}", bare)
    parts = struct(left="substr(cw, 1, cl)", inner="substr(cw, cl + 1, cn)", right="substr(cw, cl + cn + 1)", lead="cl", around="cw")
    said = let("cs", f"trim(regexp_replace(cp.inner, {_BLANKS}, ' '))", let("cx", "substring_index(cp.left, '\\n', -1)", struct(
        **keep, span="cs", norm=normal_expr("cs"), before=f"substr(cp.left, greatest(cp.lead - {look}, 0) + 1)", after=f"substr(cp.right, 1, {look})", prefix="cx",
        line="concat(cx, substring_index(cp.inner, '\\n', 1), substring_index(cp.right, '\\n', 1))", around="cp.around",
    )))
    return let("cl", lead, let("cn", size, let("cw", window, let("cp", parts, said))))


# ---- facts -------------------------------------------------------------------------------------

#: Facts that a pattern tells, of one field. The patterns are valid for Java and RE2.
PATTERNS = {
    "labelled": ("prefix", r"[A-Za-z][A-Za-z ]{1,30}[ \t]*[:=#][ \t*_]*$"),
    "dosed_before": ("before", r"(?i)[0-9] ?(?:mg|mcg|ml|g|units?|tablets?) (?:of )?$"),
    "dosed_after": ("after", r"(?i)^ *[0-9.]+ ?(?:mg|mcg|ml|g|units?|tablets?)\b|^ *(?:daily|twice daily|nightly|as needed)\b"),
    "measured": ("line", r"[:\t][ \t]*[<>]?[0-9][0-9.,]*[ \t]*(?:%|mmHg\b|m?mol|m?Eq|[munp]?g/[dm]?L|K/uL|\([0-9])"),
    "cultured": ("around", r"(?i)\b(?:isolates?|susceptib[a-z]*|antibiogram)\b"),
    "graded": ("line", r"(?i)[0-9] +(?:S|I|R|susceptible|nonsusceptible)[ \t]*$"),
    "traced": ("line", r"\b(?:E[CK]G|QRS|QTc?|leads?)\b"),
    "addressed": ("line", r"(?i)\baddress\b"),
    "imaged": ("line", r"(?i)\b(?:CT|MRI|X-?ray|ultrasound|echo)\b.*\b(?:views?|contrast|image)"),
    "alone_before": ("before", r"(?:^|\n)[ \t]*(?:[#*-]|[0-9]+[.)])?[ \t]*$"),
    "alone_after": ("after", r"^:?[ \t]*(?:\n|$)"),
    "colon_after": ("after", r"^ ?:"),
    "digits": ("span", r"[0-9]"),
    "sentences": ("span", r"[a-z]{3}\. +[A-Z]"),
    "capitals": ("span", r"^[A-Z]{2,5}$"),
    "titled": ("span", r"(?i)^(?:dr|doctor|mr|mrs|ms|miss|prof)\.? "),
    "stem": ("norm", STEM),
    "person_shape": ("span", r"^(?:(?:Dr|Mr|Mrs|Ms|Prof)\.? )?[A-Z][A-Za-z'-]+(?:,? [A-Z][A-Za-z'.-]*){0,3}$"),
    "aged": ("after", r"(?i)^,? (?:is |was )?(?:an? )?[0-9]{1,3}[ -]?(?:year|yo\b|y/o)"),
    "spoken": ("before", r"(?i)\b(?:spoke (?:with|to)|called|phoned|met with|updated) (?:the |her |his )?$"),
    "acted": ("after", r"(?i)^ (?:is|was|has|had|says|said|reports|denies)\b"),
    "signed": ("before", r"(?i)\b(?:signed|read|seen|reviewed|dictated) by:? $"),
    "credential": ("after", r"^ ?,? ?(?:MD|DO|NP|PA|RN|PhD)\b"),
    "lower_start": ("span", r"^[a-z]"),
    "stay": ("after", r"(?i)^ (?:course|day|stay|admission)\b"),
    "stay_inside": ("span", r"(?i)^hospital (?:course|day|stay|admission)\b"),
    "street_doctor": ("span", r"\bDr\. +[A-Z]"),
    "device": ("span", r"(?i)^(?:sn|dev|udi)[-:#=]"),
    "no_day": ("span", r"(?i)^(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?|[0-9]{1,2}:[0-9]{2}|aged? [0-9]{1,3})$"),
    "short_range": ("span", r"^[0-9]{1,2}[-.][0-9]{1,2}$"),
    "dated_before": ("before", r"(?i)\b(?:on|dated|since|from|until|seen|admitted)[: ]+$"),
}
_PLACES = ("LOCATION", "ORGANIZATION", "FACILITY")
#: Patterns that are looked for only in spans of some labels, as no verdict on others asks for them.
ONLY = {
    **dict.fromkeys(
        "dosed_before dosed_after alone_before alone_after colon_after digits sentences capitals titled stem person_shape aged spoken acted signed credential lower_start stay stay_inside imaged".split(),
        (*NAME_LABELS, *_PLACES),
    ),
    **dict.fromkeys(("no_day", "short_range", "dated_before"), ("DATE",)),
    **dict.fromkeys(("traced", "addressed", "street_doctor"), ("ADDRESS",)),
    **dict.fromkeys(("measured", "device"), ("ID",)),
}
#: Facts that the vocabulary tells: of the whole span (``p``), its words (``w``), the word before (``b``) and after (``a``).
_ALL, _ANY, _LAST = "all", "any", "last"
WORDS = {
    "heading": ("p", "", ("heading",)),
    "service": ("w", _ALL, ("service", "place")),
    "service_any": ("w", _ANY, ("service",)),
    "medication": ("p", "", ("medication",)),
    "place": ("p", "", ("place",)),
    "clinical": ("w", _ALL, ("clinical", "medication", "analyte")),
    "anchored": ("w", _ANY, ("anchor",)),
    "eponym": ("w", _ANY, ("eponym",)),
    "companion_in": ("w", _LAST, ("companion",)),
    "companion_after": ("a", "", ("companion",)),
    "facility": ("w", _LAST, ("facility",)),
    "analyte": ("w", _ANY, ("analyte",)),
    "relation_before": ("b", "", ("relation",)),
    "title_before": ("b", "", ("title",)),
    "field_before": ("b", "", ("field",)),
}
#: Facts made of others, in SQL and in Columns alike; they may name those above them.
DERIVED = {
    "explicit": "labelled OR field_before",
    "dosed": "dosed_before OR dosed_after",
    "eponymous": "eponym AND (companion_in OR companion_after)",
    "title_line": "heading OR (clinical AND (colon_after OR (alone_before AND alone_after)))",
    "guarded": "clinical AND anchored",
    "culture": "cultured AND graded",
    "drug": "medication OR stem",
    "strong_name": "titled OR title_before OR relation_before OR field_before OR spoken OR signed OR aged",
    "non_name": "eponymous OR title_line OR (service AND service_any) OR guarded OR clinical OR (digits AND NOT titled) OR (sentences AND NOT titled) OR companion_after OR (capitals AND NOT strong_name)",
    "protected": "culture OR (in_place AND place)",
    "result_line": "measured AND NOT field_before",
    "date_false": "no_day OR (short_range AND NOT dated_before)",
    "address_false": "analyte OR street_doctor OR (traced AND NOT addressed)",
    "location_false": "place OR stay_inside OR guarded OR lower_start",
    "organization_false": "place OR culture OR guarded OR title_line OR imaged OR stay",
    "provider": "titled OR title_before OR signed OR credential",
    "contact": "relation_before OR spoken",
    "patient": "field_before OR aged",
}
#: What becomes of a span, and why; the order counts. ``model`` spans come from a model alone or together with rules.
CASES = [
    ("room", "FACILITY", "label = 'ROOM' AND facility AND many_words"),
    ("age", "drop", "label = 'AGE' AND young"),
    ("protected", "drop", "protected AND NOT explicit"),
    ("non_name", "drop", "is_name AND NOT (label = 'PATIENT NAME' AND NOT model AND explicit) AND non_name"),
    ("dosed", "drop", "is_name AND dosed AND drug"),
    ("short", "drop", "is_name AND tiny"),
    ("zone", "drop", "model AND (is_name OR label = 'LOCATION') AND zoned AND NOT strong_name"),
    ("organisation", "ORGANIZATION", "model AND is_name AND facility"),
    ("shapeless", "drop", "model AND is_name AND NOT person_shape AND NOT strong_name"),
    ("no_date", "drop", "label = 'DATE' AND date_false"),
    ("no_address", "drop", "label = 'ADDRESS' AND address_false"),
    ("result", "drop", "label = 'ID' AND NOT device AND result_line"),
    ("no_place", "drop", "label = 'LOCATION' AND location_false"),
    ("no_organisation", "drop", "label IN ('ORGANIZATION', 'FACILITY') AND organization_false AND NOT explicit"),
]
#: The label of a name by what stands around it.
LABELS = [
    ("PROVIDER NAME", "label = 'NAME' AND provider"),
    ("CONTACT NAME", "label IN ('NAME', 'PATIENT NAME') AND contact AND NOT provider"),
    ("PATIENT NAME", "label = 'NAME' AND patient"),
]
FACTS = ["is_name", "model", "in_place", "many_words", "young", "tiny", "zoned", *PATTERNS, *WORDS, *DERIVED]


_OWN = literal("^'s")


def _looked(s: str, table: str) -> dict[str, str]:
    """What the vocabulary says of a span (``p``), its words (``w``), the word before (``b``) and after (``a``)."""
    near = lambda t, at: f"coalesce(try_element_at({words_expr(normal_expr(t))}, {at}), '')"
    return {
        "p": kinds_expr(table, f"{s}.norm"), "w": f"transform({words_expr(f'{s}.norm')}, w -> {kinds_expr(table, 'w')})",
        "b": let("nb", near(f"substring_index({s}.before, '\\n', -1)", -1), kinds_expr(table, "nb")), "a": let("na", near(f"regexp_replace({s}.after, {_OWN}, '')", 1), kinds_expr(table, "na")),
    }


def _plain(s: str, k: dict[str, str]) -> dict[str, str]:
    """The facts of a span that are not made of others; ``k`` says what the vocabulary says of it."""
    made = {
        "is_name": f"{s}.label in ({', '.join(map(literal, NAME_LABELS))})",
        "model": f"contains(coalesce({s}.source, ''), 'model')",
        "in_place": f"{s}.label in ({', '.join(map(literal, _PLACES))})",
        "many_words": f"size({k['w']}) > 2",
        "young": f"{s}.label = 'AGE' and coalesce(try_cast(regexp_extract({s}.span, '[0-9]{{1,3}}', 0) as int), 0) < 90",
        "tiny": f"length({s}.span) <= 2",
        "zoned": f"{lines.kind_expr(f'{s}.line')} in ('lab', 'vitals', 'meds', 'imaging')",
    }
    asked = lambda name: f"{s}.label in ({', '.join(map(literal, ONLY[name]))}) and " if name in ONLY else ""
    made |= {name: f"{asked(name)}{s}.{field} rlike {literal(p)}" for name, (field, p) in PATTERNS.items()}
    for name, (of, how, which) in WORDS.items():
        test = f"x -> {has_expr('x', *which)}"
        made[name] = {_ALL: f"size({k['w']}) > 0 and forall({k['w']}, {test})", _ANY: f"exists({k['w']}, {test})", _LAST: has_expr(f"coalesce(try_element_at({k['w']}, -1), 0)", *which)}.get(how) or has_expr(k[of], *which)
    return made


def plain_expr(s: str, name: str) -> str:
    """One fact that a pattern tells of a span's context."""
    return f"({_plain(s, _BOUND)[name]})"


def _needed(wanted: Sequence[str]) -> set[str]:
    """The facts that ``wanted`` ones are made of, with themselves."""
    out = set(wanted)
    for name in reversed(DERIVED):
        if name in out:
            out |= set(re.findall(r"[a-z_]+", DERIVED[name]))
    return out


_BOUND = {of: f"k.{of}" for of in "pwba"}


def signals_expr(s: str, table: str, wanted: Sequence[str] | None = None) -> str:
    """All facts of a span with its :func:`context_expr`, label and source, as a struct of booleans; or those that ``wanted`` ones are made of."""
    needed = _needed(FACTS if wanted is None else wanted)
    made = {name: e for name, e in _plain(s, _BOUND).items() if name in needed}
    asks = " ".join(made.values())
    looked = struct(**{of: e for of, e in _looked(s, table).items() if re.search(rf"\bk\.{of}\b", asks)}, none="0")
    # facts made of others, in groups of which each sees those before it
    facts, known, group = let("k", looked, struct(**made)), list(made), {}
    for name, expression in [*((n, e) for n, e in DERIVED.items() if n in needed), ("", "")]:
        if not name or set(re.findall(r"\w+", expression)) & set(group):
            facts = let("fact", facts, struct(**{n: f"fact.{n}" for n in known}, **group))
            known, group = [*known, *group], {}
        group[name] = named_in(expression, "fact", "")
    return facts


def _cases_expr(cases: Sequence[tuple[str, str, str]], label: str, plain: dict[str, str], named: str) -> str:
    """The label after the first of ``cases`` that holds, null if the span goes, ``named`` if none holds. Facts stand where they are asked for."""

    def spelled(expression: str) -> str:
        def word(m: re.Match) -> str:
            if m[0] in ("NOT", "AND", "OR", "IN") or m[0].startswith("'"):
                return m[0]
            if m[0] == "label":
                return label
            return f"({spelled(_QUICK.get(m[0]) or DERIVED[m[0]]) if m[0] in DERIVED else plain[m[0]]})"

        return re.sub(r"'[^']*'|[A-Za-z_]+", word, expression)

    whens = " ".join(f"when {spelled(test)} then {'null' if becomes == 'drop' else literal(becomes)}" for _, becomes, test in cases)
    names = " ".join(f"when {spelled(test)} then {literal(becomes)}" for becomes, test in LABELS) if named == "named" else ""
    return f"case {whens} {names} else {label} end"


#: Facts in an order that asks the shorter text first.
_QUICK = {"culture": "graded AND cultured"}
#: Cases that may hold for a label that is neither a name's nor a place's, and those that hold for no other.
_ANY_LABEL, _OTHERS = ("protected",), ("age", "no_date", "result")


def label_expr(s: str, table: str) -> str:
    """The label of a span's :func:`verdict_expr` alone, null if it goes. A fact is worked out only where a case asks for it."""
    full = _cases_expr([c for c in CASES if c[0] not in _OTHERS], f"{s}.label", _plain(s, _BOUND), "named")
    short = _cases_expr([c for c in CASES if c[0] in (*_ANY_LABEL, *_OTHERS)], f"{s}.label", _plain(s, _looked(s, table)), "")
    rich = ", ".join(map(literal, (*NAME_LABELS, *_PLACES, "ROOM", "ADDRESS")))
    return f"if({s}.label in ({rich}), {let('k', struct(**_looked(s, table)), full)}, {short})"


def named_in(expression: str, facts: str, label: str) -> str:
    """An expression over facts, with each fact as a field of ``facts`` and ``label`` as given."""
    word = lambda m: m[0] if m[0] in ("NOT", "AND", "OR", "IN") or m[0].startswith("'") else label if m[0] == "label" else f"{facts}.{m[0]}"
    return re.sub(r"'[^']*'|[A-Za-z_]+", word, expression)


def verdict_expr(facts: str, label: str) -> str:
    """(reason, label): why a span goes or changes, and the label that it has then, null if it goes; the reason ``keep`` leaves it or names it anew."""
    reason = "case " + " ".join(f"when {named_in(test, facts, label)} then '{name}'" for name, _, test in CASES) + " else 'keep' end"
    named = "case " + " ".join(f"when {named_in(test, facts, label)} then '{becomes}'" for becomes, test in LABELS) + f" else {label} end"
    changed = " ".join(f"when '{name}' then '{becomes}'" for name, becomes, _ in CASES if becomes != "drop")
    return let("why", reason, struct(reason="why", label=f"case why {changed} when 'keep' then {named} else null end"))


def judged_expr(text: str, found: str, table: str) -> str:
    """The spans with their context, facts and verdict."""
    own = {c: f"js.{c}" for c in ("start", "end", "label", "source")}
    fields = {c: f"jc.{c}" for c in (*own, *FIELDS)}
    row = let("jf", signals_expr("jc", table), struct(**fields, facts="jf", verdict=verdict_expr("jf", "jc.label")))
    return f"transform({found}, js -> {let('jc', context_expr(text, 'js', own), row)})"


def becomes_expr(text: str, s: str, table: str, bare: str | None = None) -> str:
    """The label that a span (start, end, label, source) of the text has after the guards, null if it goes."""
    return let("jc", context_expr(text, s, {c: f"{s}.{c}" for c in ("label", "source")}, bare=bare), label_expr("jc", table))


def kept_expr(text: str, found: str, table: str) -> str:
    """The spans that stay, as (start, end, label, source), names with the label that fits them."""
    row = struct(start="js.start", end="js.end", label=becomes_expr(text, "js", table), source="js.source")
    return f"filter(transform({found}, js -> {row}), s -> s.label is not null)"


# ---- values ------------------------------------------------------------------------------------

#: What a field's value loses: (where it ends, pattern); see :func:`trimmed_expr`.
LEAD = r"(?i)^[ \t]*(?:(?:patient|provider|contact|name|attending|pcp)[ \t]*[:#=][ \t]*)?"
DOTTED = r"\b(Dr|Mr|Mrs|Ms|Prof|[A-Z])\."
END = r"(?s)(?:\. +[A-Z].*|[ \t]+(?:DOB|MRN|Phone|Fax|Sex|Age|Room|Account|Email|Address)\b.*|,? +(?:MD|DO|RN|NP|PA|PhD)\b.*|[ \t]+Per\b.*)$"
POINTS_OFF = r"[\s,;:.-]+$"


def trimmed_expr(value: str) -> str:
    """(lead, kept): how many characters a pattern's span loses in front, and what stays of it.

    A field's label in front goes; then all from a sentence's end, a header, credentials, or "Per" on; then punctuation.
    """
    masked = f"regexp_replace(tr, {literal(DOTTED)}, '$1~')"  # a title's or an initial's dot ends no sentence
    kept = f"regexp_replace(substr(tr, 1, length(regexp_replace({masked}, {literal(END)}, ''))), {literal(POINTS_OFF)}, '')"
    return let("tl", f"length(regexp_extract({value}, {literal(LEAD)}, 0))", let("tr", f"substr({value}, tl + 1)", struct(lead="cast(tl as bigint)", kept=kept)))
