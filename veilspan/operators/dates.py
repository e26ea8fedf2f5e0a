"""Dates in free text: found by a grammar, resolved against a reference day, and put on a timeline, in the row.

Kinds, of which a longer match covers a shorter one: ``iso``, ``mdy``, ``mdy2``, ``dash``,
``mon_d_y``, ``d_mon``, ``mon_d``, ``mon_y``, ``m_y``, ``md``, ``ago``, ``casual``. Scores, doses and
durations that look like one are left out. A date that cannot be, as 2/30/2026, is null, and has no
place on the timeline. A null text has no dates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rules import Rule
from . import spans, timeline

MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_PATTERNS = {
    "iso": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    "mdy": r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b",
    "mdy2": r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}\b",
    "dash": r"\b[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}\b",
    "mon_d_y": rf"(?i:\b{MONTH}\.? [0-9]{{1,2}}(?:st|nd|rd|th)?,? [0-9]{{4}})\b",
    "d_mon": rf"(?i:\b[0-9]{{1,2}}-{MONTH}-(?:[0-9]{{4}}|[0-9]{{2}}))\b",
    "mon_d": rf"(?i:\b{MONTH}\.? [0-9]{{1,2}}(?:st|nd|rd|th)?)\b",
    "mon_y": rf"(?i:\b{MONTH} [0-9]{{4}})\b",
    "m_y": r"\b(?:0?[1-9]|1[0-2])/[0-9]{4}\b",
    "md": r"\b[0-9]{1,2}/[0-9]{1,2}\b",
    "ago": r"(?i:\b[0-9]{1,3} (?:days?|weeks?|months?|years?) (?:ago|later))\b",
    "casual": r"(?i:\b(?:yesterday|today|tomorrow|now))\b",
}
#: What a text must hold for a date of the kind: a sign, or one of some words.
_NEEDS = {"iso": "-", "mdy": "/", "mdy2": "/", "dash": "-", "d_mon": "-", "m_y": "/", "md": "/"}
_WORDS = {**dict.fromkeys(("mon_d_y", "d_mon", "mon_d", "mon_y"), tuple(MONTHS)), "ago": ("ago", "later"), "casual": ("yesterday", "today", "tomorrow", "now")}
#: The label is the kind.
RULES = [Rule(kind, kind, pattern, needs=_NEEDS.get(kind, ""), words=_WORDS.get(kind, ())) for kind, pattern in _PATTERNS.items()]

SCORE = r"(?i)\b(?:pain|score|scored|rated|grade|strength|motor|reflex|gcs|apgar|bp|pressure|murmur)[: ]*$"
UNIT = r"(?i)^(?: ?(?:mg|mcg|mmhg|mmol|%|ml|cm|views?)\b| (?:strength|systolic|diastolic|murmur|pain))"
DURATION = r"(?i)\bfor $"
BIRTH = r"(?i)\b(?:dob|born|date of birth|birth ?date)[: ]*$"
ADMISSION = r"(?i)\b(?:admission(?: date)?|admitted(?: on)?|presented(?: on)?)[: ]*$"
SOURCE = r"(?i)\b(?:collected|resulted|collection date|result date|signed)(?: on)?[: ]*$"
FUTURE = r"(?i)\b(?:follow up|scheduled(?: for)?|planned(?: for)?|will|next|return)(?: on)? *$"
PAST = r"(?i)\b(?:history of|previous(?:ly)?|prior|last|since|surgery(?: in| on)?|back in)(?: on| in)? *$"
CURRENT = r"(?i)\b(?:seen(?: on)?|today|now|examined(?: on)?|rounds(?: on)?)[: ]*$"
NEAR = 48
#: Kinds that say a day, after which a clock may follow.
DAYS = ("iso", "mdy", "mdy2", "dash", "mon_d_y", "d_mon", "mon_d", "md")
#: A clock after a day; four digits that could be a year of this century count only after "at".
CLOCK = r"^(?:,? (?:at |@ ?)(?:[01]?[0-9]|2[0-3]):?[0-5][0-9](?: ?[AaPp][Mm])?\b|,? (?:(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?: ?[AaPp][Mm])?|(?:0[0-9]|1[0-8]|2[1-3])[0-5][0-9])\b)"
DOSE = r"(?i)^ ?(?:mg|mcg|ml|units?|kcal|cc|/)"
#: The second end of a range that takes its month from the first.
UNTIL = r"^( ?(?:-|–|to|through) ?)([0-9]{1,2})(?:st|nd|rd|th)?(?:[ ,.;)\n]|$)"


def using(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def direction(before: Column) -> Column:
    """What the words before a date make of it: birth, source, admission, future, past, current or neutral."""
    out = F.lit("neutral")
    for name, pattern in (("current", CURRENT), ("past", PAST), ("future", FUTURE), ("admission", ADMISSION), ("source", SOURCE), ("birth", BIRTH)):
        out = F.when(before.rlike(pattern), name).otherwise(out)
    return out


def suppressed(kind: Column, value: Column, before: Column, after: Column) -> Column:
    """Whether what looks like a date is a score, a measurement, a duration or the idiom 2/2."""
    return ((kind == "md") & (before.rlike(SCORE) | after.rlike(UNIT) | (value == "2/2"))) | ((kind == "ago") & before.rlike(DURATION))


def find(name: str, bare: str | None = None) -> Column:
    """Dates of a text: an array of (start, end, kind, value, context, clock), by place; a clock that follows a day
    belongs to it, and both ends of a range count. ``name`` is a column's name, or SQL; ``bare`` names its plain bytes."""
    text = F.expr(name)
    walked = lambda at, n: F.substr(text, (at + 1).cast("int"), n.cast("int"))
    cut = (lambda at, n: F.when(F.col(bare).isNull(), walked(at, n)).otherwise(F.substr(F.col(bare), (at + 1).cast("int"), n.cast("int")).cast("string"))) if bare else walked

    def add(s: Column) -> Column:
        near = F.greatest(s.start - NEAR, F.lit(0))
        return F.struct(
            s.start, s.end, s.label.alias("kind"), cut(s.start, s.end - s.start).alias("value"),
            F.substring_index(cut(near, s.start - near), "\n", -1).alias("before"), cut(s.end, F.lit(24)).alias("after"),
        )

    def timed_end(d: Column) -> Column:
        said = F.regexp_extract(d.after, CLOCK, 0)
        clock = F.when(d.kind.isin(*DAYS) & ~F.substr(d.after, F.length(said) + 1).rlike(DOSE), said).otherwise("")
        made = lambda c: F.struct(d.start, (d.end + F.length(c)).alias("end"), d.kind, d.value, direction(d.before).alias("context"), F.regexp_extract(c, "[0-9].*$", 0).alias("clock"))
        return using(clock, made)

    def until(d: Column) -> Column:
        lead, day = F.regexp_extract(d.after, UNTIL, 1), F.regexp_extract(d.after, UNTIL, 2)
        start = d.end + F.length(lead)
        value = F.concat_ws(" ", F.regexp_extract(d.value, "^[A-Za-z]+", 0), day)
        return F.struct(start.alias("start"), (start + F.length(day)).alias("end"), d.kind, value.alias("value"), direction(d.before).alias("context"), F.lit("").alias("clock"))

    each = F.transform(spans.merged(name, RULES), add)

    def both(found: Column) -> Column:
        ranges = F.filter(found, lambda d: (d.kind == "mon_d") & d.after.rlike(UNTIL))
        return F.sort_array(F.concat(F.transform(found, timed_end), F.transform(ranges, until)))

    return using(F.filter(each, lambda d: ~suppressed(d.kind, d.value, d.before, d.after)), both)


def parts(kind: Column, value: Column) -> Column:
    """(y, m, d) as text; y is null without a year, d is 1 for a month."""
    n = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    at = lambda i: F.try_element_at(n, F.lit(i))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(value, "[A-Za-z]{3}", 0))).cast("string")
    full = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    is_ = lambda *kinds: kind.isin(*kinds)
    y = F.when(is_("iso", "mon_y"), at(1)).when(is_("mdy", "mdy2", "dash"), full(at(3))).when(is_("mon_d_y", "m_y"), at(2)).when(is_("d_mon"), full(at(2)))
    m = F.when(is_("iso"), at(2)).when(is_("mdy", "mdy2", "dash", "md", "m_y"), at(1)).when(is_("mon_d_y", "d_mon", "mon_d", "mon_y"), month)
    d = F.when(is_("iso"), at(3)).when(is_("mdy", "mdy2", "dash", "md"), at(2)).when(is_("mon_d_y", "d_mon", "mon_d"), at(1)).when(is_("mon_y", "m_y"), "1")
    return F.struct(y.alias("y"), m.alias("m"), d.alias("d"))


def explicit(p: Column) -> Column:
    """The date of :func:`parts` that say a year; null if they say none, or no such day is."""
    return F.when(p.y.isNotNull(), F.try_to_date(F.concat_ws("-", p.y, p.m, p.d), "yyyy-M-d"))


def resolve(kind: Column, value: Column, context: Column, reference: Column, p: Column, said: Column) -> Column:
    """The date of any value: what it says, else the nearest year's, else counted from the reference day.

    Without a year, a day over thirty days ahead is of the year before, unless the words before speak of the future.
    """
    n, unit = F.regexp_extract(value, "^[0-9]+", 0).try_cast("int"), F.lower(F.regexp_extract(value, "(?i)day|week|month|year", 0))
    sign = F.when(F.lower(value).endswith("ago"), -1).otherwise(1)
    moved = F.when(unit == "day", F.date_add(reference, sign * n)).when(unit == "week", F.date_add(reference, sign * n * 7)).when(unit == "month", F.add_months(reference, sign * n)).when(unit == "year", F.add_months(reference, sign * n * 12))
    casual = F.date_add(reference, F.when(F.lower(value) == "yesterday", -1).when(F.lower(value) == "tomorrow", 1).otherwise(0))
    near = timeline.nearest_year(p.m, p.d, reference, F.when(context == "future", 366).otherwise(30))
    return F.when(kind == "ago", moved).when(kind == "casual", casual).when(kind.isin("mon_d", "md"), near).otherwise(said)


def anchor(dates: Column, supplied: Column) -> Column:
    """The day that a text's timeline starts from. ``dates`` holds (kind, context, said, date), said being the explicit date.

    The first there is of: the supplied day; the latest explicit day of a source; the earliest in words of
    admission; the latest in words of now; where no year is said at all, the last one placed; the
    earliest explicit day within fourteen days of the latest. Days of birth never count.
    """
    days = lambda rows, test: F.transform(F.filter(rows, test), lambda d: d.date)

    def chosen(own: Column) -> Column:
        said = days(own, lambda d: d.said.isNotNull() & ~d.kind.isin("mon_y", "m_y"))
        close = lambda s: using(F.array_max(s), lambda last: F.array_min(F.filter(s, lambda d: F.datediff(last, d) <= 14)))
        return F.coalesce(
            supplied,
            F.array_max(days(own, lambda d: (d.context == "source") & d.said.isNotNull())),
            F.array_min(days(own, lambda d: d.context == "admission")),
            F.array_max(days(own, lambda d: d.context == "current")),
            using(said, lambda s: F.when(F.size(s) == 0, F.try_element_at(own, F.lit(-1)).date).otherwise(close(s))),
        )

    return using(F.filter(dates, lambda d: (d.context != "birth") & d.date.isNotNull()), chosen)


def place(kind: Column, context: Column, date: Column, start: Column) -> Column:
    """A date's label on the timeline, without brackets."""
    n = F.datediff(date, start) + 1
    return (
        F.when(context == "birth", "DOB")
        .when(date.isNull(), "Historical date")
        .when(kind.isin("mon_y", "m_y"), F.concat(F.lit("Historical: "), F.year(date).cast("string")))
        .when(start.isNull(), "Historical date")
        .when((n >= 1) & (context != "past"), F.concat(F.lit("Hospital Day "), n.cast("string")))
        .when(n >= 1, "Historical date")
        .otherwise(F.concat(timeline.duration(date, start), F.lit(" prior to hospital admission")))
    )


def at_clock(label: Column, clock: Column) -> Column:
    """A hospital day's label with the time of day, if there is one."""
    return using(label, lambda x: F.when(x.startswith("Hospital Day"), F.concat_ws(" at ", x, timeline.parse_clock(F.trim(clock)))).otherwise(x))


def timed(text: str, reference: Column, supplied: Column | None = None, bare: str | None = None) -> Column:
    """Dates of a text with their day and label: an array of (start, end, kind, value, context, clock, said, date, label)."""
    none = F.lit(None).cast("date")

    def dated(d: Column) -> Column:
        made = lambda p, said: F.struct(d.start, d.end, d.kind, d.value, d.context, d.clock, said.alias("said"), resolve(d.kind, d.value, d.context, reference, p, said).alias("date"))
        return using(parts(d.kind, d.value), lambda p: using(explicit(p), lambda said: made(p, said)))

    def labelled(all_: Column) -> Column:
        return F.transform(
            F.array(anchor(all_, supplied if supplied is not None else none)),
            lambda a: F.transform(all_, lambda d: d.withField("label", at_clock(place(d.kind, d.context, d.date, a), d.clock))),
        )[0]

    return F.transform(F.array(F.transform(find(text, bare), dated)), labelled)[0]


FIELD = r"(?im)^([ \t]*)(?:admission date|discharge date|collected|resulted|result date|collection date|date)([ \t]*:[ \t]*\[(?:Hospital Day|Historical|[0-9]+ (?:day|month|year)))"


def renamed_fields(text: Column) -> Column:
    """Names of date fields in front of timeline labels as Timeline."""
    return F.regexp_replace(text, FIELD, "$1Timeline$2")


LEGACY = (
    (r"(?i)\[(?:date|exact date|admission date|service date)\]", "[Historical date]"),
    (r"(?i)\[hospital day #? ?([0-9]+)\]", "[Hospital Day $1]"),
    (r"(?i)\[(?:HD|hosp day) ?([0-9]+)\]", "[Hospital Day $1]"),
    (r"(?i)\[(?:date of birth|birth date)\]", "[DOB]"),
)


def converted(text: Column) -> Column:
    """Placeholders of older texts in today's form."""
    for pattern, now in LEGACY:
        text = F.regexp_replace(text, pattern, now)
    return text


def inferred_year(month: Column, day: Column, said: Column, fallback: Column, weight: int = 3) -> Column:
    """The year that puts a day nearest to the explicit days of its text: least sum of weighted distances, then nearest to ``fallback``.

    ``said`` holds (date, current); days in current context weigh ``weight`` times.
    """
    years = F.array_distinct(F.flatten(F.transform(said, lambda s: F.array(F.year(s.date) - 1, F.year(s.date), F.year(s.date) + 1))))

    def scored(y: Column) -> Column:
        own = F.try_to_date(F.concat_ws("-", y, month, day), "yyyy-M-d")
        far = F.aggregate(said, F.lit(0).cast("long"), lambda a, s: a + F.abs(F.datediff(own, s.date)) * F.when(s.current, weight).otherwise(1))
        return F.struct(far.alias("far"), F.abs(y - fallback).alias("off"), y.alias("y"))

    return F.coalesce(F.array_min(F.filter(F.transform(years, scored), lambda s: s.far.isNotNull())).y, fallback)
