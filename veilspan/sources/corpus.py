"""A synthetic corpus for measuring: long notes with twenty identifiers each and clinical phrases that must stay.

Everything follows from the case's number. A note has over ``LEAST`` characters: blocks of course
notes, with the identifiers repeated in several layouts, and wording that looks like names, dates or
codes but is none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import fold, let, literal, struct

PLACE = "struct<start:bigint,end:bigint,category:string,key:string,value:string>"
LEAST = 10_000
FIRST = ["Avery", "Blake", "Casey", "Devon", "Emery", "Finley", "Harper"]
LAST = ["Archer", "Brooks", "Carver", "Dalton", "Ellis", "Fisher", "Grant", "Hollis", "Irwin", "Jarvis", "Keller"]
STREETS = ["Maple Street", "Harbor Road", "Orchard Lane", "Station Avenue", "Mill Court"]
JOBS = ["baker", "bus driver", "piano tuner", "ship welder"]
PROTECTED = [
    "Graves disease was ruled out by antibody testing",
    "Blood pressure 128/76 mmHg with pulse 71 bpm at rest",
    "May take a walk in March weather if pain allows",
    "Potassium 4.2 mmol/L and sodium 140 mmol/L this morning",
    "Babinski sign absent, Romberg stance steady",
    "Pain rated 3/10 after 5 mg of oxycodone",
    "Wilson disease and Cushing disease stay on the list",
    "Ejection fraction 55 percent with 2/6 systolic murmur",
]

#: key, category, and the parts of the value: texts, and names of columns in braces
IDENTIFIERS = [
    ("patient", "PATIENT NAME", "{first} {last}"),
    ("caps_name", "PATIENT NAME", "{LAST}, {FIRST}"),
    ("alias", "PATIENT NAME", "{last} {first}"),
    ("provider", "PROVIDER NAME", "Dr. {last2} Ostrow"),
    ("contact", "CONTACT NAME", "{first2} Lindqvist"),
    ("dob", "DOB", "{m}/{d}/{birth}"),
    ("admitted", "DATE", "{m}/{d2}/2026"),
    ("stamp", "DATE", "2026-{mm}-{dd}T{hh}:{mi}:00Z"),
    ("mrn", "MRN", "MR{n7}"),
    ("account", "ID", "AC{n7}"),
    ("device", "ID", "SN-K{n7}"),
    ("ssn", "ID", "{n3}-{n2}-{n4}"),
    ("phone", "PHONE", "({n3}) 555-{n4}"),
    ("fax", "PHONE", "{n3}-555-{n4b}"),
    ("email", "EMAIL", "{first}.{last}{i}@mail.example.org"),
    ("ip", "IP", "192.0.2.{b}"),
    ("url", "URL", "https://records.example.org/case/{i}"),
    ("address", "ADDRESS", "{house} {street}, Easton, ZZ {n5}"),
    ("employer", "ORGANIZATION", "Tallow Works Cooperative"),
    ("room", "ROOM", "Room {n3}B"),
]
#: the layouts that repeat; %key% stands for an identifier's value
LAYOUTS = [
    "PATIENT: %patient%\nALIAS: %alias%\nDOB: %dob%\nMRN: %mrn%\nACCOUNT: %account%\n",
    "HEADER >>> %caps_name% >>> seen in %room% by %provider%\nCall %phone% or fax %fax% or write to %email% today\n",
    "Export|%stamp%|%device%|%ip%|%url% |%ssn%|%address%|end\n",
    "Emergency contact: %contact%\nEmployer: %employer%\nAdmission date: %admitted%\nProvider: %provider%\n",
]
BLOCK = (
    "Course block {r}: {p}. The person works as a {j} and slept well. Heart sounds regular, lungs clear, abdomen soft. "
    "The plan holds fluids, mobility and a repeat of the tests; side effects were explained and no new complaints came up. "
    "This wording only lengthens the note so that what has to be found lies far apart, as it does in real ones.\n"
)
ROUNDS = 24


def fields(i: Column) -> dict[str, Column]:
    """The parts that values are made of, from the case's number."""
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    text = lambda c: c.cast("long").cast("string")
    pad = lambda c, n: F.lpad(text(c), n, "0")
    first, last = pick(FIRST, i), pick(LAST, F.floor(i / 7))
    m, d, d2 = i % 12 + 1, i % 28 + 1, (i * 5) % 28 + 1
    return {
        "i": text(i), "first": first, "last": last, "FIRST": F.upper(first), "LAST": F.upper(last), "first2": pick(FIRST, i + 3), "last2": pick(LAST, i + 5),
        "m": text(m), "d": text(d), "d2": text(d2), "mm": pad(m, 2), "dd": pad(d2, 2), "hh": pad(i % 24, 2), "mi": pad(i * 7 % 60, 2), "birth": text(1940 + i % 60),
        "n7": pad(1_000_000 + i, 7), "n5": pad(10_000 + i % 80_000, 5), "n4": pad(1000 + i % 9000, 4), "n4b": pad(1000 + (i + 17) % 9000, 4), "n3": text(200 + i % 700), "n2": text(10 + i % 80),
        "b": text(1 + i % 250), "house": text(100 + i % 900), "street": pick(STREETS, i),
    }


def _filled(pattern: str, values: dict[str, Column], mark: str) -> Column:
    """The pattern with its marked names replaced by columns."""
    parts, rest = [], pattern
    while rest:
        before, _, rest = rest.partition(mark[0])
        if before:
            parts.append(F.lit(before))
        if rest:
            name, _, rest = rest.partition(mark[1])
            parts.append(values[name])
    return F.concat(*parts)


def cases(ids: DataFrame, column: str = "id") -> DataFrame:
    """``(doc_id, text, truth, protected)`` for each number: arrays of (start, end, category, key, value), by place.

    All occurrences of an identifier count as true spans, in the row.
    """
    i = F.col(column)
    parts = fields(i)
    # steps of their own, so that each part and value is worked out once, however often the note repeats it
    made = ids.select(i.alias("doc_id"), *[v.alias(f"p{n}") for n, v in enumerate(parts.values())])
    parts = {k: F.col(f"p{n}") for n, k in enumerate(parts)}
    made = made.select("doc_id", *[_filled(pattern, parts, "{}").alias(f"v_{key}") for key, _, pattern in IDENTIFIERS])
    i, values, rounds = F.col("doc_id"), {key: F.col(f"v_{key}") for key, _, _ in IDENTIFIERS}, []
    for r in range(ROUNDS):
        pick = lambda given: F.element_at(F.array(*[F.lit(v) for v in given]), ((i + r) % len(given) + 1).cast("int"))  # noqa: B023, E731
        rounds.append(_filled(BLOCK, {"r": F.lit(str(r + 1)), "p": pick(PROTECTED), "j": pick(JOBS)}, "{}"))
        if r % 2 == 0:
            rounds.append(_filled(LAYOUTS[r // 2 % len(LAYOUTS)], values, "%%"))
    made = made.withColumn("text", F.concat(*rounds))
    truth = [(f"v_{key}", category, key) for key, category, _ in IDENTIFIERS]
    kept = [(literal(p), "CLINICAL NON-PHI", f"guard{n}") for n, p in enumerate(PROTECTED)]
    return made.select("doc_id", "text", places("text", truth).alias("truth"), places("text", kept).alias("protected"))


def places(text: str, values: Sequence[tuple[str, str, str]]) -> Column:
    """All occurrences of values, by place: an array of (start, end, category, key, value).

    ``values`` holds (value, category, key), the value as SQL text. Each value is searched once, its places are sums over what lies between.
    """
    given = ", ".join(struct(v=v, category=literal(c), key=literal(k)) for v, c, k in values)

    def step(at: str, gap: str) -> tuple[str, str]:
        start = f"{at} + length({gap})"
        return f"{start} + length(pv.v)", f"array({struct(start=start, end=f'{start} + length(pv.v)', category='pv.category', key='pv.key', value='pv.v')})"

    gaps = r"split(pt, concat('\\Q', pv.v, '\\E'), -1)"
    each = fold(let("pg", gaps, "slice(pg, 1, size(pg) - 1)"), "cast(0 as bigint)", PLACE, step, "place")
    return F.expr(let("pt", text, f"sort_array(flatten(transform(array({given}), pv -> {each})))"))
