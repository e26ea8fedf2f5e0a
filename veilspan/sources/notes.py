"""A deterministic corpus of synthetic notes with known identifier spans, one note per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST = ["Avery", "Blake", "Casey", "Devon", "Emery", "Finley", "Harper"]
LAST = ["Archer", "Brooks", "Carver", "Dalton", "Ellis", "Fisher", "Grant", "Hollis", "Irwin", "Jarvis", "Keller"]


def notes(customers: DataFrame) -> DataFrame:
    """``(doc_id, text, truth)``; truth is an array of (start, end, category, key)."""
    k = F.col("c_custkey")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    name = F.concat(pick(FIRST, k), F.lit(" "), pick(LAST, F.floor(k / 7)))
    day = F.date_add(F.lit("1950-01-01").cast("date"), (k * 37 % 18000).cast("int")).cast("string")
    values = [
        ("Patient: ", name, "PATIENT NAME"),
        ("\nDOB: ", day, "DOB"),
        ("\nMRN: ", (k + 1000000).cast("string"), "MRN"),
        ("\nPhone: ", F.concat(F.lit("("), (k % 800 + 200).cast("string"), F.lit(") 555-"), F.lpad((k % 10000).cast("string"), 4, "0")), "PHONE"),
        ("\nEmail: ", F.concat(F.lit("user"), k.cast("string"), F.lit("@mail.example.org")), "EMAIL"),
        ("\nEmployer: ", F.concat(F.lit("Unit "), (k % 90).cast("string"), F.lit(" Works")), "ORGANIZATION"),
    ]
    clinical = F.concat(
        F.lit("\nLabs:\nWBC 7."), (k % 10).cast("string"), F.lit(" (4.0-11.0)\nstable\nSodium 13"), (k % 10).cast("string"),
        F.lit(" mmol/L\nBP 1"), (k % 60 + 10).cast("string"), F.lit("/80 HR 72\nmetoprolol 25 mg BID\n\n\nAssessment: improving"),
    )
    at, parts, truth = F.lit(0), [], []
    for lead, value, category in values:
        start = at + len(lead)
        parts += [F.lit(lead), value]
        at = start + F.length(value)
        truth.append(F.struct(start.alias("start"), at.alias("end"), F.lit(category).alias("category"), value.alias("key")))
    return customers.select(k.alias("doc_id"), F.concat(*parts, clinical).alias("text"), F.array(*truth).alias("truth"))
