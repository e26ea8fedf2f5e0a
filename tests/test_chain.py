"""The whole way from a text to a safe one: what has to go, what has to stay, and odd rows."""

import pytest
from pyspark.sql import functions as F

from veilspan.operators import chain, clinical, vocabulary
from veilspan.plans import clinical_queries
from veilspan.plans.guard_sql import NAMED, named_vocabulary

DAY = "2026-06-15"

GO = {
    "Seen 3/4/2026, born DOB 1/2/1960.": ["3/4/2026", "1/2/1960"],
    "Spoke with Ann Graves about it.": ["Ann", "Graves"],
    "Patient Name: Ann Graves MRN: 1234567": ["Ann", "Graves", "1234567"],
    "Patient: Ann Graves, MD. Slept well today": ["Ann", "Graves"],
    "PATIENT: ELLIS, CASEY J\nMRN: 4429871": ["ELLIS", "CASEY", "4429871"],
    "Emergency contact: Harper Keller (sister), phone on file.": ["Harper", "Keller"],
    "Called Devon Fisher to confirm the ride.": ["Devon", "Fisher"],
    "Read by Dr. Okafor, MD elsewhere.": ["Okafor"],
    "Patient: Robin Archer\nMr. Archer rests. ARCHER, ROBIN sleeps. Jo Archer came by.": ["Archer", "ARCHER", "Robin", "ROBIN", "Jo Archer"],
    "Avery Brooks is a 61 year old man. Brooks slept.": ["Avery", "Brooks"],
    "Write to a.b@mail.example.org, 10.1.2.3, (202) 555-0143.": ["a.b@", "10.1.2.3", "555-0143"],
}
STAY = {
    "Graves disease and a Foley catheter; Babinski sign absent.": ["Graves", "Foley", "Babinski"],
    "Glasgow Coma Scale 15. Wells score 2. Allen test fine.": ["Glasgow", "Wells", "Allen"],
    "Patient: Ann Graves, MD. Slept well and ate": ["MD", "Slept well and ate"],
    "Patient Name: Ann Graves MRN: 1234567": ["Patient Name:", "MRN:"],
    "IP 999.1.1.1 is none": ["999.1.1.1"],
    "CBC: WBC 8.8, Hgb 10.2\nPain 3/10, BP 128/76 mmHg": ["WBC 8.8", "10.2", "3/10", "128/76"],
}


@pytest.fixture(scope="module")
def safe(spark):
    texts = [*GO, *STAY, None, "", " \n ", "x" * 5000]
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, spans string").drop("spans")
    rows = chain.deidentify(docs, named_vocabulary(spark), reference=F.lit(DAY).cast("date")).collect()
    return texts, {r.doc_id: r for r in rows}


def test_what_has_to_go_and_to_stay(safe):
    texts, rows = safe
    at = {t: i for i, t in enumerate(texts)}
    for text, gone in GO.items():
        for word in gone:
            assert word not in rows[at[text]].text, (text, rows[at[text]].text)
    for text, kept in STAY.items():
        for word in kept:
            assert word in rows[len(GO) + list(STAY).index(text)].text, (text, rows[len(GO) + list(STAY).index(text)].text)


def test_spans_are_disjoint_and_give_the_text(safe):
    texts, rows = safe
    for i, t in enumerate(texts):
        if t is None:
            assert rows[i].text is None and rows[i].spans is None
            continue
        out, at = "", 0
        for s in rows[i].spans:
            assert at <= s.start < s.end
            out += t[at : s.start] + f"[{s.placeholder}]"
            at = s.end
        out += t[at:]
        assert out == rows[i].text or "Timeline" in rows[i].text


def test_a_model_adds_what_rules_leave(spark):
    docs = spark.createDataFrame([(1, "we saw Zorba Quill there", [(7, 18, "NAME")]), (2, "no spans", None)], "doc_id long, text string, m array<struct<start:bigint,end:bigint,label:string>>")
    got = {mode: {r.doc_id: r.text for r in chain.deidentify(docs, named_vocabulary(spark), model="m", mode=mode).collect()} for mode in ("structured", "model", "hybrid")}
    assert got["structured"][1] == "we saw Zorba Quill there" and got["model"][1] == got["hybrid"][1] == "we saw [NAME] there" and got["hybrid"][2] == "no spans"
    with pytest.raises(ValueError):
        chain.deidentify(docs, named_vocabulary(spark), mode="model")


def test_every_verdict_occurs(spark):
    reasons = {r.reason for r in clinical_queries.span_verdicts(spark, "/root/testdata/sf0.001").collect()}
    assert reasons == {name for name, _, _ in clinical.CASES} | {"keep"}


def test_vocabulary(spark):
    terms = vocabulary.terms(spark, NAMED | {"clinical": [f"term {i}" for i in range(3000)] + ["", "Heart-rate"]}).unionByName(spark.createDataFrame([(None, "clinical"), ("x", "unknown")], "term string, kind string"))
    docs = spark.createDataFrame([("term 7",), ("term 2999",), ("HEART rate",), ("graves",), ("nothing",), (None,)], "t string")
    found = vocabulary.looked_up(docs, terms, "k", lambda v: vocabulary.kinds_expr(v, vocabulary.normal_expr("t")))
    bit = vocabulary.bit
    assert [r.k for r in found.collect()] == [bit("clinical")] * 3 + [bit("eponym"), 0, 0]
    with pytest.raises(ValueError):
        vocabulary.compiled(terms, limit=100)
