"""Model hook, growing sections, foreign outputs, rules in tables and readers, on odd inputs."""

import re

import pytest
from pyspark.sql import functions as F

from veilspan.functions import rules
from veilspan.functions.rules import DIRECT_RULES, FIELD_RULES, Rule
from veilspan.operators import model, spans, text
from veilspan.sources import files, vocabularies
from veilspan.streaming import sections


def words(limit, message="the input sequence is too long"):
    def run(texts):
        if any(len(t) > limit for t in texts):
            raise ValueError(message)
        return [[(m.start(), m.end(), "W", 0.9) for m in re.finditer(r"\w+", t)] for t in texts]

    return run


@pytest.mark.parametrize("size, overlap, limit", [(700, 80, 10_000), (50, 20, 10_000), (50, 20, 13), (1000, 100, 70)])
def test_parts_and_halves_find_what_the_whole_has(size, overlap, limit):
    t = " ".join(f"w{'x' * (i % 7)}{i}" for i in range(200)) + "\nend. last"
    want = [(m.start(), m.end(), "W", 0.9) for m in re.finditer(r"\w+", t)]
    assert model.spans_of(t, words(limit), size, overlap, depth=8) == want
    assert model.spans_of("", words(limit)) == []


def test_other_errors_and_too_deep_halving_are_raised():
    with pytest.raises(ValueError, match="network"):
        model.spans_of("a b c d e f", words(3, "network down"))
    with pytest.raises(ValueError, match="too long"):
        model.spans_of("x" * 600, words(3), depth=2)


def test_candidates_are_tried_in_order():
    def broken():
        raise OSError("gone")

    assert model.first_that_loads([broken, lambda: "second"]) == "second"
    with pytest.raises(OSError):
        model.first_that_loads([broken, broken])


def test_sections_step():
    safe = sections.redactor([DIRECT_RULES[0], *FIELD_RULES[:1]])
    assert safe("a.b@c.org and d@e.org") == "[EMAIL] and [EMAIL]" and safe("Patient: Ann Lee\nx") == "Patient: [PATIENT NAME]\nx"
    first = sections.step(None, 1, "mail a@b.org", safe)
    assert first == ("full", "mail [EMAIL]")
    last = (1, "mail a@b.org", "mail [EMAIL]")
    assert sections.step(last, 2, "mail a@b.org", safe) == ("unchanged", "mail [EMAIL]")
    assert sections.step(last, 2, "mail a@b.org\n\n and c@d.org \n", safe) == ("append", "mail [EMAIL]\n\n and [EMAIL] \n")
    assert sections.step(last, 2, "mail a@b.org \n ", safe) == ("append", "mail [EMAIL] \n ")
    assert sections.step(last, 2, "new x@y.org", safe) == ("full", "new [EMAIL]")
    assert sections.step((1, "", ""), 2, "x@y.org", safe) == ("full", "[EMAIL]")


def test_sections_ignore_what_is_not_newer(spark, tmp_path):
    rows = [(1, 1, "a@b.org"), (1, 3, "a@b.org c@d.org"), (1, 2, "late"), (2, 1, None), (1, 3, "again")]
    kind = "k long, v long, t string"
    out = []
    for part in (rows[:1], rows[1:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = sections.incremental(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), "k", "v", "t", [DIRECT_RULES[0]])
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        out = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("k", "v", "mode", "t").collect())
    assert out == [(1, 1, "full", "[EMAIL]"), (1, 2, "full", "late"), (1, 3, "full", "[EMAIL] [EMAIL]"), (2, 1, "full", "")]


def test_alignment(spark):
    def at(source, output, *found):
        rows = spark.createDataFrame([(source, output, [(a, b, "X", "m") for a, b in found])], "s string, o string, f array<struct<start:bigint,end:bigint,label:string,source:string>>")
        return [(r.replacement, r.output_start) for r in rows.select(F.inline(text.aligned("s", "f", "o"))).collect()]

    assert at("on 3/4 Ann came", "on [2 days ago] [NAME] came", (3, 6), (7, 10)) == [("[2 days ago]", 3), ("[NAME]", 16)]
    assert at("Ann", "[NAME]", (0, 3)) == [("[NAME]", 0)]
    assert at("Ann slept", "[NAME] slept", (0, 3)) == [("[NAME]", 0)]
    assert at("call Ann", "call ", (5, 8)) == [("", 5)]
    assert at("say Ann twice", "all is other", (4, 7)) == [(None, 0)]


def test_rules_of_a_table(spark):
    given = FIELD_RULES[:3] + DIRECT_RULES[:2]
    table = rules.as_table(spark, given).withColumn("ord", F.monotonically_increasing_id())
    assert rules.from_table(table) == given
    few = spark.createDataFrame([("b", "B", "x+"), ("a", "A", "y+")], "name string, label string, pattern string")
    assert [r.name for r in rules.from_table(few)] == ["a", "b"]
    for bad in ([("a", "A", "x"), ("a", "B", "y")], [("a", None, "x")], [("", "A", "x")]):
        with pytest.raises(ValueError):
            rules.from_table(spark.createDataFrame(bad, "name string, label string, pattern string"))


def test_tails_are_no_part_of_a_value(spark):
    docs = spark.createDataFrame([(1, "call Ann now, call Bob now"), (2, None)], "doc_id long, text string")
    rule = Rule("r", "N", r"(call )([A-Z][a-z]+)( now)", field=True, tail=True)
    assert [(r.start, r.end, r.value) for r in spans.detect(docs, [rule]).collect()] == [(5, 8, "Ann"), (19, 22, "Bob")]


def test_readers_set_bad_lines_apart(spark, tmp_path):
    (tmp_path / "v.csv").write_text('id,name\n1,one\nx,two\n3,three,extra\n4,"fo,ur"\n\n5,\n')
    good, bad = vocabularies.read_csv(spark, str(tmp_path / "v.csv"), "id int, name string")
    assert sorted((r.id, r.name) for r in good.collect()) == [(1, "one"), (4, "fo,ur"), (5, None)] and sorted(r.line for r in bad.collect()) == ["3,three,extra", "x,two"]
    (tmp_path / "v.xml").write_text("<all><rec><name>Heart failure</name><n>1</n></rec><rec><name>b</name><n>two</n></rec><skip/></all>")
    good, bad = vocabularies.read_xml(spark, str(tmp_path / "v.xml"), "rec", "name string, n int")
    assert [r.name for r in good.collect()] == ["Heart failure"] and bad.count() == 1
    assert sorted(r.term for r in vocabularies.terms_of(good, "clinical").collect()) == ["failure", "heart", "heart failure"]


def test_cases_of_json_lines(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"id":"1","text":"Ann slept","annotations":[{"start":0,"end":3,"category":"NAME"}]}\nnot json\n{"id":"2","text":"x","annotations":[{"start":0,"end":9}]}\n')
    read = files.read_cases(spark, str(tmp_path / "c.json"))
    assert sorted((r.id or "", r.text or "", r.bad or "") for r in read.collect()) == [("", "", "not json"), ("1", "Ann slept", ""), ("2", "x", "")]
    assert [tuple(r) for r in files.problems(read.where("id is not null"), 1, 1).collect()] == [("2", "span out of range")]
