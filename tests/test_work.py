"""What saves work in a row finds the same: boundaries, words of rules, capitals, guards asked late, verdicts remembered."""

import re
from dataclasses import replace

from pyspark.sql import functions as F

from veilspan.functions.expr import cut, fold, let, plain
from veilspan.functions.rules import DIRECT_RULES, FIELD_RULES, RESIDUAL_RULES, Rule, ascii_bounds, in_lines, sought
from veilspan.operators import chain, clinical, dates, people, spans, vocabulary
from veilspan.plans import base, chain_queries, clinical_queries, corpus_queries, people_queries
from veilspan.plans.guard_sql import named_vocabulary

SF = "/root/testdata/sf0.001"
EITHER = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
ALL = [*FIELD_RULES, *DIRECT_RULES, *RESIDUAL_RULES, *people.CONTEXT_RULES]
ODD = ["", "'-Abc O'Neil 'tis -x Jo-Ann éAbc Abcé A' -'B", "éInsurer: Big Co. Insurer: Big Co, INSURER = X", "aRoom 12B Room 12B éRoom 7, bed 3a", "DOB 1/2/1990 xD0B=1/2/90 d0b = 3/4/91 Born on: 3/4/1990", "Csn: AB12345 Visit ID: QQ1234",
       "Dr. Ann Lee\u212anight, NPI 1234567890 LAST WEEK", "Ann Lee is a 40 year old. Bo Fox, 50 y/o", "A.B C. Dent, PATIENT ANN LEE; Also documented as Ann Lee"]


def texts(spark):
    odd = spark.createDataFrame([(-i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs = base.table(spark, SF, "documents").select(F.col("doc_id").cast("long"), "text")
    return odd.unionByName(docs.limit(60)).unionByName(corpus_queries.cases(spark, SF).select("doc_id", "text")).unionByName(people_queries.stories(spark, SF).limit(60).select(F.col("doc_id").cast("long"), "text")).persist()


def test_boundaries_that_must_open_a_word_look_back_only():
    for r in ALL:
        opening = re.findall(r"\\b(?=\((?:\?i?:)?[A-Za-z])", r.pattern)
        assert ascii_bounds(r.pattern).count(EITHER) <= r.pattern.count(r"\b") - len(opening), r.name
    assert ascii_bounds(r"(?i:\b(?:insurance|insurer))x") == r"(?i:(?<!\w)(?:insurance|insurer))x"
    for kept in (r"\b(?:a|)b", r"\b(?:a)?-", r"\b(?:a|-)b", r"a\b", r"\b[^a]", r"\b(?=a)", r"\ba*-", r"\b\(a"):
        assert EITHER in ascii_bounds(kept), kept


def test_rules_find_the_same_with_fast_boundaries_and_words(spark):
    plain = [replace(r, pattern=re.sub(r"(?<!\\)\\b", lambda _: EITHER, r.pattern), words=()) for r in ALL]
    both = texts(spark).select("doc_id", spans.find("text", ALL).alias("a"), spans.find("text", plain).alias("b"))
    assert both.where("a <> b").collect() == []
    assert {r.name for r in ALL if r.words} >= {"inline_insurer", "ocr_dob", "left_age", "relative"}
    assert both.selectExpr("sum(size(a)) as n").first().n > 500


def test_capitals_are_the_words_that_begin_with_one(spark):
    words = f"filter({spans.find_expr('text', [people.WORD])}, w -> w.value rlike '^[A-Z]')"
    slim = lambda x: f"transform({x}, w -> struct(w.start, w.end, w.value))"
    both = texts(spark).select("text", F.expr(slim(words)).alias("a"), F.expr(slim(spans.find_expr("text", [people.CAPITAL]))).alias("b"))
    assert both.where("a <> b").collect() == []


def test_guards_asked_late_decide_as_all_facts_do(spark):
    words, row = named_vocabulary(spark), "struct(j.start, j.end, j.verdict.label as label, j.source)"
    for rows in (clinical_queries.offers(spark, SF), texts(spark).withColumn("found", F.expr(spans.merged_expr(f"concat({spans.sourced_expr(spans.find_expr('text', [*FIELD_RULES, *DIRECT_RULES]))}, {spans.sourced_expr(spans.find_expr('text', [clinical_queries.OFFERED]), 'model')})", "text")))):
        both = vocabulary.looked_up(rows, words, "a", lambda v: f"filter(transform({clinical.judged_expr('text', 'found', v)}, j -> {row}), j -> j.label is not null)")
        both = vocabulary.looked_up(both, words, "b", lambda v: clinical.kept_expr("text", "found", v)).persist()
        assert both.where("a <> b").collect() == [] and both.selectExpr("sum(size(b)) as n").first().n > 40


def test_a_judged_span_is_not_judged_again(spark):
    one = "named_struct('start', cast(0 as bigint), 'end', cast(8 as bigint), 'label', 'NAME', 'source', 'alias')"
    docs = spark.createDataFrame([("Ann Lee1 Bob Fox2",)], "text string")
    said = vocabulary.looked_up(docs, named_vocabulary(spark), "j", lambda v: chain._judged("text", f"array({one}, named_struct('start', cast(9 as bigint), 'end', cast(16 as bigint), 'label', 'PHONE', 'source', 'alias'))", f"array(named_struct('s', {one}, 'becomes', 'REMEMBERED'))", v)).first().j
    assert [(r.s.start, r.becomes) for r in said] == [(0, "REMEMBERED"), (9, "PHONE")]


def test_stories_are_spread(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 4, true" in plan(people_queries.name_evidence(spark, SF))


def test_a_task_has_a_bounded_number_of_rows(spark):
    assert base.spread(spark.read.parquet(f"{SF}/customer.parquet"), most=10).rdd.getNumPartitions() == 15


LINES = ["Patient: Ann Lee\rName: Bo Fox DOB: 1/2/1990\r\n\n Room: 12B\nMRN: AB1234 MRN = CD5678", "(202) 555-0142 202.555.0143 a202-555-0144\n+1 (202) 555-0145", "Provider  __ : Dr. Ann Lee é\n\u2028Fax: 202-555-0142", "one\u0001 SN-K123 and SN-K456\u0001\nSeen by Dr. Bo Fox", "x\nx\nx SN-A1\n\nSN-B2"]


def test_lines_and_signs_that_rules_need_leave_no_match_out(spark):
    every = [*ALL, *dates.RULES]
    bare = [replace(r, words=(), needs="", shape="", before=False) for r in every]
    docs = texts(spark).select("text").unionByName(spark.createDataFrame([(t,) for t in LINES], "text string"))
    both = docs.select("text", spans.find("text", every).alias("a"), spans.find("text", bare).alias("b")).persist()
    assert both.where("a <> b").collect() == []
    assert both.where("exists(a, x -> substr(text, int(x.start + 1), int(x.end - x.start)) <> x.value)").collect() == []
    phones = both.where("text like '(202)%'").selectExpr("filter(a, x -> x.rule = 'us_phone').value as v").first().v
    assert phones == ["(202) 555-0142", "202.555.0143", "+1 (202) 555-0145"]


def test_what_a_search_looks_at_first_is_what_a_match_begins_with():
    assert sought(r"a|[b-d]\d") == r"(?=[abcd])(?:a|[b-d]\d)" and sought(r"(?i)x?y") == r"(?=[XYxy])(?i)x?y" and sought(r"(?:a|(?:b)?)\.") == r"(?=[\.ab])(?:a|(?:b)?)\."
    for kept in (r"[^a]b", r".a", r"a*", r"(?=a)b", r"\s+a", r"(?i)a|b", r"é", r"\Qa\E"):
        assert sought(kept) == kept
    assert in_lines(r"(?im)(^[ \t]*a)([^\n|]+)") and in_lines(r"https?://[^\s)]+")
    assert not any(map(in_lines, (r"a\s+b", r"[^a]+", r"^a", r"a$", r"(?s)a.b", r"a\nb", r"(?<=a)b", r"\W", "a\nb")))


def test_a_rule_over_several_lines_is_searched_in_the_whole_text(spark):
    rule = Rule("two", "ID", r"id:\s+[0-9]+", words=("id:",))
    assert [(r.start, r.end) for r in spans.detect(spark.createDataFrame([(1, "an\nid:\n12 id: 3")], "doc_id int, text string"), [rule]).collect()] == [(3, 9), (10, 15)]


def test_folds_of_all_lengths_and_cuts_of_all_texts(spark):
    sums = fold("v", "cast(0 as bigint)", "bigint", lambda s, x: (f"{s} + {x}", f"if({x} % 3 = 0, array({s} + {x}), cast(array() as array<bigint>))"), "sum")
    for n in (0, 1, 15, 16, 17, 255, 256, 257, 1000):
        got = spark.range(1).select(F.expr(let("v", f"if({n} > 0, sequence(1L, {n}L), cast(array() as array<bigint>))", sums))).first()[0]
        assert got == [k * (k + 1) // 2 for k in range(1, n + 1) if k % 3 == 0], n
    given = spark.createDataFrame([("abcdef",), ("abéçef",), ("",), (None,)], "t string").withColumn("p", F.expr(plain("t")))
    assert [tuple(r) for r in given.select(F.expr(cut("t", "2", "3", "p")), F.col("p").isNull()).collect()] == [("cde", False), ("éçe", True), ("", False), (None, True)]


def test_a_run_writes_only_what_its_query_reads(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(chain_queries, "settled", lambda df: seen.append(df.columns) or df)
    chain_queries.run_grade(spark, SF)
    chain_queries.run_results(spark, SF)
    assert seen == [["truth", "found"], ["doc_id", "protected", "found", "output"]]
