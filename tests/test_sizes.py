"""What keeps queries in proportion to their input, and their rows the same wherever they run."""

from pyspark.sql import functions as F

from veilspan.functions.rules import DIRECT_RULES
from veilspan.operators import lines, spans
from veilspan.plans import date_queries, guard_queries, more_queries, packet_queries, span_queries
from veilspan.sources import corpus

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_corpus_searches_each_value_once(spark):
    made = corpus.cases(spark.range(3))
    assert optimized(made).count("split(") == 2  # one search for identifiers and one for protected phrases, in their lambdas
    row = made.where("doc_id = 1").first()
    assert row.truth == sorted(row.truth) and all(row.text[s.start : s.end] == s.value for s in row.truth + row.protected)
    assert all(sum(s.key == key for s in row.truth) == row.text.count(next(s.value for s in row.truth if s.key == key)) for key, _, _ in corpus.IDENTIFIERS)


def test_dated_notes_are_spread_and_dated_once(spark):
    assert date_queries.dated_notes(spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    searched = lambda q: optimized(q(spark, SF)).count("yesterday|today")
    assert searched(date_queries.date_anchor) == searched(date_queries.date_values)


def test_customers_notes_are_spread(spark):
    for q in (span_queries.note_rule_spans, guard_queries.label_priority, more_queries.deid_text_length):
        assert "Repartition 4, true" in optimized(q(spark, SF))


def test_word_boundaries_are_ascii(spark):
    rows = spark.createDataFrame([(1, "éhr 72"), (2, "xhr 72"), (3, "é123-45-6789 ")], "doc_id long, text string")
    assert {r.doc_id: r.k for r in rows.select("doc_id", lines.kind(F.col("text")).alias("k")).collect()} == {1: "vitals", 2: "lab", 3: "narrative"}
    assert [(r.doc_id, r.start) for r in spans.detect(rows, [r for r in DIRECT_RULES if r.name == "ssn"]).collect()] == [(3, 1)]


def test_merging_does_not_depend_on_the_order_of_rows(spark):
    found = spark.createDataFrame([(1, 0, 16, "ID", "pattern", 1), (1, 0, 16, "ID", "model", 2)], "doc_id long, start long, end long, label string, source string, rank int")
    for down in (False, True):
        given = found.coalesce(1).sortWithinPartitions(F.desc("rank") if down else "rank")
        assert [r.source for r in spans.merge(given, order=["rank"]).collect()] == ["pattern+model"]
    assert {spans.merge(found.coalesce(1).sortWithinPartitions(c)).first().source for c in (F.asc("rank"), F.desc("rank"))} == {"model+pattern"}


def test_bundles_are_decoded_once(spark):
    for q in (packet_queries.checklist_codes, packet_queries.return_codes, packet_queries.return_inputs):
        assert optimized(q(spark, SF)).count("unbase64(") <= 3  # once, and once for each condition on what it holds


def test_grading_stays_in_the_row(spark):
    assert "Join" not in optimized(guard_queries.case_scores(spark, SF))
