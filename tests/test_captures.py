"""Captures, libraries and anchors on odd rows."""

import datetime

from pyspark.sql import functions as F

from veilspan.operators import captures, dates, lines

NOW = datetime.datetime(2030, 1, 1)


def test_captures_take_defaults(spark):
    rows = [("a", "results", " ", "t", None, None, None), (None, None, None, None, None, None, None), ("", "pre_round_physical_exam", "own", "x", NOW, None, None), ("b", "unknown", None, "y", None, NOW, NOW)]
    got = captures.captures(spark.createDataFrame(rows, "id string, kind string, label string, text string, captured timestamp, created timestamp, updated timestamp"), F.lit(NOW)).collect()
    assert [(r.kind, r.label, r.text) for r in got] == [("results", "Results", "t"), ("other_chart_text", "Other chart text", ""), ("physical_exam", "own", "x"), ("other_chart_text", "Other chart text", "y")]
    assert got[1].id.startswith("capture_") and got[2].id.startswith("capture_") and got[1].id != got[2].id and all(r.captured == r.created == r.updated == NOW for r in got)
    context = spark.createDataFrame([("physical_exam",)], "k string").select(captures.kind(F.lit("context"), F.col("k"))).first()[0]
    assert context == "prior_physical_exam"


def test_sections_without_text_or_warning_go(spark):
    rows = [("1", "key_results", "l", "t", 0, NOW, None), ("2", "key_results", "l", " ", 0, NOW, None), ("3", None, None, None, 2, None, NOW), ("4", "odd", None, "x", None, NOW, NOW)]
    got = captures.migrated(spark.createDataFrame(rows, "id string, role string, label string, text string, warned int, created timestamp, updated timestamp")).collect()
    assert [(r.id, r.kind) for r in got] == [("1", "results"), ("3", "other_chart_text"), ("4", "other_chart_text")]


def test_libraries_name_all_problems(spark):
    rows = [(captures.LIBRARY, "lib.1", "T", None, None, ["a", "b"]), (None, None, " ", "2", "d", None), (captures.LIBRARY, "a b", "T", "", "", ["a", "a"])]
    got = captures.libraries(spark.createDataFrame(rows, "schema string, id string, title string, version string, description string, workups array<string>")).collect()
    assert (got[0].problems, got[0].version) == ("", "1.0.0")
    assert got[1].problems.count(";") == 4 and "id is required" in got[1].problems and "title" in got[1].problems and got[1].workups == []
    assert got[2].problems == "id must be URL-safe; workup ids must be unique within a library"


def test_anchors(spark):
    day = datetime.date
    stays = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id int")
    given = spark.createDataFrame([(1, 1, "2026-05-01"), (1, 2, "2026-05-02"), (1, 3, "5/3/2026"), (2, 1, "2026-02-31"), (2, 2, None)], "id int, at int, text string")
    days = spark.createDataFrame([(1, day(2020, 1, 1)), (2, day(2026, 3, 2)), (2, day(2026, 3, 1))], "id int, date date")
    got = {r.id: (r.anchor, r.source) for r in captures.anchored(stays, given, days).collect()}
    assert got == {1: (day(2026, 5, 2), "given"), 2: (day(2026, 3, 1), "days"), 3: (None, "missing"), None: (None, "missing")}
    kept = [r.day for r in captures.remembered(given).orderBy("id", "at").collect()]
    assert kept == [day(2026, 5, 1), day(2026, 5, 2), day(2026, 5, 2), None, None]


def test_clocks_and_ranges(spark):
    texts = {
        "3/4 at 0815 seen": [("3/4", "08:15")], "5/8 0454: labs": [("5/8", "04:54")], "May 3-5 at home": [("May 3", ""), ("May 5", "")], "3/4-3/9": [("3/4", ""), ("3/9", "")], "5/9 1200 mg": [("5/9", "")],
        "5/10 2015 then": [("5/10", "")], "on 2026-05-01, 9:05 pm": [("2026-05-01", "21:05")], "": [], None: [], "May 30 to 99 x": [("May 30", ""), ("May 99", "")],
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    found = docs.select("i", "text", F.explode(dates.timed("text", F.lit("2026-06-01").cast("date"))).alias("d")).orderBy("i", "d.start").collect()
    for i, (text, want) in enumerate(texts.items()):
        own = [r.d for r in found if r.i == i]
        assert [d.value for d in own] == [v for v, _ in want], text
        for d, (_, clock) in zip(own, want):
            assert (clock in (d.label or "")) and (text[d.start : d.end].endswith(d.clock)), (text, d)


def test_lines_in_the_row(spark):
    docs = spark.createDataFrame([(1, "a\n\nbc"), (2, None), (3, ""), (None, "x\n")], "doc_id int, text string")
    got = [tuple(r) for r in lines.split_lines(docs).collect()]
    assert got == [(1, 0, 0, 1, "a"), (1, 1, 2, 2, ""), (1, 2, 3, 5, "bc"), (2, 0, 0, 0, ""), (3, 0, 0, 0, ""), (None, 0, 0, 1, "x"), (None, 1, 2, 2, "")]
