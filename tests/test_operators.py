"""Small cases of the operators: empty tables, nulls, ties, edges."""

import pytest
from pyspark.sql import functions as F

from veilspan.functions.rules import DIRECT_RULES, FIELD_RULES, Rule
from veilspan.operators import evaluate, lines, model, names, records, spans, text, timeline
from veilspan.sources import documents, vault

DOCS = "doc_id long, text string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: [(x is None, 0 if x is None else x) for x in r])


def test_detect_offsets_count_code_points(spark):
    docs = spark.createDataFrame([(1, "😀 a@b.co, c@d.org"), (2, None), (3, "")], DOCS)
    found = spans.detect(docs, [DIRECT_RULES[0]]).select("doc_id", "start", "end", "value")
    assert rows(found) == [(1, 2, 8, "a@b.co"), (1, 10, 17, "c@d.org")]


def test_field_rule_spans_the_value_only(spark):
    docs = spark.createDataFrame([(1, "MRN: 12345\nPatient: Avery Archer")], DOCS)
    found = {(r.label, r.value) for r in spans.detect(docs, FIELD_RULES).collect()}
    assert ("MRN", "12345") in found and ("PATIENT NAME", "Avery Archer") in found


def test_merge(spark):
    kind = "doc_id long, start int, end int, label string, source string"
    s = spark.createDataFrame(
        [
            (1, 0, 5, "DATE", "structured"), (1, 3, 9, "DOB", "structured"), (1, 9, 12, "IP", "structured"),  # a union, and one beside it
            (2, 0, 9, "DATE", "structured"), (2, 2, 4, "DOB", "structured"), (2, 5, 5, "ID", "structured"),  # inside: the outer label stays
            (3, 0, 4, "NAME", "model"), (3, 2, 8, "ID", "structured"), (3, 5, 9, "NAME", "model"),  # the rule's span replaces, then holds
            (4, 0, 9, "NAME", "pattern"), (4, 1, 3, "MRN", "alias"),  # only the inner one is structured
            (5, 0, 2, "NAME", "model"), (5, 4, 6, "NAME", "model"), (None, 1, 2, "odd", "structured"),
        ],
        kind,
    )
    docs = spark.createDataFrame([(1, "x" * 20), (2, "x" * 20), (3, "x" * 20), (4, "x" * 20), (5, "Al - Bo"), (None, "xx")], DOCS)
    got = rows(spans.merge(s).select("doc_id", "start", "end", "label", "members"))
    assert got == [
        (1, 0, 9, "DOB", 2), (1, 9, 12, "IP", 1), (2, 0, 9, "DATE", 2), (3, 2, 8, "ID", 1), (4, 1, 3, "MRN", 2),
        (5, 0, 2, "NAME", 1), (5, 4, 6, "NAME", 1), (None, 1, 2, "odd", 1),
    ]
    with_texts = rows(spans.merge(s, docs.where("doc_id = 5")).select("doc_id", "start", "end", "members"))
    assert with_texts == [(5, 0, 6, 2)]


def test_redaction_needs_no_key(spark):
    docs = spark.createDataFrame([(None, "write to a.b@mail.org now"), (1, "some a@b.co text"), (1, "much longer here zz@other.net end"), (2, None), (3, "")], DOCS)
    safe = spans.redact(docs, [DIRECT_RULES[0]])
    assert sorted((r.text or "") for r in safe.collect()) == ["", "", "much longer here [EMAIL] end", "some [EMAIL] text", "write to [EMAIL] now"]
    many = spark.createDataFrame([(1, "a@b.co " * 1000)], DOCS)
    assert spans.redact(many, [DIRECT_RULES[0]]).first().text == "[EMAIL] " * 1000
    assert [r.start for r in spans.detect(many, [DIRECT_RULES[0]]).collect()] == list(range(0, 7000, 7))


def test_rules_find_all_of_the_corpus(spark):
    from veilspan.sources import corpus

    ids = spark.range(100)
    t = F.col("text")
    made = corpus.cases(ids).withColumn("found", spans.merged("text", FIELD_RULES + DIRECT_RULES)).withColumn("output", spans.splice("text", "found"))
    made = made.cache()
    truth = made.select("doc_id", F.inline("truth"))
    state = evaluate.grade(truth, made.select("doc_id", F.inline("found"))).groupBy(F.col("state").isin("exact", "mislabelled").alias("found")).count().collect()
    assert [r.found for r in state] == [True] and state[0]["count"] > 6000
    assert made.where(F.exists("truth", lambda x: F.contains("output", x.value))).count() == 0
    assert made.where(F.exists("protected", lambda x: ~F.contains("output", x.value))).count() == 0
    assert made.agg(F.min(F.length("text"))).first()[0] >= 10_000
    made.unpersist()


def test_overlaps_across_bins_once(spark):
    kind = "doc_id long, start int, end int"
    a, b = spark.createDataFrame([(1, 5, 35)], kind), spark.createDataFrame([(1, 9, 31), (1, 35, 40), (2, 5, 9)], kind)
    assert [(r.start_b, r.end_b) for r in spans.overlaps(a, b, width=10).collect()] == [(9, 31)]


def test_render(spark):
    docs = spark.createDataFrame([(1, "call 555 now"), (2, "none"), (3, None)], DOCS)
    s = spark.createDataFrame([(1, 5, 8, "PHONE")], "doc_id long, start int, end int, label string")
    assert rows(spans.render(docs, s)) == [(1, "call [PHONE] now"), (2, "none"), (3, None)]
    odd = spark.createDataFrame([(None, "call 555 now"), (1, "call 555 now"), (1, "no 555")], DOCS)
    null = spark.createDataFrame([(None, 5, 8, "PHONE")], "doc_id long, start int, end int, label string")
    assert rows(spans.render(odd.where("doc_id is null"), null)) == [(None, "call [PHONE] now")]
    with pytest.raises(Exception, match="several rows of one key"):
        spans.render(odd, s).collect()


def test_slugs_are_unique(spark):
    df = spark.createDataFrame([(1, "foo"), (2, "foo"), (3, "foo-2"), (4, "Foo"), (5, "foo-2"), (6, "bar-02")], "n int, name string")
    got = {r.n: r.token for r in text.unique_slugs(df, "name", "n").collect()}
    assert got == {1: "foo", 2: "foo-3", 4: "foo-4", 3: "foo-2", 5: "foo-2-2", 6: "bar-02"}


def test_near_names(spark):
    df = spark.createDataFrame([(1, "Archer", 0), (2, "Arcer", 0), (3, "Archerr", 0), (4, "Brchar", 0), (5, "Archer", 1), (6, None, 0), (7, "", 0), (8, "A", 0)], "id int, name string, g int")
    assert rows(names.near(df, "id", "name", "g")) == [(1, 2), (1, 3), (7, 8)]


def test_zones(spark):
    docs = spark.createDataFrame([(1, "Labs:\nWBC 7.2 (4-11)\nstable\nNa 140\n\nCT head:\nclear\nPlan: rest")], DOCS)
    z = [r.zone for r in lines.zones(lines.split_lines(docs)).orderBy("line_no").collect()]
    assert z == ["lab", "lab", "lab", "lab", "blank", "imaging", "imaging", "narrative"]


def test_duration_phrases(spark):
    cases = [("2026-01-31", "2026-03-01", "1 month and 1 day"), ("2025-01-01", "2026-02-03", "1 year, 1 month, and 2 days"), ("2026-01-01", "2026-01-01", "less than a day")]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    got = df.select(timeline.duration(F.to_date("a"), F.to_date("b"))).collect()
    assert [r[0] for r in got] == [c for _, _, c in cases]


def test_dates_and_clocks(spark):
    df = spark.createDataFrame([("2/30/2026", "25:00"), ("2/28/2026", "12:05 AM"), ("nonsense", "7:30 pm"), (None, None)], "d string, c string")
    got = df.select(timeline.parse_date(F.col("d")).cast("string"), timeline.parse_clock(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(None, None), ("2026-02-28", "00:05"), (None, "19:30"), (None, None)]


def test_nearest_year_drops_the_far_future(spark):
    df = spark.createDataFrame([(12, 20), (1, 10), (2, 30)], "m int, d int")
    got = df.select(timeline.nearest_year(F.col("m"), F.col("d"), F.lit("2026-01-05").cast("date")).cast("string")).collect()
    assert [r[0] for r in got] == ["2025-12-20", "2026-01-10", None]


def test_override_and_upsert(spark):
    k = "id int, name string"
    base, change = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], k), spark.createDataFrame([(2, "B"), (9, "N")], k)
    hidden = spark.createDataFrame([(3,)], "id int")
    assert rows(records.override(base, change, hidden, "id")) == [(1, "a"), (2, "B"), (9, "N")]
    assert rows(records.upsert(base, change, "id")) == [(1, "a"), (2, "B"), (3, "c"), (9, "N")]


def test_problems_are_all_listed(spark):
    df = spark.createDataFrame([("Bad Id", "x", ["a"]), ("ok-1", "history", ["a", "a"]), (None, None, None)], "i string, k string, c array<string>")
    got = [r[0] for r in df.select(records.problems(F.col("i"), F.col("k"), F.col("c"), ["history"])).collect()]
    assert got == ["bad id; bad kind; too few choices", "repeated choice", "bad id; bad kind; too few choices"]


def test_codec_and_chunks(spark):
    df = spark.createDataFrame([(1, "ÿ?>~é"), (2, "")], DOCS)
    assert [r[0] for r in df.select(text.url_decode(text.url_code(F.col("text")))).collect()] == ["ÿ?>~é", ""]
    long = spark.createDataFrame([(1, "x" * 1500)], DOCS)
    assert [(r.start, len(r.chunk)) for r in text.chunks(long, 700, 80).orderBy("chunk_no").collect()] == [(0, 700), (620, 700), (1240, 260)]


def test_grades(spark):
    truth = spark.createDataFrame([(1, 0, 4, "DOB", "a"), (1, 9, 12, "ID", "b"), (2, 0, 3, "ID", "c")], "doc_id long, start int, end int, category string, key string")
    found = spark.createDataFrame([(1, 0, 4, "DOB"), (1, 10, 12, "ID")], "doc_id long, start int, end int, label string")
    assert {r.key: r.state for r in evaluate.grade(truth, found).collect()} == {"a": "exact", "b": "partial", "c": "missed"}


def test_modes(spark):
    s = spark.createDataFrame([(1, 0, 4, "DOB")], "doc_id long, start int, end int, label string")
    assert model.combine(s, None, "structured").count() == 1
    with pytest.raises(ValueError):
        model.combine(s, None, "hybrid")
    assert model.combine(s, None, "hybrid", allow_fallback=True).count() == 1


def test_names(spark):
    docs = spark.createDataFrame([(1, "Patient: Avery Archer saw Some Body. Archer left.")], DOCS)
    word = lambda w: spark.createDataFrame([(w,)], "token string")
    found = names.recall(docs, word("avery"), word("archer"))
    assert [r.name for r in found.collect()] == ["Avery Archer"]
    assert {(r.alias, r.times) for r in names.repeats(docs, names.aliases(found)).collect()} == {("Avery Archer", 1), ("Archer", 2)}


def test_vault_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], DOCS)
    key = vault.derive_key("phrase", b"salt" * 4, 1000)
    vault.save(df, str(tmp_path / "v"), key)
    assert rows(vault.load(spark, str(tmp_path / "v"), key, df.schema)) == rows(df)


def test_workup_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "w1", "title": "T", "aliases": [], "items": [{"id": "i1", "kind": "history", "system": "s", "text": "t", "choices": ["no", "yes"]}]}')
    (tmp_path / "b.json").write_text("{broken")
    found = documents.read_workups(spark, str(tmp_path))
    assert [r.id for r in documents.checklist(found.where("id is not null")).collect()] == ["w1:i1"]
    assert found.where("_corrupt_record is not null").count() == 1


def test_rules_are_unique():
    every = FIELD_RULES + DIRECT_RULES
    assert len({r.name for r in every}) == len(every) == 70
    assert all(isinstance(r, Rule) for r in every)
