"""The ten operators and the pipeline against plain forms, on small inputs with odd rows."""

import hashlib
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from veilspan.llm import (
    common, decontaminate, language_model, pii, quality, registry, rolling, sentencepiece_codec, simhash, substrings, suffix_index, topk, warc,
)

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, k long, h string, pos int, row double"


def words(seed, n, vocabulary=4000):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, vocabulary, n)]


PASSAGE = " ".join(words(1, 60))
LONG = " ".join(words(2, 30_000))
TEXTS = [
    (0, "Write to a.b@mail.example.org or c@d.org; server 10.0.0.255 not 10.0.0.256, card 4111 1111 1111 1111, call +1 (202) 555-0143."),
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (6, "One"),
    (7, PASSAGE), (8, "before " + PASSAGE + " after"), (9, PASSAGE + " " + PASSAGE), (10, LONG), (11, LONG + " end"), (12, LONG),
    (13, "é😀ü " + PASSAGE.upper() + " 😀"), (14, "x" * 20_000), (15, "ab" * 5000), (16, "1" * 20_000 + "@"), (17, "a" * 99), (18, "a" * 101),
    (None, "no id " + PASSAGE), (None, None), (20, "twice"), (20, "twice"), (21, PASSAGE + " " + PASSAGE[:150]), (22, "1 2 3 4 5 6"),
    (23, "Dear Mr. John Smith, your password: abcDEF1234567890xyzQ and ssn 123-45-6789, iban DE89370400440532013000."),
]


def xxhash64(text):
    """Spark's hash of a text."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >> 63 else h


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(d, t, None, None, None, 1, "h", None, 0.5) for d, t in texts], KIND)


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "documents.parquet")
    frame(spark).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def order(rows):
    return sorted(rows, key=str)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- 1: personal data -------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["docs", "real"])
def test_pii_base_spans(which, request):
    given = request.getfixturevalue(which)
    expected = []
    for d, t in pairs(given):
        found = brute.base_spans(t)
        expected.append((d, *(sum(s.startswith(k + ":") for s in found) for k in brute.BASE), hashlib.sha256(",".join(found).encode()).hexdigest()))
    got = pii.report(given)
    assert order(tuple(r)[:6] for r in got.collect()) == order(expected)
    for r in got.collect():
        assert hashlib.sha256(",".join(s for s in r.spans.split(",") if s.split(":")[0] in brute.BASE).encode()).hexdigest() == r.base_sha256


def test_pii_finds_more_than_patterns_and_redacts(docs):
    text = dict(TEXTS)[23]
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}[23]
    kinds = {text[int(a) : int(b)]: k for k, a, b in (s.split(":") for s in spans.split(","))}
    assert kinds["123-45-6789"] == "person_id" and kinds["abcDEF1234567890xyzQ"] == "secret" and kinds["Mr. John Smith"] == "name"
    redacted = pii.redact(docs)
    assert redacted.columns == docs.columns and redacted.count() == docs.count()
    said = {r.doc_id: r.text for r in redacted.collect()}
    assert said[0].startswith("Write to <email> or <email>; server <ip> not 10.0.0.256, card <card>, call <phone>")
    assert said[7] == PASSAGE and said[1] is None and said[2] == ""


def test_pii_recall_of_what_the_method_adds(spark):
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"))
    digit = lambda n: "".join(map(str, rng.integers(1, 10, n)))
    secret = lambda: "sk-" + "".join(rng.choice(letters, 14)) + digit(6)
    made = {
        "secret": [f"the key: {secret()} was used" for _ in range(60)],
        "person_id": [f"her ssn {rng.integers(100, 665)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)} is on file" for _ in range(30)]
        + [f"pay to iban DE{digit(20)} soon" for _ in range(30)],
        "name": [f"signed by Dr. {common.GIVEN_NAMES[i % 50]} {'ABCDEFGH'[i % 8]}olster today" for i in range(60)],
    }
    clean = [f"the part number {digit(3)}-{digit(2)} is in stock and costs {digit(4)} euros" for _ in range(60)]
    rows, want = [], []
    for kind, texts in made.items():
        for t in texts:
            want.append((len(rows), kind))
            rows.append((len(rows), t))
    first = len(rows)
    rows += [(first + i, t) for i, t in enumerate(clean)]
    got = {(r.doc_id, s.split(":")[0]) for r in pii.report(frame(spark, rows)).collect() for s in r.spans.split(",") if s}
    for kind in made:
        mine = [w for w in want if w[1] == kind]
        assert sum(w in got for w in mine) >= 0.9 * len(mine), kind
    assert not {d for d, _ in got if d >= first}


def test_reliabilities_follow_agreement():
    rows = [{"kind": "secret", "v0": a, "v1": a, "v2": a, "n": 50} for a in (1, -1)] + [{"kind": "secret", "v0": 1, "v1": -1, "v2": -1, "n": 5}]
    post = pii.reliabilities(rows)
    assert post["secret", 1, 1, 1] > 0.9 > 0.5 > post["secret", -1, -1, -1]


# ---- 2: language model ------------------------------------------------------------------------


def test_language_model_counts(docs):
    given = pairs(docs)
    train = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 5 != 1
    expected, n = brute.base_scores(given, train)
    got = order((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.held_out, round(r.base_score, 3)) for r in language_model.score(docs).collect())
    assert got == order((str(d), a, b, n, not train(d), round(float(s), 3)) for (d, _), (a, b, s) in zip(given, expected))


def lexicon(n=5000):
    keys = np.sort(np.random.default_rng(3).integers(2, 2**64, n, dtype=np.uint64))
    counts = np.random.default_rng(4).integers(1, 100, n)
    ids = np.full(n, language_model.REST)
    ids[np.argsort(-counts)[: language_model.VOCAB]] = np.arange(language_model.VOCAB)
    return language_model.Lexicon(keys, counts, ids, int(counts.sum()), n)


def test_lexicon_lookup():
    lex = lexicon()
    asked = np.concatenate([lex.keys, lex.keys + np.uint64(1), [np.uint64(0), np.uint64(2**64 - 1)]])
    there = {int(k): i for i, k in enumerate(lex.keys)}
    assert lex.find(asked).tolist() == [there.get(int(k), -1) for k in asked]


def test_probabilities_sum_to_one_and_state_is_carried():
    lex = lexicon()
    w = language_model.initial(lex)
    every = np.arange(language_model.VOCAB + 1)
    prefix = np.array([5, 70, 2000, language_model.REST], np.int32)
    ids = np.concatenate([np.concatenate([prefix, [x]]) for x in every]).astype(np.int32)
    starts = np.arange(len(every)) * 5
    lp = language_model.log_probabilities(w, ids, starts, np.full(len(every), 5), 0)
    assert abs(np.exp(lp[4::5]).sum() - 1) < 1e-3
    one = np.tile(prefix, 50)
    whole = language_model.log_probabilities(w, one, np.array([0]), np.array([200]), 0)
    cut = language_model.log_probabilities(w, one, np.array([0, 100]), np.array([100, 100]), 0)
    assert np.allclose(whole[:100], cut[:100], atol=1e-4) and not np.allclose(whole[100:], cut[100:], atol=1e-4)


def test_gradients_match_differences():
    w = {k: v.astype(np.float64) for k, v in language_model.initial(lexicon()).items()}
    rng = np.random.default_rng(1)
    prev, target = ([rng.integers(0, language_model.VOCAB + 1, 6) for _ in range(5)] for _ in range(2))
    reset = [np.array([t == 0 or (t == 2 and i == 1) for i in range(6)]) for t in range(5)]
    h0 = np.zeros((6, language_model.HIDDEN))

    def loss(w):
        h, total = h0, 0.0
        for p, t, r in zip(prev, target, reset):
            h = language_model._forward(w, w["embed"][p] @ w["wx"] + w["b"], r, h, None)
            total -= language_model._outputs(w, h, t, None)[0].sum()
        return total / 30

    grads, _ = language_model._gradients(w, prev, target, reset, h0)
    for k in w:
        way = rng.normal(size=w[k].shape)
        step = 1e-3
        up, down = ({**w, k: w[k] + s * step * way} for s in (1, -1))
        assert abs((loss(up) - loss(down)) / (2 * step) - (grads[k] * way).sum()) < 2e-3 * max(1, abs((grads[k] * way).sum())), k


def test_training_carries_state_through_a_long_document(monkeypatch):
    seen, gradients = [], language_model._gradients

    def told(w, before, ids, first, h):
        seen.extend(zip(before, ids, first, strict=True))
        return gradients(w, before, ids, first, h)

    monkeypatch.setattr(language_model, "_gradients", told)
    lex = lexicon()
    ids = np.random.default_rng(8).integers(0, language_model.VOCAB, 5000).astype(np.int32)
    language_model.Trainer(language_model.initial(lex)).learn(ids, np.array([0]), np.array([5000]), 0)
    before, target, first = (np.concatenate(x) for x in zip(*seen))
    assert target.tolist() == ids.tolist() and before.tolist() == [0, *ids[:-1]] and first.tolist() == [True] + [False] * 4999


def test_language_model_lanes_hold_a_long_text_beside_short_ones():
    sizes = np.array([300_000] + [3] * 600)
    starts = np.cumsum(sizes) - sizes
    ids = np.arange(sizes.sum(), dtype=np.int32) % 50
    s = language_model.Streams(ids, starts, sizes, 512, 0)
    assert s.place.nbytes <= 4 * len(ids) and s.running(0) == 512 and s.running(299_999) == 1 and s.running(300_000) == 0
    seen = np.concatenate([w[w >= 0] for w, _ in (s.window(at) for at in range(0, s.steps, language_model.STEPS))])
    assert (np.sort(seen) == np.arange(len(ids))).all()
    lanes, running = s.window(16)
    assert lanes.shape == (language_model.STEPS, running[0]) and all((row[:n] >= 0).all() and (row[n:] < 0).all() for row, n in zip(lanes, running))


def test_language_model_scores_equal_a_plain_loop():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 40, 7, 23])
    ids = rng.integers(0, language_model.VOCAB + 1, sizes.sum()).astype(np.int32)
    lex = language_model.Lexicon(np.arange(5, dtype=np.uint64), np.array([9, 8, 7, 6, 5]), np.arange(5), 35, 5)
    w = language_model.initial(lex)
    starts = np.cumsum(sizes) - sizes
    got = language_model.log_probabilities(w, ids, starts, sizes, 0, lane_count=2)
    sig = lambda x: 1 / (1 + np.exp(-x))
    for a, n in zip(starts, sizes):
        h, before = np.zeros(language_model.HIDDEN), 0
        for t in range(a, a + n):
            g, u = w["embed"][before] @ w["wx"] + w["b"], h @ w["wh"]
            k = language_model.HIDDEN
            z, r = sig(g[:k] + u[:k]), sig(g[k : 2 * k] + u[k : 2 * k])
            new = np.tanh(g[2 * k :] + r * u[2 * k :])
            h = new + z * (h - new)
            soft = lambda x: x - np.log(np.exp(x).sum())
            c = language_model.CLASSES if ids[t] == language_model.REST else ids[t] // language_model.SIZE
            lp = soft(h @ w["wc"] + w["bc"])[c]
            if c < language_model.CLASSES:
                lp += soft(h @ w["wo"][c] + w["bo"][c])[ids[t] % language_model.SIZE]
            assert abs(lp - got[t]) < 1e-4
            before = ids[t]


def test_language_model_beats_frequencies_on_held_out(spark):
    got = language_model.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    r = got.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


# ---- 3: decontamination -----------------------------------------------------------------------

ITEMS = [
    (1, "Alice has 12 apples and buys 5 more apples at the market. Later Alice gives 12 kg of pears away. How many apples are left?"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank at dawn"), (3, None), (4, ""), (5, "short item"), (6, "12 34 56"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank at dawn"),
]
LEAKY = [
    (1, "Some words first. Bob has 40 apples and buys 7 more apples at the market. Later Bob gives 40 kg of pears away. How many apples are left? And more."),
    (2, "Some words first. Bob has 40 apples and buys 7 more apples at the market. Later Tom gives 99 kg of pears away. How many apples are left? And more."),
    (3, "see THE QUICK brown fox  jumps over the lazy dog near the old river bank at dawn."), (4, "The quick brown fox sat down"), (5, None), (6, ""),
    (7, "short item"), (8, "a short item here"), (None, "The quick brown fox jumps over the lazy dog near the old river bank at dawn"), (9, LONG), (9, LONG), (10, "1 2 3"),
]


def test_decontaminate(spark):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    found = decontaminate.leaks(frame(spark, LEAKY), items)
    expected = brute.leaks(LEAKY, ITEMS)
    assert {(r.doc_id, r.item_id): (r.n_windows, r.n_matched) for r in found.collect()} == expected
    assert (1, 1) in expected and (2, 1) not in expected and (3, 2) in expected and (None, 2) in expected and (7, 5) in expected
    kept = decontaminate.decontaminate(frame(spark, LEAKY), items)
    assert order(r.doc_id for r in kept.collect()) == order(d for d, _ in LEAKY if d not in {x for x, _ in expected})
    shuffled = decontaminate.leaks(frame(spark, LEAKY), items, broadcast_rows=0)
    assert order(map(tuple, shuffled.collect())) == order(map(tuple, found.collect()))


def test_decontaminate_real(spark, real):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_matched) for r in registry.QUERIES["op3_decontaminate"](spark, SF).collect()}
    assert got == brute.leaks(pairs(real), [(r.item_id, r.text) for r in items.collect()]) and got


def test_decontaminate_finds_reparameterised_items(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = lambda t: common.GIVEN_NAMES[0] + " paid 12 dollars. " + t + " It cost 7 euros and " + common.GIVEN_NAMES[1] + " left."
    bench = spark.createDataFrame([(i, plain(t)) for i, t in items], "item_id long, text string")
    changed = []
    for i, t in items:
        other = plain(t).replace(" 12 ", f" {30 + i} ").replace(" 7 ", f" {90 + i} ")
        for a, b in ((common.GIVEN_NAMES[0], common.GIVEN_NAMES[5 + i % 9]), (common.GIVEN_NAMES[1], common.GIVEN_NAMES[20 + i % 9])):
            other = other.replace(a, b)
        changed.append((i, "some words come first here. " + other + " and more words follow"))
    clean = [(1000 + i, " ".join(words(900 + i, 60))) for i in range(20)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, changed + clean), bench).collect()}
    assert sum((i, i) in got for i, _ in items) >= 0.9 * len(items)
    assert not {d for d, _ in got} & {i for i, _ in clean}


def test_decontaminate_short_item_after_lower_case(spark):
    bench = spark.createDataFrame([(1, "What is the capital of France?")], "item_id long, text string")
    got = decontaminate.leaks(frame(spark, [(5, "now answer this, What is the capital of France?"), (6, "What is the price of bread then")]), bench)
    assert [(r.doc_id, r.n_matched) for r in got.collect()] == [(5, 2)]


# ---- 4: top-k ---------------------------------------------------------------------------------


def test_topk(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(500 + i, rows[i % 3][1]) for i in range(40)] + [(100, rows[0][1]), (None, rows[1][1]), (600, None), (700, [None] * 8), (800, [float("nan")] * 8)]
    rows += [(900, [1.0, 2.0]), (901, [3.0, -2.0]), (902, []), (1000, [])]
    given = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, ids string")
    ok = [(i, np.floor(1024 * np.array(v, np.float64)).astype(int)) for i, v in rows if i is not None and v is not None and not any(x is None or not np.isfinite(x) for x in v)]
    expected = []
    for n, (q, a) in enumerate(ok):
        if q % 100 == 0:
            best = sorted((-int(a @ b), i) for m, (i, b) in enumerate(ok) if m != n and len(a) == len(b))[:10]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for block in (4096, 2):
        assert order(map(tuple, topk.search(given, block=block).collect())) == order(expected)
    assert topk.search(given.limit(0)).count() == 0


def test_topk_searches_repeated_queries_once(spark, monkeypatch):
    asked, search_block = [], topk.search_block
    monkeypatch.setattr(topk, "search_block", lambda classes, queries, k: asked.append(len(queries)) or search_block(classes, queries, k))
    rows = [(100, [1.0, 2.0])] * 60 + [(200, [float(i), 1.0]) for i in range(8)] + [(i, [float(i), -1.0]) for i in range(1, 12)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2, block=4).collect()
    assert sum(asked) == 9 and max(asked) < 9
    expected = []
    for n, (q, a) in enumerate(rows):
        if q % 100 == 0:
            best = sorted((-sum(int(1024 * x) * int(1024 * y) for x, y in zip(a, b)), i) for m, (i, b) in enumerate(rows) if m != n)[:2]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert order(map(tuple, got)) == order(expected)


# ---- 5: near duplicates -----------------------------------------------------------------------


def component_ids(given):
    """Of rows (id, text) the expected fingerprint and component id."""
    prints = [brute.fingerprint(t) for _, t in given]
    distinct = sorted(set(prints))
    group = dict(zip(distinct, brute.linked(distinct)))
    least = {}
    for (d, _), p in zip(given, prints):
        if d is not None:
            least[group[p]] = min(d, least.get(group[p], d))
    return prints, [least.get(group[p]) for p in prints]


@pytest.mark.parametrize("which", ["docs", "real"])
def test_simhash(which, request):
    given = request.getfixturevalue(which)
    rows = pairs(given)
    prints, ids = component_ids(rows)
    got = order(map(tuple, simhash.near_duplicates(given).collect()))
    assert got == order((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, ids))
    kept = simhash.keep_one(given)
    assert kept.columns == given.columns and kept.count() == len({(p, c) if c is None else c for p, c in zip(prints, ids)})


def test_crowded_buckets_link_the_same(spark):
    rng = np.random.default_rng(5)
    seeds = [int(x) for x in rng.integers(0, 2**63, 4)]
    prints = sorted({s ^ (1 << int(a)) ^ (1 << int(b)) for s in seeds for a, b in rng.integers(0, 64, (60, 2))} | set(seeds) | {0, 2**64 - 1})
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    given = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, fp long")
    expected = brute.linked(prints)
    for bucket in (64, 1):
        got = {r.fp: r.component_id for r in simhash.classes(given, bucket=bucket).collect()}
        assert [got[p] for p in signed] == expected


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in common.components(edges).collect()} == {**dict.fromkeys(range(101), 0), 200: 200, 201: 200}


# ---- 6: quality -------------------------------------------------------------------------------


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES["op6_quality"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.8 and 0 <= r[1] <= r[2] <= 1
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.fit(x, y)
    for row, p in zip(x[:50], forest.predict(x[:50])):
        total = forest.base
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        assert abs(1 / (1 + np.exp(-total)) - p) < 1e-9
    assert ((forest.predict(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_quality_odd_rows(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (7, 0, None), (None, 1, 1), (8, None, 0), (0, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.train(docs, labels))
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    nothing = quality.score(docs, quality.train(docs, labels.limit(0)))
    assert {r.score for r in nothing.collect()} == {0.5} and quality.keep_good(docs, quality.train(docs, labels.limit(0))).columns == docs.columns


# ---- 7 and 10: repeats ------------------------------------------------------------------------


def test_substrings(docs):
    rows = pairs(docs)
    expected = [(d, n, n - len(kept), " ".join(kept).encode()) for (d, _), (n, kept) in zip(rows, brute.word_repeats([t for _, t in rows]))]
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substrings.remove_repeats(docs).collect()]
    assert order(got) == order(expected)


def test_substrings_real(real):
    rows = pairs(real)
    expected = [(d, n, n - len(kept), " ".join(kept).encode()) for (d, _), (n, kept) in zip(rows, brute.word_repeats([t for _, t in rows]))]
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substrings.remove_repeats(real.repartition(7)).collect()]
    assert sorted(got) == sorted(expected)


def test_words_of_two_letters_do_not_collide(spark):
    word = "a"
    while len(word) < 2048:  # each half is the other with the letters exchanged, which beats hashes modulo 2**64
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [" ".join([*(f"w{i}" for i in range(17)), x, *(f"v{i}" for i in range(17))]) for x in (word, other)]
    got = substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.n_removed for r in got.collect()} == {0}
    got = suffix_index.remove_repeats(spark.createDataFrame([(0, word[:1024]), (1, other[:1024] + "c")], "doc_id long, text string"))
    want = brute.byte_repeats([word[:1024], other[:1024] + "c"])
    assert {(r.doc_id, r.kept) for r in got.collect()} == {(i, k) for i, (k, _) in enumerate(want)}


def test_products_modulo_the_prime():
    p = rolling._P
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, p, 1000, dtype=np.uint64) for _ in range(2))
    a[:3], b[:3] = [p - 1, p - 1, 0], [p - 1, 1, 5]
    assert [int(x) * int(y) % p for x, y in zip(a, b)] == rolling.multiply(a, b).tolist()
    raw, sums = rng.integers(0, 256, 20000).astype(np.uint8), [0]
    for i, c in enumerate(raw):
        sums.append((sums[-1] + int(rolling._SYMBOL[c]) * pow(rolling._BASE, i, p)) % p)
    assert rolling.byte_prefix(raw).sums.tolist() == sums


@pytest.mark.parametrize("batches", [1, 2, 5, None])
def test_suffix_index(spark, real, batches):
    odd = {d: t for d, t in TEXTS if d is not None}
    rows = [(1000 + d, t) for d, t in odd.items()] + [(d, t[:3000] if t else t) for d, t in pairs(real)]
    rows.sort()
    expected = [(d, len((t or "").encode()), len((t or "").encode()) - len(kept), n, kept) for (d, t), (kept, n) in zip(rows, brute.byte_repeats([t for _, t in rows]))]
    got = suffix_index.remove_repeats(frame(spark, rows).repartition(5), batches=batches).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == expected


def test_suffix_index_crowded_seeds(spark, monkeypatch):
    monkeypatch.setattr(suffix_index, "CROWD", 2)
    core = "the same words stand here in every one of them, and go on for rather longer than a hundred bytes, all told, so."
    rows = [(i, "".join(words(i, 30)) + core[i % 5 : 108 + i % 3] + "".join(words(50 + i, 30))) for i in range(20)]
    expected = [(d, kept) for (d, _), (kept, _) in zip(rows, brute.byte_repeats([t for _, t in rows]))]
    got = suffix_index.remove_repeats(frame(spark, rows)).collect()
    assert sorted((r.doc_id, bytes(r.kept)) for r in got) == expected


@pytest.mark.parametrize("crowd", [1000, 1])
@pytest.mark.parametrize("parts", [1, 8])
def test_suffix_index_repeated_rows_are_one_document(spark, monkeypatch, parts, crowd):
    monkeypatch.setattr(suffix_index, "CROWD", crowd)
    own, shared = " ".join(words(70, 40)), " ".join(words(71, 60))
    texts = [(1, own), (2, "a " + shared + " b"), (3, "c" + shared[5:] + "d"), (3, "e" + shared[9:]), (4, shared * 2), (None, own[:130])]
    done = brute.byte_repeats([t for _, t in sorted(texts, key=lambda r: (r[0] or 0, xxhash64(r[1])))])
    expected = dict(zip(sorted(texts, key=lambda r: (r[0] or 0, xxhash64(r[1]))), done))
    rows = [r for r in texts for _ in range(2)] + texts[:2]
    given = frame(spark, rows).coalesce(1) if parts == 1 else spark.createDataFrame(spark.sparkContext.parallelize(frame(spark, rows).collect(), len(rows)), KIND)
    got = suffix_index.remove_repeats(given).collect()
    assert order((r.doc_id, r.n_bytes, bytes(r.kept), r.n_spans) for r in got) == order((d, len(t), *expected[d, t]) for d, t in rows)


def test_suffix_index_tells_by_all_bits(spark):
    core = b"tcctdaukloompzuwilfkqcfrsefppdugnxrejcokirpnltnrmcvhqqubpruuumspjxjs"
    alike = [core + b"82a13916af44e178cfdbc0c90b62af53", core + b"9ae084d82a9b97cd727f1f54014e5dc9"]
    e = suffix_index.Block(alike, 100, 28)
    assert e.key[0] == e.key[1] and e.context[0] >> np.uint64(32) == e.context[1] >> np.uint64(32) and e.context[0] != e.context[1]
    # two texts whose hashes agree in 31 bits, and only the first repeats itself
    twins = ["no id, document number 91638, and other words." * 8, "1332 " + PASSAGE]
    assert (xxhash64(twins[0]) ^ xxhash64(twins[1])) & 0x7FFFFFFF == 0
    rows = [(1, alike[0].decode()), (2, alike[1].decode()), (None, twins[0]), (None, twins[1])]
    done = {t: brute.byte_repeats([t])[0] for _, t in rows}
    assert order((r.doc_id, bytes(r.kept)) for r in suffix_index.remove_repeats(frame(spark, rows)).collect()) == order((d, done[t][0]) for d, t in rows)


# ---- 8: pieces --------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["docs", "real"])
def test_sentencepiece(which, request):
    import sentencepiece

    given = request.getfixturevalue(which)
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    expected = []
    for d, t in pairs(given):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        digest = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), sp.decode(ids).encode())]
        expected.append((d, len(ids), *digest, len((t or "").encode())))
    assert order(map(tuple, sentencepiece_codec.digest(given).collect())) == order(expected)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def character_map(pairs):
    """A compiled map of source to normal forms: a double array over the bytes, then the strings."""
    trie, strings = {}, b""
    for source, normal in pairs.items():
        node = trie
        for byte in source.encode():
            node = node.setdefault(byte, {})
        node[0], strings = len(strings), strings + normal.encode() + b"\0"
    units, todo = {0: 0}, [(0, trie)]
    while todo:
        at, node = todo.pop()
        base = next(b for b in range(1, 1 << 20) if all(b ^ label not in units for label in node))
        units[at] |= (base ^ at) << 10 | (0 in node) << 8
        for label, below in node.items():
            units[base ^ label] = (1 << 31 | below) if label == 0 else label
            if label:
                todo.append((base ^ label, below))
    size = (max(units) | 255) + 1
    return (4 * size).to_bytes(4, "little") + np.array([units.get(i, 0) for i in range(size)], "<u4").tobytes() + strings


@pytest.mark.parametrize("trim", [True, False])
@pytest.mark.parametrize("dummy", [True, False])
def test_character_map_normalises_as_the_library(spark, tmp_path, trim, dummy):
    blob = character_map({"\ufb01": "fi", "\uff21": "A", "\u3000": " ", "e\u0301": "\u00e9", "\u2026": "...", "\u200b": "", "abc": "x  y"})
    raw, at, kept = Path(sentencepiece_codec.default_model()).read_bytes(), 0, b""
    while at < len(raw):
        key, i = sentencepiece_codec._varint(raw, at)
        size, i = sentencepiece_codec._varint(raw, i)
        if key >> 3 != 3:
            kept += raw[at : i + size]
        at = i + size
    spec = b"\x12" + varint(len(blob)) + blob + bytes([0x18, dummy, 0x20, trim, 0x28, 1])
    path = tmp_path / "own.model"
    path.write_bytes(kept + b"\x1a" + varint(len(spec)) + spec)
    codec = sentencepiece_codec.Codec(str(path))
    texts = ["\ufb01ne \uff21\u3000 b", "  cafe\u0301 \u2026 ", "", " ", "\u200b", "abc abcabc \u200bd", "\u3000\u3000x", "plain words", "\U0001f600 z\u200b "]
    for t in texts:
        normal, starts = codec.normalize(t.encode())
        assert normal.decode().replace("\u2581", " ") == codec.sp.normalize(t).replace("\u2581", " "), t
        assert len(starts) == len(normal) + 1 and (np.diff(starts) >= 0).all()
        ids = codec.sp.encode(t, add_bos=True, add_eos=True)
        spans = codec.spans(t.encode(), ids)
        assert spans[0, 0] == spans[0, 1] and (spans[1:, 0] == spans[:-1, 1]).all()
    source = "x \ufb01 y".encode()
    ids = codec.sp.encode("x \ufb01 y")
    covered = {source[a:b] for a, b in codec.spans(source, ids).tolist()}
    assert any("\ufb01".encode() in c for c in covered)
    got = sentencepiece_codec.digest(frame(spark, list(enumerate(texts))), str(path)).collect()
    assert {r.n_tokens for r in got if r.doc_id == 2} == {2}
    with pytest.raises(ValueError):
        codec.spans(b"one two", codec.sp.encode("one two three"))


def test_pieces_stand_where_their_spans_say(spark):
    text = "Grüße, 東京 and 😀  two spaces\nline"
    r = sentencepiece_codec.encode(frame(spark, [(1, text)])).first()
    sp = sentencepiece_codec.codec(sentencepiece_codec.default_model()).sp
    raw = text.encode()
    assert r.starts[0] == r.ends[0] == 0 and r.ends[-1] == len(raw) and r.starts[1:] == r.ends[:-1]
    for i, a, b in zip(r.ids, r.starts, r.ends):
        if not sp.is_control(i) and not sp.is_byte(i):
            assert raw[a:b].decode().replace(" ", "▁") in (sp.id_to_piece(i), sp.id_to_piece(i)[1:])


# ---- 9: fixity --------------------------------------------------------------------------------


def test_audit(spark):
    kind = "page_id long, url string, html string, file string"
    pages = [(i, f"u{i}", f"<p>{i}</p>", "x") for i in range(0, 9000, 7)] + [(None, None, None, None), (7, "u7", "<p>7</p>", "x"), (7, "v", None, "x")]
    other = [r for r in pages if r[0] not in (14, 21)] + [(21, "u21", "<p>2I</p>", "x"), (3, "new", "", "x")]
    got = warc.audit(spark.createDataFrame(pages, kind), spark.createDataFrame(other, kind))
    states = {}
    for r in got.collect():
        states.setdefault(r.state, []).append(r.page_id)
    assert states["missing"] == [14] and set(states["altered"]) == {21} and states["extra"] == [3]
    assert got.where("state <> 'extra'").count() == len(set(pages))
    assert warc.audit(spark.createDataFrame([], kind), spark.createDataFrame([], kind)).count() == 0


def test_audit_of_one_hot_id_and_rows_without(spark):
    rows = [(7, f"u{i}", f"page {i}") for i in range(300)] + [(None, f"n{i}", f"odd {i}") for i in range(300)] + [(-1, "m", "minus"), (8, "x", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    copy = spark.createDataFrame([r for r in rows if r[1] not in ("u5", "n9")] + [(None, "new", "more")], "page_id long, url string, html string")
    got = warc.audit(pages, copy).collect()
    state = {(r.page_id, r.sha256): r.state for r in got}
    assert len(got) == len(rows) + 1
    assert sorted(r.state for r in got if r.page_id == 7) == ["intact"] * 299 + ["missing"]
    assert sorted(r.state for r in got if r.page_id is None) == ["extra"] + ["intact"] * 299 + ["missing"]
    assert {v for (p, _), v in state.items() if p in (-1, 8)} == {"intact"}
    own = sorted((r.start, r.end) for r in got if r.page_id in (7, 8))
    assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    assert warc.audit(pages.where("page_id is null"), copy.where("page_id is null")).count() == 301


def test_audit_sql(spark):
    import duckdb

    pages = f"{SF}/pages.parquet"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{pages}'")
    theirs = c.execute(warc.OP9_SQL).df()
    mine = warc.op9_warc_audit(spark, SF).toPandas()
    key = ["file", "start", "sha256"]
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert mine[columns].sort_values(key).astype(str).values.tolist() == theirs[columns].sort_values(key).astype(str).values.tolist()


# ---- all --------------------------------------------------------------------------------------


def test_empty_tables(spark):
    none = frame(spark, [])
    assert pii.report(none).count() == language_model.score(none).count() == simhash.near_duplicates(none).count() == 0
    assert substrings.remove_repeats(none).count() == suffix_index.remove_repeats(none).count() == sentencepiece_codec.digest(none).count() == 0
    assert simhash.keep_one(none).count() == pii.redact(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.decontaminate(frame(spark), items).count() == len(TEXTS)


def test_stages_keep_clashing_columns_and_odd_rows(spark, tmp_path):
    texts = [(1, "write to a.b@mail.example.org"), (1, "write to a.b@mail.example.org"), (2, None), (None, "call +1 (202) 555-0143 now"), (3, ""), (4, LONG)]
    names = "_k _th k th _pk _pth _cuts cuts _bk _bh h".split()
    kind = "doc_id long, text string, " + ", ".join(f"{c} int" for c in names)
    given = spark.createDataFrame([(d, t, *range(len(names))) for d, t in texts], kind)
    bench = spark.createDataFrame([(1, LONG[:400])], "item_id long, text string")
    safe = {t: t for _, t in texts} | {texts[0][1]: "write to <email>", texts[3][1]: "call <phone> now"}
    for found, want in (
        (simhash.keep_one(given), [texts[0], texts[2], texts[3], texts[5]]),
        (pii.redact(given), [(d, safe[t]) for d, t in texts]),
        (decontaminate.decontaminate(given, bench), texts[:5]),
    ):
        assert found.columns == given.columns
        rows = found.collect()
        assert {tuple(r)[2:] for r in rows} == {tuple(range(len(names)))}
        assert order((r.doc_id, r.text) for r in rows if r.doc_id not in (2, 3)) == order(r for r in want if r[0] not in (2, 3))
    none = given.where("false")
    for found in (simhash.keep_one(none), pii.redact(none), decontaminate.decontaminate(none, bench)):
        assert found.columns == given.columns and found.count() == 0


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    for name, rows in (("odd", TEXTS), ("none", [])):
        frame(spark, rows).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(0, 1, 0), (7, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        spark.createDataFrame([(1, None), (2, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        sys.path.insert(0, str(Path(__file__).parents[2]))
        import corpus_pipeline

        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert len(got) <= len(rows)


def test_pipeline_without_labels_keeps_documents(docs, spark):
    for rows in ([], [(0, 1, 0), (7, 1, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        kept = quality.keep_good(docs, quality.train(docs, labels))
        assert kept.columns == docs.columns and kept.count() == docs.count()


def test_pipeline(spark, real):
    import corpus_pipeline

    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    forest = quality.train(real, labels)
    rows = [(d, t) for d, t in pairs(real) if forest.predict(np.array([quality.statistics(t)]))[0] >= quality.CUTOFF]
    prints, ids = component_ids(rows)
    first = {}
    for (d, t), c in sorted(zip(rows, ids), key=lambda x: x[0][0]):
        first.setdefault(c, (d, t))
    rows = list(first.values())
    leaked = {d for d, _ in brute.leaks(rows, [(r.item_id, r.text) for r in items.collect()])}
    rows = [(d, t) for d, t in rows if d not in leaked]
    spans = {r.doc_id: r.spans for r in pii.report(frame(spark, rows)).collect()}
    codec = sentencepiece_codec.codec(sentencepiece_codec.default_model())
    expected = []
    for d, t in rows:
        groups = []
        for kind, a, b in sorted((s.split(":") for s in spans[d].split(",") if s), key=lambda s: int(s[1])):
            if groups and int(a) < groups[-1][2]:
                groups[-1][2] = max(groups[-1][2], int(b))
            else:
                groups.append([kind, int(a), int(b)])
        for kind, a, b in reversed(groups):
            t = f"{t[:a]}<{kind}>{t[b:]}"
        ids = codec.sp.encode(t or "", add_bos=True, add_eos=True)
        expected.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    assert order(tuple(r)[:3] for r in corpus_pipeline.run(spark, SF).collect()) == order(expected)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "sentencepiece"]


def test_all_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(registry.QUERIES) | {"pipeline"} <= names and {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 14)}
