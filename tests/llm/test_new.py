"""Phrases, the conversation trie and toxicity against plain forms, on small inputs with odd rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import phrases, registry, toxicity, trie

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", ["op11_phrases", "op12_trie"])
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine = registry.QUERIES[name](spark, SF)
    theirs = c.execute(registry.ORACLE[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(mine.columns) == sorted(columns)
    assert order(tuple(r) for r in mine.select(*columns).collect()) == order(theirs.fetchall())


# ---- 11: phrases ------------------------------------------------------------------------------


def plain_phrases(rows, least, longest, top):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cand.items():
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items())
            if not inside:
                rows_.append((-score, -a, " ".join(p).encode(), a, left, right))
        for rank, (s, _, p, a, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), a, left, right, total[lang], -s))
    return out


def said(seed, n, vocabulary=12):
    rng = np.random.default_rng(seed)
    ends = ["", "", "", "", ".", ",", "\n", "\t", " ", "\x0b"]
    return " ".join(f"W{x}{ends[y]}" for x, y in zip(rng.zipf(1.5, n) % vocabulary, rng.integers(0, len(ends), n)))


TALK = [
    ("en", said(1, 4000)), ("en", said(2, 900)), ("de", said(3, 2000)), (None, said(4, 500)), ("und", said(4, 500)), ("en", None), ("en", ""), ("en", " \t . , "), ("fr", "é é é é"),
    ("en", said(1, 4000)), ("en", "one two " * 3000), ("en", "x" * 20_000), ("de", "ß ü a b\x1cc " * 40),
]


@pytest.mark.parametrize("chunk, bits", [(1 << 20, 1 << 16), (700, 64)])
def test_phrases(spark, chunk, bits):
    docs = spark.createDataFrame([(i, t, lang, "h", 1) for i, (lang, t) in enumerate(TALK)], "doc_id long, text string, lang string, phrase string, c int")
    got = phrases.collocations(docs.repartition(3), least=5, longest=4, top=15, chunk=chunk, bits=bits)
    assert order(tuple(r) for r in got.collect()) == order(plain_phrases(TALK, 5, 4, 15))


def test_phrases_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(docs).count() == 0


def test_bitmaps_extend_over_blocks_and_not_over_pieces():
    s = phrases.Shard("en", [b"a b " * 100 + b". a", b"b a"])
    h = s.hashes()
    s.bitmaps(np.ones(len(s.words), bool))
    found = {tuple(s.words[i] for i in w): int(n) for words, counts in s.grow(h, 3) for w, n in zip(words, counts)}
    assert found == {(b"a", b"b"): 100, (b"b", b"a"): 100, (b"a", b"b", b"a"): 99, (b"b", b"a", b"b"): 99}


# ---- 12: trie ---------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(int(np.sign(c)) * (abs(c) - abs(c) % 20), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        worth = (len(m) - 1) * len(WORDS.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += worth
            leaves[p[:d]] += not children[p]
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(made[c]) == len(p)))).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items()]


def talks():
    rng = np.random.default_rng(5)
    rows = [(c, t, "user" if t % 2 else None, f"w{rng.integers(0, 2)} " * int(rng.integers(0, 3))) for c in range(-3, 70) for t in range(int(rng.integers(1, 7)))]
    rows += [(100 + c, t, "user", "same words here") for c in range(12) for t in range(5)]  # equal conversations
    rows += [(120, None, "a", "first"), (120, 0, "b", None), (120, 0, "a", "tie"), (120, 0, "a", "tie"), (121, None, None, None), (None, 1, "a", "no id")]
    rows += [(140, t, "user", f"t{t}") for t in range(40)] + [(141, t, "user", f"t{t}") for t in range(40)] + [(142, t, "user", f"t{t}") for t in range(35)]
    return [*rows, (143, 0, "user", "alone"), (165, 0, "user", "one turn, no head")]


@pytest.mark.parametrize("block", [4096, 8])
def test_trie(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "STRETCH", 4)
    rows = talks()
    turns = spark.createDataFrame([(*r, "h", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, pos int").repartition(3)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert order(tuple(r) for r in trie.nodes(turns).select(*names).collect()) == order(plain_trie(rows))


def test_trie_of_no_conversations(spark):
    assert trie.nodes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- 13: toxicity -----------------------------------------------------------------------------

KIND = "doc_id long, text string, lang string, source string, score int"


def remarks(n, seed):
    """Texts of made-up words; every third holds a remark of bad words, or of words with a bad stem, somewhere."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(20, 200)))]
        if bad := i % 3 == 0:
            at = int(rng.integers(0, len(words)))
            words[at:at] = [["vileling", "crudword"][int(rng.integers(0, 2))] if i % 2 else f"grobel{rng.integers(0, 500)}" for _ in range(4)]
        out.append((" ".join(words), int(bad)))
    return out


@pytest.fixture(scope="module")
def fitted():
    rows = remarks(900, 1)
    return toxicity.fit([t for t, _ in rows], np.array([y for _, y in rows], np.float32), epochs=6)


def test_toxicity_on_held_out(fitted):
    rows = remarks(300, 2)
    s = toxicity.scores(fitted, [t for t, _ in rows])
    y = np.array([y for _, y in rows])
    assert ((s >= toxicity.CUTOFF) == y).mean() > 0.9
    clean = " ".join(f"w{i % 3000}" for i in range(30_000))
    a, b = toxicity.scores(fitted, [clean, clean + " crudword vileling crudword vileling"])
    assert b > 0.3 and b > a  # the end of a very long text counts


def test_toxicity_scores_equal_a_plain_loop(fitted):
    w, texts = fitted, [remarks(3, 4)[0][0], "short one", "", None, "wörter " * 33]
    sig = lambda x: 1 / (1 + np.exp(-x))
    got = toxicity.scores(w, texts)
    for text, score in zip(texts, got):
        words = (text or "").lower().encode().split() or [b""]
        single = toxicity.Texts([b.decode() for b in words])
        x = single.inputs(w)[[single.ids[i] for i in range(len(words))]]
        best = -np.inf
        starts = sorted({min(a, max(0, len(words) - toxicity.WINDOW)) for a in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)})
        for a in starts:
            part, k = x[a : a + toxicity.WINDOW], toxicity.HIDDEN
            states = np.zeros((len(part), 2 * k))
            for d in (0, 1):
                h = np.zeros(k)
                for t in range(len(part)) if d == 0 else reversed(range(len(part))):
                    g, u = part[t] @ w["wx"][d] + w["b"][d], h @ w["wh"][d]
                    z, r = sig(g[:k] + u[:k]), sig(g[k : 2 * k] + u[k : 2 * k])
                    c = np.tanh(g[2 * k :] + r * u[2 * k :])
                    h = c + z * (h - c)
                    states[t, d * k : (d + 1) * k] = h
            e = np.tanh(states @ w["wa"] + w["ba"]) @ w["va"]
            p = np.exp(e - e.max())
            best = max(best, float((p / p.sum()) @ states @ w["wo"] + w["bo"][0]))
        assert abs(sig(best) - score) < 1e-3


def test_toxicity_gradients(monkeypatch):
    texts = toxicity.Texts(["some words to try here", "other words " * 20])
    w = {k: v.astype(np.float64) for k, v in toxicity.initial().items()}
    windows, y, weight = np.arange(len(texts.doc)), np.array([1.0] + [0.0] * (len(texts.doc) - 1)), np.ones(len(texts.doc))

    def loss(w):
        z = toxicity.logits({k: v.astype(np.float32) for k, v in w.items()}, texts).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grads = toxicity._step({k: v.astype(np.float32) for k, v in w.items()}, texts, windows, y.astype(np.float32), weight)
    for k, at in (("wh", (0, 1, 2)), ("wh", (1, 3, 30)), ("wx", (1, 4, 5)), ("wa", (2, 3)), ("va", (1,)), ("wo", (5,)), ("b", (0, 7)), ("gram", (int(texts.gram_row[3]), 2)), ("word", (int(texts.word_row[1]), 1))):
        up, down = ({n: v.copy() for n, v in w.items()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - grads[k][at]) < 2e-3, k


def test_toxicity_of_odd_rows(spark):
    rows = [(i, t, None, "h", 1) for i, (t, _) in enumerate(remarks(150, 7))] + [(900, None, None, None, None), (901, "", None, None, None), (None, "no id", None, None, None), (1, "again", None, None, None), (902, "é" * 9000, "xx", None, 0)]
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    labels = spark.createDataFrame([(i, None, y) for i, (_, y) in enumerate(remarks(150, 7))] + [(900, 1, 1), (None, 1, 1), (5, 0, None), (4, 0, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels, toxic=20, clean=30)).collect()
    assert order(str(r.doc_id) for r in got) == order(str(r[0]) for r in rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
    texts, y = toxicity.training_sample(docs, labels, toxic=5, clean=7)
    assert y.sum() <= 5 and len(texts) <= 12 and not any(zlib.crc32(str(i).encode()) % 4 == 2 for i, (t, *_) in itertools.islice(enumerate(remarks(150, 7)), 150) if t in texts)
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 0"))).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), None).count() == 0
    assert docs.select(F.count("*")).first()[0] == len(got)
