"""Phrase collocations by compressed position bitmaps, one for each word of a shard.

A shard is the texts of one language in about ``CHUNK_BYTES`` of a task's input. Its words stand at
consecutive places, with an empty place between two pieces, and each word has a bitmap of its places,
of which only the 64-bit blocks that are not zero are kept. A phrase's bitmap marks the places of its
last word: shifted by one, it is ANDed with the bitmaps of the words that may follow, and popcounts
are how often the longer phrases occur. The empty places keep phrases inside their pieces. Phrases
grow depth first from batches of first words. Popcounts are summed over all shards.

A phrase can only occur often if its words and its pairs do. So words are counted first, then pairs of
frequent words, then triples and quadruples of frequent pairs. What is frequent reaches the tasks as
a bitmap of ``FILTER_BITS`` bits by hash, whose size does not grow with the corpus; what it lets
through by mistake is counted in vain, and sorted out by its sum.

Defined cases: a null or empty text has no words; a null ``lang`` is ``und``; repeated rows count
each, with or without an id; other columns are ignored. A text longer than a shard is cut between pieces.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, sized, table
from .rolling import mix

#: Text of a shard, which sets the memory of a task: over 0.51 GB an executor took 3,023 MB with 16 MB, 2,967 with 6 and 2,304 with 3.
CHUNK_BYTES = 3 << 20
#: Bits of the bitmap of frequent phrases that tasks get: 16 MB at most.
FILTER_BITS = 1 << 27
LEAST, LONGEST, TOP = 30, 4, 2000
#: A phrase lies in a longer one that has this many hundredths of its occurrences.
COVERED = 80
#: Blocks of bitmaps that one batch of first words starts with.
BATCH = 1 << 18

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_SEPARATORS + b"\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * len(_SEPARATORS) + b" abcdefghijklmnopqrstuvwxyz")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_1, _63 = np.uint64(1), np.uint64(63)


# ---- bitmaps ----------------------------------------------------------------------------------


class Shard:
    """Words of some texts, as places in pieces and bitmaps by word."""

    def __init__(self, lang: str, texts: list[bytes]):
        raw = b"\n".join([b"", *texts]).translate(_TABLE)
        arr = np.frombuffer(raw, np.uint8)
        gap = (arr == 32) | (arr == 10)
        start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        piece = np.cumsum(arr == 10, dtype=np.int32)[start]
        index: dict[bytes, int] = defaultdict(count().__next__)
        self.ids = np.fromiter(map(index.__getitem__, raw.split()), np.int32, len(start))
        self.place = np.arange(len(start)) + np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])[: len(start)]
        self.lang, self.words = lang, list(index)

    def counts(self) -> np.ndarray:
        return np.bincount(self.ids, minlength=len(self.words))

    def hashes(self) -> np.ndarray:
        head = self.lang.encode() + b"\0"
        return np.fromiter((xxhash.xxh64_intdigest(head + w) for w in self.words), np.uint64, len(self.words))

    def bitmaps(self, kept: np.ndarray) -> None:
        """Build the bitmaps of the words with ``kept``: rows of word, block and bits, by word and block."""
        stay = kept[self.ids]
        ids, place = self.ids[stay], self.place[stay]
        order = np.argsort(ids, kind="stable")
        ids, place = ids[order].astype(np.int64), place[order]
        size = int(self.place[-1]) // 64 + 2 if len(self.place) else 2
        block = place >> 6
        key = ids * size + block
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        bit = _1 << (place & 63).astype(np.uint64)
        self.word, self.block = ids[first], block[first]
        self.bits = np.bitwise_or.reduceat(bit, first) if len(first) else np.zeros(0, np.uint64)
        self.row = np.zeros(size * 64, np.int32)  # of each place, the row of its word and block
        self.row[place] = np.cumsum(new) - 1
        self.filled = np.zeros(size, np.uint64)  # all bitmaps in one
        np.bitwise_or.at(self.filled, self.block, self.bits)

    def extend(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray):
        """Bitmaps of all phrases one word longer: parent, word and count of each, and rows of phrase, block and bits."""
        over = bits >> _63
        far = np.flatnonzero(over)
        phrase, block = np.concatenate([phrase, phrase[far]]), np.concatenate([block, block[far] + 1])
        left = np.concatenate([bits << _1, over[far]]) & self.filled[block]
        out: list[tuple[np.ndarray, ...]] = []
        while True:
            some = np.flatnonzero(left)
            if not len(some):
                break
            phrase, block, left = phrase[some], block[some], left[some]
            lowest = np.bitwise_count((left & (~left + _1)) - _1)
            row = self.row[block * 64 + lowest]  # the word at the lowest place that is left
            both = left & self.bits[row]
            out.append((phrase * len(self.words) + self.word[row], block, both))
            left = left ^ both
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none, (none, none, np.zeros(0, np.uint64))
        key, block, bits = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(key, kind="stable")
        key, block, bits = key[order], block[order], bits[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        n = np.add.reduceat(np.bitwise_count(bits), first, dtype=np.int64)
        return key[first] // len(self.words), key[first] % len(self.words), n, (np.cumsum(new) - 1, block, bits)

    def grow(self, hashed: np.ndarray, longest: int, follow=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrases of 2 to ``longest`` words, depth first: word ids (a row each) and counts.

        With ``follow``, a phrase stays if it accepts the hash of its last two words.
        """
        edges = sorted({int(np.searchsorted(self.word, self.word[a])) for a in range(0, len(self.word), BATCH)} | {len(self.word)})
        for lo, hi in zip(edges, edges[1:], strict=False):
            roots, phrase = np.unique(self.word[lo:hi], return_inverse=True)
            words, rows = roots[:, None], (phrase, self.block[lo:hi], self.bits[lo:hi])
            for _ in range(longest - 1):
                parent, word, n, rows = self.extend(*rows)
                words = np.column_stack([words[parent], word])
                if follow is not None:
                    stay = follow(pair_hash(hashed[words[:, -2:]]))
                    turn = np.cumsum(stay) - 1
                    mine = stay[rows[0]]
                    words, n, rows = words[stay], n[stay], (turn[rows[0][mine]], *(x[mine] for x in rows[1:]))
                if not len(words):
                    break
                yield words, n


def pair_hash(hashed: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their words, a row each."""
    out = np.zeros(len(hashed), np.uint64)
    for j in range(hashed.shape[1]):
        out = mix(out * _ODD + hashed[:, j])
    return out


def shards(batches, limit: int = CHUNK_BYTES) -> Iterator[Shard]:
    """Shards of the rows ``(lang, text)``, texts as bytes."""
    held: dict[str, list[bytes]] = defaultdict(list)
    total = 0
    for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            raw = text.translate(_TABLE) if len(text) > limit else text
            at = 0
            while at < len(raw) or not at:
                cut = raw.rfind(b"\n", at, at + limit) + 1 if len(raw) - at > limit else len(raw)
                if len(raw) - at > limit and not cut:
                    cut = raw.find(b"\n", at + limit) + 1 or len(raw)
                held[lang].append(raw[at:cut])
                total += cut - at
                at = max(cut, 1)
                if total >= limit:
                    yield from (Shard(*x) for x in held.items())
                    held.clear()
                    total = 0
    yield from (Shard(*x) for x in held.items())


# ---- jobs -------------------------------------------------------------------------------------

_COUNTED = "lang string, phrase string, c long"


def _rows(shard: Shard, words: np.ndarray, n: np.ndarray, step: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    said = pa.array(shard.words, pa.binary()).cast(pa.string())
    for at in range(0, len(n), step):
        some, c = words[at : at + step], pa.array(n[at : at + step])
        phrase = pc.binary_join_element_wise(*(said.take(pa.array(some[:, j])) for j in range(some.shape[1])), " ")
        yield pa.RecordBatch.from_arrays([pa.repeat(shard.lang, len(c)), phrase, c], ["lang", "phrase", "c"])


def _summed(docs: DataFrame, run) -> DataFrame:
    return docs.mapInArrow(run, _COUNTED).groupBy("lang", "phrase").agg(F.sum("c").alias("c"))


def _filter(phrases: DataFrame, bits: int):
    """The bitmap of the hashes of ``phrases``, as a broadcast: 64-bit words, at most ``bits`` bits in all."""
    words = bits // 64

    def run(batches):
        for b in batches:
            hashed: dict[int, list[list[int]]] = defaultdict(list)
            for lang, phrase in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist(), strict=True):
                head = lang.encode() + b"\0"
                each = [xxhash.xxh64_intdigest(head + w) for w in phrase.encode().split(b" ")]
                hashed[len(each)].append(each)
            for rows in hashed.values():
                at = pair_hash(np.array(rows, np.uint64)) % np.uint64(bits)
                bit = (_1 << (at & _63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit)], ["w", "b"])

    found = phrases.select("lang", "phrase").mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(words, np.uint64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return phrases.sparkSession.sparkContext.broadcast(out)


def _passes(bitmap: np.ndarray):
    size = np.uint64(len(bitmap) * 64)

    def test(hashes: np.ndarray) -> np.ndarray:
        at = hashes % size
        return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & _63)) & _1 != 0

    return test


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = FILTER_BITS, chunk: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, c)`` of all phrases of up to ``longest`` words that occur ``least`` times or more, and ``(lang, n)``."""
    given = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def count_words(batches):
        for s in shards(batches, chunk):
            yield from _rows(s, np.arange(len(s.words))[:, None], s.counts().astype(np.int64))

    words = materialize(_summed(given, count_words))
    totals = words.groupBy("lang").agg(F.sum("c").alias("n"))
    parts = [words.where(F.col("c") >= least)]
    if longest > 1:
        single = _filter(parts[0], bits)

        def count_pairs(batches):
            keep = _passes(single.value)
            for s in shards(batches, chunk):
                h = s.hashes()
                s.bitmaps(keep(pair_hash(h[:, None])))
                for found, n in s.grow(h, 2):
                    yield from _rows(s, found, n)

        parts.append(materialize(_summed(given, count_pairs).where(F.col("c") >= least)))
    if longest > 2:
        double = _filter(parts[1], bits)

        def count_longer(batches):
            keep, follow = _passes(single.value), _passes(double.value)
            for s in shards(batches, chunk):
                h = s.hashes()
                s.bitmaps(keep(pair_hash(h[:, None])))
                for found, n in s.grow(h, longest, follow):
                    if found.shape[1] > 2:
                        yield from _rows(s, found, n)

        parts.append(materialize(_summed(given, count_longer).where(F.col("c") >= least)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, **how) -> DataFrame:
    """Each language's ``top`` phrases: ``(lang, rank, phrase, a, l, r, n, score)``.

    A phrase's score is that of its weakest cut in two, twice its share of what the two parts occur,
    in millionths. Phrases that nearly always lie in one longer phrase are left out.
    """
    counts, totals = frequent(docs, least, longest, **how)
    size = F.size(F.split("phrase", " "))
    given = counts.withColumn("k", size)
    candidates = given.where("k > 1").withColumnRenamed("c", "a")
    said = F.split("phrase", " ")
    piece = lambda start, n: F.array_join(F.slice(said, start, n), " ")
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), F.col("k"))
    cuts = cuts.select("lang", "phrase", "a", "cut", piece(F.lit(1), F.col("cut")).alias("first"), piece(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    part = sized(given.where(F.col("k") < longest).select("lang", "phrase", "c"))
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(part.select("lang", F.col("phrase").alias(side), F.col("c").alias(name)), ["lang", side])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("score", F.expr("cast(2000000 * cast(a as decimal(25,0)) div (cast(l as decimal(25,0)) + r) as bigint)"))
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    # what lies in a longer phrase: each longer one names all its shorter parts
    inner = candidates.where("k > 2").select(
        "lang", F.col("a").alias("longer"), F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"), "phrase", "k"
    ).select("lang", "longer", "m", "phrase", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("at"))
    inner = inner.groupBy("lang", piece(F.col("at"), F.col("m")).alias("phrase")).agg(F.max("longer").alias("longer"))
    kept = weakest.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * wide("longer") < COVERED * wide("a")))
    # ranks without one task for a language: rows in order, numbered from where each part begins
    order = [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")]
    flat = kept.select("lang", "phrase", "a", "x.l", "x.r", "x.score").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(flat.withColumn("at", F.monotonically_increasing_id()))
    share = F.shiftright("at", 33).alias("share")
    begun = placed.groupBy("lang", share).agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("lang").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).where(F.col("before") < top)
    ranked = placed.withColumn("share", share).join(F.broadcast(begun), ["lang", "share"])  # of each language, the parts that its first ``top`` rows lie in
    ranked = ranked.withColumn("rank", F.col("before") + F.col("at") - F.col("begin") + 1).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with pieces as (
    select row_number() over () as p, * from (
        select coalesce(lang, 'und') as lang,
            unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as t
        from documents)),
words as (
    select p, lang, generate_subscripts(w, 1) as i, unnest(w) as w1 from (select p, lang, regexp_extract_all(t, '[^\x20\x09]+') as w from pieces)),
near as (
    select lang, w1, lead(w1, 1) over s as w2, lead(w1, 2) over s as w3, lead(w1, 3) over s as w4 from words window s as (partition by p order by i)),
occurring as (
    select lang, 1 as k, w1 as phrase from near
    union all select lang, 2, w1 || ' ' || w2 from near where w2 is not null
    union all select lang, 3, w1 || ' ' || w2 || ' ' || w3 from near where w3 is not null
    union all select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 from near where w4 is not null),
f as (select lang, k, phrase, count(*)::hugeint as c from occurring group by all),
n as (select lang, sum(c)::hugeint as n from f where k = 1 group by lang),
cand as (select lang, k, phrase, c as a, string_split(phrase, ' ') as w from f where k > 1 and c >= 30),
cut as (
    select c.lang, c.phrase, c.a, x.c as l, y.c as r, u.i as cut_at, (2000000 * c.a) // (x.c + y.c) as score
    from cand c, (values (1), (2), (3)) u(i), f x, f y
    where u.i < c.k and x.lang = c.lang and y.lang = c.lang
        and x.phrase = array_to_string(c.w[1:u.i], ' ') and y.phrase = array_to_string(c.w[u.i + 1:c.k], ' ')),
weakest as (select * from cut qualify row_number() over (partition by lang, phrase order by score, cut_at) = 1),
inner_ as (
    select c.lang, array_to_string(c.w[s.i:s.i + m.i - 1], ' ') as phrase, max(c.a) as longer
    from cand c, (values (2), (3)) m(i), (values (1), (2), (3)) s(i)
    where m.i < c.k and s.i + m.i - 1 <= c.k group by 1, 2),
kept as (select w.* from weakest w left join inner_ i using (lang, phrase) where i.longer is null or 100 * i.longer < 80 * w.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select r.lang, r.rank::bigint as rank, r.phrase, r.a::bigint as a, r.l::bigint as l, r.r::bigint as r, n.n::bigint as n, r.score::bigint as score
from ranked r join n using (lang) where r.rank <= 2000
"""
