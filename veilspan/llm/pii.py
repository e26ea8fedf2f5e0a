"""Personal data by weak supervision, in DataFrame functions only.

Base patterns find emails, addresses, cards and phones; those spans always stay. Wider patterns
yield further candidates (secrets, numbers of persons, titled names). On each candidate three
labelers vote for, against or not at all: a strict pattern, a gazetteer, and the words before it.
Expectation-maximisation on the counts of vote patterns estimates each labeler's reliability for
each kind without any labels; the posteriors then train a logistic span classifier on votes,
length and digits, which decides. What reaches the driver is one row for each vote pattern, of
which there are a fixed number.

Positions count code points, ends are exclusive. Patterns are possessive and anchored at the
start of a run, so that long runs take linear time.

Defined cases: a null text counts as empty; no match gives counts of zero, an empty list and the
hash of the empty text; repeated rows each get their own equal result; null ids are kept; without
candidates the classifier accepts none; other columns are ignored or, in :func:`redact`, kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GIVEN_NAMES, free_name, materialize, sized, table
from .substrings import keyed, with_keys

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "person_id", "name")
KINDS = BASE + EXTRA

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+",
    "person_id": r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![0-9A-Za-z-])",
    "name": rf"(?<![\p{{L}}\d])(?:{_TITLES})\.?+ \p{{Lu}}\p{{Ll}}++(?: \p{{Lu}}\p{{Ll}}++)?+",
}
#: What a text must hold for a kind to be looked for.
_NEEDS = {"email": "@", "phone": "+"}
_DIGIT = r"[0-9]"

SECRET_PREFIXES = "sk-|ghp_|gho_|AKIA|xox[abp]-|eyJ"
#: Countries whose account numbers begin with their code.
ACCOUNT_COUNTRIES = (
    "AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR GT HR HU IE IL IS IT KW KZ LB LI LT LU LV MC MD "
    "ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR UA VG XK"
).split()
_CUES = {
    "secret": r"(?i)\b(?:token|key|secret|passwor[dt]|passwd|pwd|bearer|credential)s?\W{0,6}$",
    "person_id": r"(?i)\b(?:ssn|social security|iban|account|passport|id|number|no)\W{0,6}$",
    "name": r"(?i)\b(?:by|from|dear|contact|patient|signed|with|name|von|de|par)\W{0,4}$",
}
_TAIL = 40


def _said(kind: str):
    return lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(x.p).alias("gap"), F.right(x.p, F.lit(_TAIL)).alias("tail"), x.m.alias("m")
    )


def _found(text: Column) -> Column:
    """All raw matches of a text: kind, number, length of the text since the last match, its tail, the match."""
    out = []
    for kind in KINDS:
        pattern = PATTERNS[kind]
        needs = text.contains(_NEEDS[kind]) if kind in _NEEDS else F.lit(True) if kind == "name" else text.rlike(_DIGIT)
        parts = F.arrays_zip(F.split(text, F.lit(pattern), -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
        matches = F.filter(parts, lambda x: x.m.isNotNull())
        out.append(F.when(needs, F.transform(matches, _said(kind))))
    kind = "array<struct<kind:string,i:int,gap:int,tail:string,m:string>>"
    return F.concat(*[F.coalesce(x, F.array().cast(kind)) for x in out])


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + twice

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid_base(kind: Column, m: Column) -> Column:
    """Whether a raw match of a base kind stands."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    card = F.length(digits).between(12, 19)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", m.rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(kind == "card", F.when(card, _luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(False)
    )


def _votes(kind: Column, m: Column, tail: Column, names: Sequence[str]) -> list[Column]:
    """The votes of the strict pattern, the gazetteer and the context: 1 for, -1 against, 0 none."""
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    strict = (
        F.when(kind == "secret", F.when(m.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | (m.rlike("[a-z]") & m.rlike("[A-Z]") & (digits >= 4)), 1).otherwise(-1))
        .when(kind == "person_id", F.when(m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$") | m.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{15,}$"), 1).otherwise(-1))
        .otherwise(F.when(m.rlike(r"\. "), 1).otherwise(0))
    )
    known = (
        F.when(kind == "secret", F.when(m.rlike(f"^(?:{SECRET_PREFIXES})"), 1).when(m.rlike("^[0-9/_+-]+$"), -1).otherwise(0))
        .when(kind == "person_id", F.when(m.rlike("^[0-9]"), 0).when(F.substr(m, F.lit(1), F.lit(2)).isin(*ACCOUNT_COUNTRIES), 1).otherwise(-1))
        .when(kind == "name", F.when(F.exists(F.split(m, "[ .]+"), lambda w: w.isin(*names)), 1).otherwise(0))
        .otherwise(0)
    )
    cue = F.lit(False)
    for k, pattern in _CUES.items():
        cue = F.when(kind == k, tail.rlike(pattern)).otherwise(cue)
    return [strict.alias("v0"), known.alias("v1"), F.when(cue, 1).otherwise(F.when(kind == "name", 0).otherwise(-1)).alias("v2")]


_FEATURES = ["kind", "v0", "v1", "v2", "long", "digits"]


def candidates(docs: DataFrame, names: Sequence[str] = GIVEN_NAMES) -> DataFrame:
    """Rows ``(k, th, kind, start, end, base, v0, v1, v2, long, digits)``: base spans and candidates of different texts."""
    raw = keyed(docs).select("k", "th", _found(F.coalesce("text", F.lit(""))).alias("found")).where(F.size("found") > 0)
    once = materialize(raw.dropDuplicates(["k", "th"]))
    each = once.select("k", "th", F.explode("found").alias("f")).select("k", "th", "f.*")
    upto = Window.partitionBy("k", "th", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.length("m")).over(upto)).withColumn("start", F.col("end") - F.length("m"))
    kind, m = F.col("kind"), F.col("m")
    share = F.length(F.regexp_replace(m, "[^0-9]", "")) / F.length(m)
    marked = placed.withColumn("base", _valid_base(kind, m)).where(F.col("base") | kind.isin(*EXTRA))
    return marked.select(
        "k", "th", "kind", "start", "end", "base", *_votes(kind, m, F.col("tail"), names),
        F.least(F.floor(F.length("m") / 8), F.lit(6)).cast("int").alias("long"), F.floor(share * 4).cast("int").alias("digits"),
    )


def reliabilities(patterns: Iterable[dict], rounds: int = 50) -> dict[tuple, float]:
    """Expectation-maximisation: the posterior that a candidate is personal data, by (kind, votes).

    Each labeler has, for each kind, a chance of each vote on true and on false candidates.
    """
    counts: dict[str, dict[tuple, float]] = {}
    for p in patterns:
        votes = counts.setdefault(p["kind"], {})
        key = (p["v0"], p["v1"], p["v2"])
        votes[key] = votes.get(key, 0) + p["n"]
    out = {}
    for kind, votes in counts.items():
        prior = 0.5
        # at first a vote for is right in four of five cases
        chance = [{y: {v: 0.6 if v == y else 0.25 if v == 0 else 0.15 for v in (-1, 0, 1)} for y in (-1, 1)} for _ in range(3)]
        for _ in range(rounds):
            post = {}
            for key in votes:
                yes, no = math.log(prior), math.log(1 - prior)
                for j, v in enumerate(key):
                    yes += math.log(chance[j][1][v])
                    no += math.log(chance[j][-1][v])
                post[key] = 1 / (1 + math.exp(min(700, max(-700, no - yes))))
            total = sum(votes.values())
            right = sum(n * post[key] for key, n in votes.items())
            prior = min(0.99, max(0.01, (right + 1) / (total + 2)))
            for j in range(3):
                for y in (-1, 1):
                    weight = {v: 6 * (0.6 if v == y else 0.25 if v == 0 else 0.15) for v in (-1, 0, 1)}  # a prior of six votes
                    for key, n in votes.items():
                        weight[key[j]] += n * (post[key] if y == 1 else 1 - post[key])
                    whole = sum(weight.values())
                    chance[j][y] = {v: w / whole for v, w in weight.items()}
        out |= {(kind, *key): p for key, p in post.items()}
    return out


def _inputs(p: dict) -> list[str]:
    return ["bias", *[f"{c}={p['kind']},{p[c]}" for c in _FEATURES[1:]]]


def classifier(patterns: list[dict], rounds: int = 300, rate: float = 1.0) -> dict[str, float]:
    """Weights of a logistic classifier on the features, trained on the posteriors of the votes."""
    soft = reliabilities(patterns)
    total = sum(p["n"] for p in patterns) or 1
    rows = [(_inputs(p), soft[p["kind"], p["v0"], p["v1"], p["v2"]], p["n"] / total) for p in patterns]
    # each kind weighs alike, however many candidates it has
    share: dict[str, float] = {}
    for p, (_, _, n) in zip(patterns, rows, strict=True):
        share[p["kind"]] = share.get(p["kind"], 0) + n
    w: dict[str, float] = {}
    for _ in range(rounds):
        step: dict[str, float] = {}
        for p, (xs, y, n) in zip(patterns, rows, strict=True):
            z = sum(w.get(x, 0.0) for x in xs)
            g = (y - 1 / (1 + math.exp(-max(-50, min(50, z))))) * n / share[p["kind"]]
            for x in xs:
                step[x] = step.get(x, 0) + g
        for x, g in step.items():
            w[x] = w.get(x, 0.0) + rate * (g - 0.001 * w.get(x, 0.0))
    return w


def _score(weights: dict[str, float]) -> Column:
    out = F.lit(weights.get("bias", 0.0))
    for c in _FEATURES[1:]:
        own = {x.split("=")[1]: v for x, v in weights.items() if x.startswith(f"{c}=")}
        if own:
            table = F.create_map(*[F.lit(y) for x in own.items() for y in x])
            out = out + F.coalesce(table[F.concat_ws(",", F.col("kind"), F.col(c))], F.lit(0.0))
    return out


def spans(docs: DataFrame, names: Sequence[str] = GIVEN_NAMES) -> DataFrame:
    """Rows ``(k, th, kind, start, end, base)`` that stand: base spans, and candidates that the classifier accepts."""
    found = materialize(candidates(docs, names))
    patterns = [r.asDict() for r in found.where("not base").groupBy(*_FEATURES).agg(F.count(F.lit(1)).alias("n")).orderBy(*_FEATURES).collect()]
    accepted = F.col("base") | (_score(classifier(patterns)) > 0) if patterns else F.col("base")
    return found.where(accepted).select("k", "th", "kind", "start", "end", "base")


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def report(docs: DataFrame, names: Sequence[str] = GIVEN_NAMES) -> DataFrame:
    """For each row of ``docs`` its counts, the hash of its base spans, and the list of all spans; ``names`` is the gazetteer."""
    each = F.struct("start", _rank(F.col("kind")).alias("o"), F.concat_ws(":", "kind", "start", "end").alias("s"))
    listed = spans(docs, names).groupBy("k", "th").agg(
        *[F.sum(F.when(F.col("base") & (F.col("kind") == k), 1).otherwise(0)).alias(f"n_{k}") for k in BASE],
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("base"), each))), lambda x: x.s), ",").alias("b"),
        F.array_join(F.transform(F.sort_array(F.collect_list(each)), lambda x: x.s), ",").alias("spans"),
    )
    own = keyed(docs).select("doc_id", "k", "th")
    text = lambda c: F.coalesce(c, F.lit(""))
    return own.join(listed, ["k", "th"], "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE], F.sha2(text("b"), 256).alias("base_sha256"), text("spans").alias("spans")
    )


def redact(docs: DataFrame, names: Sequence[str] = GIVEN_NAMES) -> DataFrame:
    """``docs`` with each span's text replaced by its kind in angle brackets; of overlapping spans the first stands for all."""
    order = Window.partitionBy("k", "th").orderBy("start", _rank(F.col("kind")))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans(docs, names).withColumn("new", (F.coalesce(reach, F.lit(-1)) <= F.col("start")).cast("int"))
    merged = fresh.withColumn("g", F.sum("new").over(order)).groupBy("k", "th", "g").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", _rank(F.col("kind")))).alias("kind")
    )
    mine, k, th = with_keys(docs)
    found, text = free_name(mine.columns, "cuts"), F.col("text")
    cuts = merged.groupBy(F.col("k").alias(k), F.col("th").alias(th)).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias(found))
    joined = mine.join(sized(materialize(cuts), F.size(found)), [k, th], "left")  # few texts hold any
    at0 = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    spliced = F.aggregate(
        found,
        at0,
        lambda acc, c: F.struct(
            c.end.alias("at"),
            F.concat(
                acc.out, F.array(F.substr(text, (acc["at"] + 1).cast("int"), (c.start - acc["at"]).cast("int")), F.concat(F.lit("<"), c.kind, F.lit(">")))
            ).alias("out"),
        ),
        lambda acc: F.concat(F.array_join(acc.out, ""), F.substr(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    return joined.withColumn("text", F.when(F.col(found).isNull(), text).otherwise(spliced)).drop(k, th, found)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
