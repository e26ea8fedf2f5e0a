"""String operators: cleanup, slugs, templates, codecs, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import empty, fold, let, literal, struct


def cleanup(text: Column) -> Column:
    """Without control characters and trailing blanks, four line ends or more as three, trimmed."""
    x = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t]+\n", "\n"), r"\n{4,}", "\n\n\n")
    return F.regexp_replace(x, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def plain_prompt(text: Column) -> Column:
    """Without brackets, back-ticks, bullets and numbering; runs of white space as one space."""
    x = F.regexp_replace(text, r"[\[\]{}`]", "")
    x = F.regexp_replace(x, r"(?m)^[ \t]*(?:[-*#>|]+|[0-9]+[.)])[ \t]+", "")
    return F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def unique_slugs(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Adds slug and token. The first row of a slug has it as its token, later ones the slug with the next of
    -2, -3 and so on that is not itself the slug of some row; so tokens are unique."""
    base = rows.withColumn("slug", slug(F.col(name)))
    numbered = base.withColumn("_n", F.row_number().over(Window.partitionBy("slug").orderBy(order)))
    tail = r"^(.*)-([1-9][0-9]*)$"
    taken = (
        base.where(F.col("slug").rlike(tail))
        .groupBy(F.regexp_extract("slug", tail, 1).alias("_base"))
        .agg(F.sort_array(F.collect_set(F.try_to_number(F.regexp_extract("slug", tail, 2), F.lit("9999999999")).cast("long"))).alias("_taken"))
    )
    joined = numbered.join(taken, F.col("slug") == F.col("_base"), "left")
    # the r-th free number from 2 on: each taken one with fewer than r free ones before it moves it on
    r = F.col("_n") - 1
    before = F.size(F.filter(F.coalesce("_taken", F.array().cast("array<bigint>")), lambda t, i: (t >= 2) & (t - i - 2 < r)))
    free = r + 1 + before
    return joined.withColumn("token", F.when(F.col("_n") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", free))).drop("_n", "_base", "_taken")


def generalise_ages(text: Column) -> Column:
    """Ages of ninety and over as a class."""
    x = F.regexp_replace(text, r"(?i)\b(?:9[0-9]|1[01][0-9])[ -](?:years?|yrs?)[ -]old\b", "[AGE 90+]")
    return F.regexp_replace(x, r"(?i)\bage[d: ]+(?:9[0-9]|1[01][0-9])\b", "[AGE 90+]")


def interpolate(template: Column, values: dict[str, Column]) -> Column:
    """Tokens in double braces replaced, the longest token first, in one chain."""
    for token in sorted(values, key=lambda t: (-len(t), t)):
        template = F.replace(template, F.lit("{{" + token + "}}"), F.coalesce(values[token], F.lit("")))
    return template


def compact(text: Column, limit: int, head: float = 0.55, tail: float = 0.35) -> Column:
    """A text over ``limit`` as its head and its tail with a mark between."""
    h, t = int(limit * head), int(limit * tail)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substr(text, F.lit(1), F.lit(h)), F.lit("\n[...]\n"), F.right(text, F.lit(t))))


def hue(token: Column) -> Column:
    """The 31-fold rolling hash of the characters modulo 2**32, as a hue."""
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % 4294967296) % 360


def url_code(text: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/\r\n", "-_"), F.lit("="))  # of one line


def url_decode(code: Column) -> Column:
    plain = F.translate(code, "-_", "+/")
    return F.decode(F.unbase64(F.rpad(plain, (F.ceil(F.length(code) / 4) * 4).cast("int"), F.lit("="))), "UTF-8")


def nth_position(text: Column, literal: str, n: int) -> Column:
    """Where the n-th occurrence begins, from 0; null if there are fewer."""
    have = F.size(F.split(text, F.lit("\\Q" + literal + "\\E"), -1)) - 1
    return F.when(have >= n, F.length(F.substring_index(text, literal, n)))


def chunks(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, chunk_no, start, chunk)``: windows of ``size`` characters that overlap."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1)).cast("int")
    each = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    start = F.col("chunk_no") * step
    return each.select(key, "chunk_no", start.alias("start"), F.substr("t", start + 1, F.lit(size)).alias("chunk"))


def model_chunks(text: str, size: int = 700, overlap: int = 80, least: float = 0.55) -> Column:
    """Windows of a text for a model: an array of (offset, chunk). A window ends after its last line end past ``least`` of it, and the next begins ``overlap`` before that."""
    kind, n = "struct<offset:bigint,chunk:string>", f"length({text})"
    turns = f"sequence(1, cast(ceil({n} / {max(1, int(size * least) - overlap)}) as int) + 1)"

    def step(at: str, _: str) -> tuple[str, str]:
        window = f"substr({text}, cast({at} + 1 as int), {size + 1})"
        line = f"({at} + length(mw) - mb)"
        cut = let("mw", window, let("mb", "instr(reverse(mw), '\\n')", f"if({at} + {size} < {n} and mb > 0 and {line} > {at} + {int(size * least)}, {line} + 1, least({at} + {size}, {n}))"))
        following = let("mc", cut, f"cast(if(mc >= {n}, null, if(mc - {overlap} <= {at}, mc, mc - {overlap})) as bigint)")
        out = let("mc", cut, struct(offset=f"cast({at} as bigint)", chunk=f"substr({text}, cast({at} + 1 as int), cast(mc - {at} as int))"))
        return following, f"if({at} is not null, array({out}), {empty(kind)})"

    return F.expr(f"if({text} is null, null, {fold(turns, 'cast(0 as bigint)', kind, step, 'chunk')})")


def halves(chunk: Column, edge: int = 80) -> Column:
    """A chunk that was too long for the model as two: at the blank nearest to its middle, not within ``edge`` of an end."""
    n = F.length(chunk)
    middle = F.floor(n / 2).cast("int")
    left = middle - F.instr(F.reverse(F.substr(chunk, F.lit(1), middle + 1)), " ") + 1
    right = middle + F.instr(F.substr(chunk, middle + 1), " ") - 1
    fits = lambda x: F.when((x > edge) & (x < n - edge) & (F.substr(chunk, x + 1, F.lit(1)) == " "), x)
    l_, r = fits(left), fits(right)
    at = F.coalesce(F.when(r.isNull() | (middle - l_ <= r - middle), l_), r, middle - 1) + 1
    return F.array(F.substr(chunk, F.lit(1), at.cast("int")), F.substr(chunk, (at + 1).cast("int")))


def hsl_hex(hue_: Column, saturation: float = 0.6, light: float = 0.5) -> Column:
    """A hue in degrees, with saturation and lightness from 0 to 1, as #rrggbb."""
    a = saturation * min(light, 1 - light)

    def part(n: int) -> Column:
        k = (F.lit(float(n)) + hue_ / 30.0) % 12.0
        value = F.lit(light) - a * F.greatest(F.lit(-1.0), F.least(k - 3.0, 9.0 - k, F.lit(1.0)))
        return F.lpad(F.lower(F.hex(F.round(value * 255).cast("int"))), 2, "0")

    return F.concat(F.lit("#"), part(0), part(8), part(4))


def segments(template: Column) -> Column:
    """A template as what a preview shows: an array of (token, text), where token says that the text is a token's name."""
    marks = r"\{\{[A-Za-z0-9_.-]+\}\}"
    plain, found = F.split(template, marks, -1), F.regexp_extract_all(template, F.lit(marks), F.lit(0))
    text = lambda x: F.struct(F.lit(False).alias("token"), x.alias("text"))
    name = lambda x: F.struct(F.lit(True).alias("token"), F.regexp_replace(x, r"[{}]", "").alias("text"))
    both = F.zip_with(plain, found, lambda p, m: F.array(text(p), F.when(m.isNotNull(), name(m))))
    return F.filter(F.flatten(both), lambda x: x.isNotNull() & (x.text != ""))


def restored(text: Column, placeholder: Column, n: Column, original: Column) -> Column:
    """The text with the n-th of a placeholder, from 1, replaced by what it stood for; as it is if there are fewer."""
    gaps = F.split(text, F.concat(F.lit("\\Q"), placeholder, F.lit("\\E")), -1)
    before = F.array_join(F.slice(gaps, F.lit(1), n), "\x00")
    after = F.array_join(F.slice(gaps, n + 1, F.greatest(F.size(gaps) - n, F.lit(0))), "\x00")
    put = lambda x: F.replace(x, F.lit("\x00"), placeholder)
    return F.when(F.size(gaps) > n, F.concat(put(before), original, put(after))).otherwise(text)


def rendered(text: str, spans: str) -> Column:
    """What became of each span: an array of (start, end, original, replacement, output_start), where spans are disjoint and in order."""
    kind = "struct<start:bigint,end:bigint,original:string,replacement:string,output_start:bigint>"

    def step(shift: str, s: str) -> tuple[str, str]:
        original = f"substr({text}, cast({s}.start + 1 as int), cast({s}.end - {s}.start as int))"
        row = struct(start=f"{s}.start", end=f"{s}.end", original=original, replacement=f"concat('[', {s}.label, ']')", output_start=f"{s}.start + {shift}")
        return f"{shift} + length({s}.label) + 2 - ({s}.end - {s}.start)", f"array({row})"

    return F.expr(fold(spans, "cast(0 as bigint)", kind, step, "shown"))


def title_order(rows: DataFrame, title: str, key: str, collation: str = "UNICODE_CI_AI") -> DataFrame:
    """``(key, place, same)``: each row's place in the order of a collation, ties by key, and how many titles are equal in it.

    For listings of a page or a library: one task orders all rows.
    """
    own = F.collate(F.col(title), collation)
    return rows.select(key, F.row_number().over(Window.orderBy(own, key)).alias("place"), F.count(F.lit(1)).over(Window.partitionBy(own)).alias("same"))


_LABEL = r"^\[[^\[\]]*\]"


def aligned(source: str, spans: str, output: str) -> Column:
    """What an output that another engine made has in place of each span: an array of (start, end, original, replacement, output_start).

    Both texts are walked with a cursor each: what lies between two spans is looked for in the output
    from the cursor on, and what stands before it there replaces the span; a label in brackets is taken whole. The last span's replacement
    reaches to what follows it, or to the end. A fragment that the output does not have leaves the cursor; the replacement is then null.
    """
    kind = "struct<start:bigint,end:bigint,original:string,replacement:string,output_start:bigint>"
    part = lambda x, a, b: f"substr({x}, cast({a} + 1 as int), cast(greatest({b} - {a}, 0) as int))"
    follows = f"if(i + 1 < size(al), {part(source, 'x.end', 'al[i + 1].start')}, substr({source}, cast(x.end + 1 as int)))"
    row = struct(start="x.start", end="x.end", original=part(source, "x.start", "x.end"), lead=f"if(i = 0, {part(source, '0', 'x.start')}, '')", tail=follows)
    items = let("al", spans, f"transform(al, (x, i) -> {row})")

    def step(at: str, x: str) -> tuple[str, str]:
        begin = let("lf", f"if({x}.lead = '', 0, locate({x}.lead, {output}, cast({at} + 1 as int)))", f"cast(if(lf > 0, lf - 1 + length({x}.lead), {at}) as bigint)")
        # a label in brackets, which may hold what follows the span
        label = f"length(regexp_extract(substr({output}, cast(ab + 1 as int), 200), {literal(_LABEL)}, 0))"
        found = f"case when bl > 0 and startswith(substr({output}, cast(ab + bl + 1 as int), length({x}.tail)), {x}.tail) then ab + bl + 1 when {x}.tail = '' then length({output}) + 1 else locate({x}.tail, {output}, cast(ab + 1 as int)) end"
        stop = let("bl", label, found)
        following = let("ab", begin, let("st", stop, f"cast(if(st > 0, st - 1 + length({x}.tail), ab) as bigint)"))
        made = struct(start=f"{x}.start", end=f"{x}.end", original=f"{x}.original", replacement=f"if(st > 0, {part(output, 'ab', '(st - 1)')}, null)", output_start="ab")
        return following, f"array({let('ab', begin, let('st', stop, made))})"

    return F.expr(fold(items, "cast(0 as bigint)", kind, step, "align"))


#: Errors of a model that mean its input was too long; other errors are not tried again in halves.
TOO_LONG = r"(?i)\b(?:sequence|input|token)s?\b.*\b(?:too long|exceeds?|longer than|maximum|limit)\b|out of (?:range|bounds)"


def too_long(error: Column) -> Column:
    return F.coalesce(error.rlike(TOO_LONG), F.lit(False))
