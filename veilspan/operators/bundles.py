"""Bundles that travel as URL-safe text: compact forms of checklists and answers, and the files around them.

A bundle is JSON with one-letter names and positional arrays. Decoding takes the compact form and the
long one of earlier versions; text that is neither gives a row with an ``error`` and null fields, so
one bad input stops nothing. A null input is an error too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .dates import using

#: Names of the forms; another family of files can be read by passing other names.
CHECKLIST, RETURN, TRANSFER = "checklist_bundle_v1", "checklist_return_v1", "transfer_file_v1"
_ANSWER = "struct<item:string,selected:array<string>,note:string>"


def _text(j: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(j, path), F.lit(""))


def compact_answers(answers: Column) -> Column:
    """Answers (item, selected, note) as JSON of item to [selected, note]; those without either are left out."""
    full = F.filter(answers, lambda a: (F.size(a.selected) > 0) | (F.coalesce(a.note, F.lit("")) != ""))
    pair = lambda a: F.concat(F.lit("["), F.to_json(a.selected), F.lit(","), F.to_json(F.array(F.coalesce(a.note, F.lit("")))), F.lit("]"))
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    each = F.transform(full, lambda a: F.concat(quoted(a.item), F.lit(":"), F.regexp_replace(pair(a), r",\[(\".*\")\]\]$", ",$1]")))
    return F.concat(F.lit("{"), F.array_join(each, ","), F.lit("}"))


def expand_answers(answers: Column) -> Column:
    """Answers of either form: item to [selected, note], or item to an object with these names."""
    pairs = F.map_entries(F.from_json(answers, "map<string,string>"))

    def one(e: Column) -> Column:
        short = e.value.startswith("[")
        chosen = F.when(short, F.get_json_object(e.value, "$[0]")).otherwise(F.get_json_object(e.value, "$.selected"))
        note = F.when(short, F.get_json_object(e.value, "$[1]")).otherwise(F.get_json_object(e.value, "$.note"))
        return F.struct(e.key.alias("item"), F.coalesce(F.from_json(chosen, "array<string>"), F.array().cast("array<string>")).alias("selected"), F.coalesce(note, F.lit("")).alias("note"))

    return F.coalesce(F.transform(pairs, one), F.array().cast(f"array<{_ANSWER}>"))


def compact_items(items: Column, titles: Column) -> Column:
    """Checklist items as positional arrays: id, place of the title, e or h, text, choices, m or o, system."""
    q = lambda x: F.regexp_extract(F.to_json(F.array(F.coalesce(x, F.lit("")))), r"(?s)^\[(.*)\]$", 1)
    at = lambda i: F.greatest(F.array_position(titles, i.title) - 1, F.lit(0)).cast("string")
    each = F.transform(
        items,
        lambda i: F.concat(
            F.lit("["), F.concat_ws(",", q(i.id), at(i), F.when(i.kind == "exam", '"e"').otherwise('"h"'), q(i.text), F.to_json(i.choices), F.when(i.select == "many", '"m"').otherwise('"o"'), q(i.system)), F.lit("]")
        ),
    )
    return F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))


def expand_items(items: Column, titles: Column) -> Column:
    """Items of :func:`compact_items`: an array of (id, title, kind, text, choices, select, system)."""
    get = lambda x, i: F.get_json_object(x, f"$[{i}]")

    def one(x: Column) -> Column:
        title = F.coalesce(F.try_element_at(titles, get(x, 1).try_cast("int") + 1), F.lit(""))
        return F.struct(
            get(x, 0).alias("id"), title.alias("title"), F.when(get(x, 2) == "e", "exam").otherwise("history").alias("kind"), get(x, 3).alias("text"),
            F.coalesce(F.from_json(get(x, 4), "array<string>"), F.array().cast("array<string>")).alias("choices"),
            F.when(get(x, 5) == "m", "many").otherwise("one").alias("select"), F.coalesce(get(x, 6), F.lit("")).alias("system"),
        )

    return F.transform(F.from_json(items, "array<string>"), one)


def encode_return(checklist: Column, answers: Column, created: Column) -> Column:
    q = lambda x: F.regexp_extract(F.to_json(F.array(F.coalesce(x, F.lit("")))), r"(?s)^\[(.*)\]$", 1)
    return T.url_code(F.concat(F.lit('{"s":"pr1","c":'), q(checklist), F.lit(',"a":'), compact_answers(answers), F.lit(',"d":'), q(created), F.lit("}")))


def encode_checklist(label: Column, snapshot: Column, items: Column, titles: Column, created: Column) -> Column:
    q = lambda x: F.regexp_extract(F.to_json(F.array(F.coalesce(x, F.lit("")))), r"(?s)^\[(.*)\]$", 1)
    c = F.concat(F.lit('{"i":'), q(snapshot), F.lit(',"t":'), F.to_json(titles), F.lit(',"x":'), compact_items(items, titles), F.lit("}"))
    return T.url_code(F.concat(F.lit('{"s":"pc1","p":'), q(label), F.lit(',"c":'), c, F.lit(',"d":'), q(created), F.lit("}")))


def _json(code: Column, lead: str) -> Column:
    """The JSON of a code, or null where it is none."""
    return using(F.regexp_replace(F.trim(code), f"^#?{lead}=", ""), lambda bare: F.when(bare.rlike("^[A-Za-z0-9_-]+$") & (F.length(bare) % 4 != 1), T.url_decode(bare)))


def decode_return(code: Column) -> Column:
    """(checklist, answers, created, error) of a returned code, which is decoded once."""

    def read(j: Column, form: Column) -> Column:
        pick = lambda a, b: F.when(form == "short", _text(j, a)).when(form == "long", _text(j, b))
        return F.struct(
            pick("$.c", "$.checklistId").alias("checklist"), F.when(form.isNotNull(), expand_answers(pick("$.a", "$.answers"))).alias("answers"), pick("$.d", "$.createdAt").alias("created"),
            F.when(form.isNull(), "not a returned checklist").alias("error"),
        )

    form = lambda j: F.when(F.get_json_object(j, "$.s") == "pr1", "short").when(F.get_json_object(j, "$.schema") == RETURN, "long")
    return using(_json(code, "return"), lambda j: using(form(j), lambda f: read(j, f)))


def unwrapped(given: Column, kind: str) -> Column:
    """The code in a transfer file's JSON: of the declared kind, or of earlier files that had a bundle only; null for anything else."""

    def code(j: Column, schema: Column) -> Column:
        old = F.when(schema.isNull(), F.get_json_object(j, "$.bundle"))
        new = F.when((schema == TRANSFER) & (F.get_json_object(j, "$.type") == kind), F.get_json_object(j, "$.payload"))
        return F.coalesce(new, old)

    return using(F.trim(given), lambda j: using(F.get_json_object(j, "$.schema"), lambda schema: code(j, schema)))


def decode_return_input(given: Column) -> Column:
    """:func:`decode_return` of what a person pasted: a code, or the whole transfer file."""
    return decode_return(F.when(F.trim(given).startswith("{"), unwrapped(given, "return")).otherwise(given))


def decode_checklist(code: Column) -> Column:
    """(label, snapshot, items, created, error) of a checklist's code, which is decoded once, not for each item."""

    def read(j: Column, titles: Column, good: Column) -> Column:
        label = F.coalesce(F.nullif(F.get_json_object(j, "$.p"), F.lit("")), F.lit("Patient"))
        return F.struct(
            F.when(good, label).alias("label"), F.when(good, _text(j, "$.c.i")).alias("snapshot"), F.when(good, expand_items(F.get_json_object(j, "$.c.x"), titles)).alias("items"),
            F.when(good, _text(j, "$.d")).alias("created"), F.when(~good, "not a checklist").alias("error"),
        )

    good = lambda j: F.coalesce(F.get_json_object(j, "$.s") == "pc1", F.lit(False))
    titles = lambda j: F.from_json(F.get_json_object(j, "$.c.t"), "array<string>")
    return using(_json(code, "phone"), lambda j: using(titles(j), lambda t: using(good(j), lambda g: read(j, t, g))))
