"""Pieces of Spark SQL text, for expressions so large that building them call by call takes seconds.

Text composes by name: a lambda's variable, a column and a bound value are all just names.
"""

from __future__ import annotations

from collections.abc import Callable

#: Steps of a fold after which what it gathered is set aside, so that long arrays are not copied again and again: Spark copies the whole state of an
#: aggregate at each step. Stretches are gathered by as many again.
STRETCH = 16


def literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """``body``, in which ``name`` stands for a value that is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def empty(kind: str) -> str:
    return f"cast(array() as array<{kind}>)"


def fold(items: str, state: str, kind: str, step: Callable[[str, str], tuple[str, str]], name: str) -> str:
    """The rows of type ``kind`` that a fold emits: ``step(state, item)`` gives the next state and an array of rows.

    Stretches of the items are folded one after another, and stretches of stretches, so that the time is about linear in them.
    ``name`` keeps the variables of nested folds apart.
    """
    i, acc, far, c, at, b, x = (f"{name}_{v}" for v in ("i", "acc", "far", "c", "at", "b", "x"))
    following, out = step(f"{b}.s", x)
    lists, wide = f"array<array<{kind}>>", STRETCH * STRETCH
    one = struct(s=following, out=f"concat({b}.out, {out})")
    near = f"aggregate(slice({i}, {at}, {STRETCH}), {struct(s=f'{c}.s', out=empty(kind))}, ({b}, {x}) -> {one}, {b} -> {struct(s=f'{b}.s', all=f'concat({c}.all, array({b}.out))')})"
    some = f"aggregate(sequence({far}, least({far} + {wide - 1}, size({i})), {STRETCH}), {struct(s=f'{acc}.s', all=f'cast(array() as {lists})')}, ({c}, {at}) -> {near}, {c} -> {struct(s=f'{c}.s', all=f'concat({acc}.all, array(flatten({c}.all)))')})"
    steps = f"if(size({i}) > 0, sequence(1, size({i}), {wide}), {empty('int')})"
    start = struct(s=state, all=f"cast(array() as {lists})")
    return let(i, items, f"flatten(aggregate({steps}, {start}, ({acc}, {far}) -> {some}, {acc} -> {acc}.all))")


def plain(text: str) -> str:
    """The bytes of a text of ASCII signs only, which :func:`cut` gets at without walking the text; null of any other."""
    return f"if(octet_length({text}) = length({text}), cast({text} as binary), null)"


def cut(text: str, start: str, count: str, bare: str | None = None) -> str:
    """``count`` signs of the text from ``start`` on, counted from 0. ``bare`` names its :func:`plain` bytes."""
    at, n = f"cast({start} + 1 as int)", f"cast({count} as int)"
    walked = f"substr({text}, {at}, {n})"
    return f"if({bare} is null, {walked}, cast(substr({bare}, {at}, {n}) as string))" if bare else walked
