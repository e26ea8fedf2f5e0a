"""Sections of text that grow: only what is new is made safe, the rest is kept, as a keyed state of a stream.

The state of a section is its last text and that text made safe. A version that begins with the last
text adds its rest, of which white space at either end is taken over as it is; a version that is equal
changes nothing; any other is made safe as a whole. Versions of a section count in their order, and one
that is not newer than the last changes nothing. A null text counts as empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.rules import PRIORITY, Rule

_STATE = "version long, text string, safe string"


def redactor(rules: Sequence[Rule]) -> Callable[[str], str]:
    """Rules for one text in a task: spans that overlap become one, with the label of the highest priority."""
    compiled = [(re.compile(r.pattern), r) for r in rules]
    rank = {label: i for i, label in enumerate(PRIORITY)}

    def run(text: str) -> str:
        found = sorted((*m.span(2 if r.field else 0), r.label) for p, r in compiled for m in p.finditer(text))
        out, at, open_ = [], 0, None
        for start, end, label in [*found, (len(text) + 1, len(text) + 1, "")]:
            if open_ and start < open_[1]:
                open_ = (open_[0], max(end, open_[1]), min(open_[2], label, key=lambda x: rank.get(x, 99)))
                continue
            if open_:
                out += [text[at : open_[0]], f"[{open_[2]}]"]
                at = open_[1]
            open_ = (start, end, label)
        return "".join(out) + text[at:]

    return run


def step(last: tuple[int, str, str] | None, version: int, text: str, safe: Callable[[str], str]) -> tuple[str, str]:
    """(mode, safe text) of a version after the last one: unchanged, append or full."""
    if last and text == last[1]:
        return "unchanged", last[2]
    if last and last[1] and text.startswith(last[1]):
        new = text[len(last[1]) :]
        inner = new.strip()
        lead = new[: len(new) - len(new.lstrip())] if inner else new
        return "append", last[2] + lead + safe(inner) + (new[len(lead) + len(inner) :] if inner else "")
    return "full", safe(text)


def incremental(versions: DataFrame, key: str, version: str, text: str, rules: Sequence[Rule]) -> DataFrame:
    """``(key, version, mode, text)`` of a stream of versions, with the text made safe."""
    kind = versions.schema[key].dataType.simpleString()

    def run(keys, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        safe = redactor(rules)
        last = state.get if state.exists else None
        rows = []
        for v, t in sorted((int(v), t or "") for b in batches for v, t in zip(b[version], b[text], strict=True)):
            if last and v <= last[0]:
                continue
            mode, done = step(last, v, t, safe)
            last = (v, t, done)
            rows.append((keys[0], v, mode, done))
        if last:
            state.update(last)
        yield pd.DataFrame(rows, columns=[key, version, "mode", text])

    return versions.select(key, version, text).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {version} long, mode string, {text} string", _STATE, "append", "NoTimeout")
