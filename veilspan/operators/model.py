"""A hook for span models, and the modes that combine them with rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import merge
from .text import TOO_LONG

Span = tuple[int, int, str, float]
Predictor = Callable[[list[str]], list[list[Span]]]

#: Characters of a text that a model gets at once, and how many of them it gets again with the next.
SIZE, OVERLAP = 700, 80
#: How often an input that is too long is cut in two.
DEPTH = 4


def windows(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Start and end of the parts of a text, which overlap."""
    at = 0
    while True:
        end = min(len(text), at + size)
        yield at, end
        if end == len(text):
            return
        at = end - overlap


def halves(text: str, start: int, end: int) -> tuple[int, int]:
    """Where the first half of a part ends and the second begins: at the break nearest the middle."""
    middle = (start + end) // 2
    near = [m.end() for m in re.finditer(r"\n|\. | ", text[start:end]) if 0 < m.end() < end - start]
    cut = start + min(near, key=lambda x: abs(start + x - middle)) if near else middle
    return cut, cut


def spans_of(text: str, model: Predictor, size: int = SIZE, overlap: int = OVERLAP, depth: int = DEPTH) -> list[Span]:
    """Spans of a whole text, part by part; a part that the model finds too long is tried again in halves.

    A span that ends or begins where a part cuts through a word is left to the neighbouring part.
    """
    wordy = lambda i: 0 < i < len(text) and (text[i - 1] + text[i]).isalnum()
    best: dict[tuple[int, int, str], float] = {}

    def look(start: int, end: int, left: int) -> None:
        try:
            found = model([text[start:end]])[0]
        except Exception as e:
            if not left or end - start < 2 or not re.search(TOO_LONG, str(e)):
                raise
            a, b = halves(text, start, end)
            look(start, a, left - 1)
            look(b, end, left - 1)
            return
        for s, e, label, score in found:
            a, b = start + s, start + e
            if not (s == 0 and wordy(a)) and not (b == end and wordy(b)):
                best[a, b, label] = max(score, best.get((a, b, label), 0.0))

    for start, end in windows(text, size, overlap):
        look(start, end, depth)
    return [(a, b, label, score) for (a, b, label), score in sorted(best.items())]


def first_that_loads(candidates: Sequence[Callable[[], Predictor]]) -> Predictor:
    """The first of several models that loads; the last one's error if none does."""
    for i, load in enumerate(candidates):
        try:
            return load()
        except Exception:
            if i == len(candidates) - 1:
                raise
    raise ValueError("no model given")


def predict(docs: DataFrame, load: Callable[[], Predictor] | Sequence[Callable[[], Predictor]], key: str = "doc_id", text: str = "text", least: float = 0.35, size: int = SIZE) -> DataFrame:
    """Spans of an injected model: ``(key, start, end, label, score)``. A model is loaded once in each task, the first of several that loads."""
    candidates = [load] if callable(load) else list(load)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = first_that_loads(candidates)
        for b in batches:
            rows = [(k, *s) for k, t in zip(b[key], b[text].fillna(""), strict=True) for s in spans_of(t, model, size)]
            yield pd.DataFrame(rows, columns=[key, "start", "end", "label", "score"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(key, text).mapInPandas(run, f"{key} {kind}, start long, end long, label string, score double")
    return found.where(F.col("score") >= least)


def combine(structured: DataFrame, model: DataFrame | None, mode: str = "hybrid", allow_fallback: bool = False, key: str = "doc_id") -> DataFrame:
    """Spans of a mode: structured, model, or hybrid, in which both are merged. Without a model the latter two fail unless fallback is allowed."""
    own = structured.select(key, "start", "end", "label")
    if mode == "structured":
        return own
    if model is None:
        if not allow_fallback:
            raise ValueError(f"mode {mode} needs a model")
        return own
    theirs = model.select(key, "start", "end", "label")
    if mode == "model":
        return theirs
    both = own.withColumn("source", F.lit("structured")).unionByName(theirs.withColumn("source", F.lit("model")))
    return merge(both, key=key).select(key, "start", "end", "label")
