"""Plain forms of the operators, for small inputs."""

import re
from collections import Counter

import numpy as np
import regex
import xxhash

from veilspan.llm import decontaminate as D
from veilspan.llm.common import GIVEN_NAMES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def base_scores(docs, train):
    """{row number: (tokens, known, score)} and N; ``docs`` as (id, text)."""
    lowered = [[*WORDS.findall((t or "").translate({c: c + 32 for c in range(65, 91)})), None] for _, t in docs]
    counts = Counter(w for (d, _), ws in zip(docs, lowered) if train(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [
        (len(ws), sum(counts[w] > 0 for w in ws), sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for ws in lowered
    ], n


def fingerprint(text):
    ws = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints, radius=2):
    """For each fingerprint of a list, the smallest list index that it reaches."""
    found = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= radius and found[j] < found[i]:
                    found[i], changed = found[j], True
    return found


def word_repeats(texts, length=35):
    """(words, kept words) of each text."""
    ws = [WORDS.findall(t or "") for t in texts]
    counts = Counter(tuple(w[i : i + length]) for w in ws for i in range(len(w) - length + 1))
    out = []
    for w in ws:
        gone = set()
        for i in range(len(w) - length + 1):
            if counts[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((len(w), [x for i, x in enumerate(w) if i not in gone]))
    return out


def byte_repeats(texts, length=100):
    """(kept bytes, spans) of each text; texts in the order of their ids."""
    seen, out = set(), []
    for t in texts:
        raw, gone = (t or "").encode(), set()
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone.update(range(i, i + length))
            seen.add(s)
        out.append((bytes(b for i, b in enumerate(raw) if i not in gone), sum(i - 1 not in gone for i in gone)))
    return out


# ---- templates --------------------------------------------------------------------------------


# written apart from the operator's own patterns; only the word lists are its parameters
NAME = r"(?:(?<=[\p{Ll}0-9,;] )\p{Lu}\p{Ll}+)|(?<![\w])(?:" + "|".join(GIVEN_NAMES) + r")(?![\w])"
NUMBER = r"(?:(?<=^|[\s(\[\"'])[$€£+-]+|(?<=^|[\s(\[\"']))[0-9](?:[0-9.,:/]*[0-9])?"
UNIT = r"(?:(?<=<num>)|(?<=<num> ))(?:" + "|".join(sorted(D.UNITS, key=len, reverse=True)) + r"|%)(?![\p{L}0-9])"


def _pattern(p):
    return regex.compile(p)


def template(text):
    named = _pattern(NAME).sub("<name>", text).lower()
    unit = regex.compile(UNIT)
    counted = unit.sub("<unit>", regex.compile(NUMBER).sub("<num>", named))
    return regex.compile(r"(?<=[\p{L}\p{N}>])[.,;:!?\"')]+(?=\s|$)").sub("", counted)


def windows(text, width):
    text = (text or "").strip(" ")
    t, r = regex.split("[ \t-\r]+", template(text)), regex.split("[ \t-\r]+", text)
    if len(t) < width:
        t, r = t + [None] * (width - len(t)), r + [None] * (width - len(r))
    return [(tuple(t[i : i + width]), tuple(r[i : i + width])) for i in range(len(t) - width + 1)]


def leaks(docs, items, width=5, coverage=0.8):
    """{(doc id, item id): (windows, matched)} for ``docs`` and ``items`` as (id, text)."""
    slot = lambda x: any(p in x for p in ("<num>", "<name>", "<unit>"))
    bare = lambda x: regex.sub(r"^[\"'(\[]+|[.,;:!?\"')\]]+$", "", x.lower())
    out = {}
    asked = []
    for item, text in items:
        if text is not None:
            ws = [(i, t, r) for i, (t, r) in enumerate(windows(text, width)) if any(x and not slot(x) for x in t)]
            asked.append((item, len({t for _, t, _ in ws}), ws))
    for doc, text in docs:
        if text is None:
            continue
        at = {}
        for i, (t, r) in enumerate(windows(text, width)):
            at.setdefault(t, []).append((i, r))
        for item, n, ws in asked:
            by_shift = {}
            for i, t, r in ws:
                forms = [t]
                if i == 0 and not slot(t[0]) and regex.match(r"\p{Lu}\p{Ll}+[.,;:!?\"')]*$", r[0]):
                    forms.append(("<name>", *t[1:]))
                for form in forms:
                    for j, here in at.get(form, []):
                        pairs = [(k, bare(a), bare(b)) for k, a, b in zip(form, r, here) if k and slot(k)]
                        by_shift.setdefault(j - i, []).append((t, pairs))
            good = set()
            for found in by_shift.values():
                said, heard = {}, {}
                for _, pairs in found:
                    for k, a, b in pairs:
                        said.setdefault((k, a), set()).add(b)
                        heard.setdefault((k, b), set()).add(a)
                good |= {t for t, pairs in found if all(len(said[k, a]) == 1 and len(heard[k, b]) == 1 for k, a, b in pairs)}
            if n and len(good) >= coverage * n:
                out[doc, item] = (n, len(good))
    return out
