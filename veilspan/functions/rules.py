"""The rule table of span detectors: label, pattern, and whether a field name leads the value.

Patterns are valid for Java and for RE2: no look-around, no back-references. A field rule has two
groups, the field with its separator and the value, and may have a third, what has to follow; a direct
rule has none and spans its match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_SEP = r"[ \t]*[*_]{0,2}[ \t]*[:=#][ \t]*[*_]{0,2}[ \t]*"
_NAME = r"[A-Z][A-Za-z'-]+(?:,? [A-Z][A-Za-z'.-]*){0,3}"
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}(?:/[0-9]{2,4})?"
_PHONE = r"(?:\+?1[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}"
_CODE = r"[A-Za-z0-9][A-Za-z0-9-]{3,}"
_REST = r"[^\n|;]+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Four digits in a row.
_FOUR = "[0-9]{4}"
_LOOSE = r"[ \t]*[:=#]?[ \t]*"


_SIGN = re.compile(r"(?:\[(?:[A-Z]-[A-Z]|[a-z]-[a-z]|[0-9]-[0-9]|[A-Za-z0-9])+\]|[A-Za-z0-9])(?P<often>[?*]|\{0)?\??")


def _group(pattern: str) -> tuple[list[str], str]:
    """The alternatives of the group that the pattern opens with, and what follows the group."""
    depth, at, inside, cuts = 0, 0, False, []
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "|" and depth == 1:
            cuts.append(at)
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                break
        at += 1
    cuts = [0, *cuts, at]
    return [pattern[x + 1 : y] for x, y in zip(cuts, cuts[1:])], pattern[at + 1 :]


def _starts_word(pattern: str) -> bool:
    """Whether all that the pattern matches begins with an ASCII letter or digit, as far as its first signs tell."""
    if pattern.startswith("("):
        first, *others = _group(pattern)[0]
        rest = _group(pattern)[1]
        first = re.sub(r"^\?[a-z]*:", "", first)
        return not first.startswith("?") and not re.match(r"[?*]|\{0", rest) and all(map(_starts_word, [first, *others]))
    sign = _SIGN.match(pattern)
    if sign and sign["often"]:
        return sign["often"] == "?" and _starts_word(pattern[sign.end() :])
    return sign is not None


def ascii_bounds(pattern: str) -> str:
    """The pattern with word boundaries that know ASCII words only, as in RE2; Java's count letters of all scripts as parts of words.

    Where a word's sign must follow, it is enough that none stands before, which is much the faster test.
    """
    short, either = r"(?<!\w)", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
    return re.sub(r"(?<!\\)\\b", lambda m: short if _starts_word(pattern[m.end() :].lstrip(")")) else either, pattern)


#: Escapes that say where a match stands, or one sign of the class; other letters behind a backslash are not looked into.
_CLASSES = {"d": set("0123456789"), "w": set("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_"), "t": {"\t"}}
_QUANTIFIER = re.compile(r"(?:([?*])|\+|\{([0-9]+)[0-9,]*\})[?+]?")


def _class(pattern: str) -> tuple[set[str] | None, bool, str]:
    """The signs of the class that the pattern opens with, null if it names others than plain ASCII ones, whether it is negated, and what follows it."""
    negated = pattern.startswith("[^")
    at, signs, plain = 2 if negated else 1, [], True
    first = at
    while at < len(pattern) and (pattern[at] != "]" or at == first):
        c = pattern[at]
        if c == "\\":
            at += 1
            c = pattern[at]
            if c.isalnum():
                plain = plain and c in (*_CLASSES, "n", "s")
                signs.append({"\n"} if c == "n" else {"\n", " ", "\t"} if c == "s" else _CLASSES.get(c, set()))
            else:
                signs.append({c})
        elif c in "[&" or ord(c) > 126:
            plain = False
        elif c == "-" and at > first and pattern[at + 1] != "]" and signs and len(signs[-1]) == 1 and pattern[at + 1] != "\\":
            at += 1
            signs.append({chr(x) for x in range(ord(min(signs[-1])), ord(pattern[at]) + 1)})
        else:
            signs.append({c})
        at += 1
    return (set().union(*signs) if plain else None), negated, pattern[at + 1 :]


def _opens(pattern: str, fold: bool = False) -> tuple[set[str], bool] | None:
    """The signs that a match may begin with, and whether it may be empty; null where that is not known."""
    out: set[str] = set()
    while pattern:
        c, empty = pattern[0], False
        if flags := re.match(r"\(\?([a-z]+)\)", pattern):
            fold, pattern = fold or "i" in flags[1], pattern[flags.end() :]
            continue
        if c == "^" or pattern.startswith("\\b"):
            pattern = pattern[1 if c == "^" else 2 :]
            continue
        if c == "(":
            ways, rest = _group(pattern)
            lead = re.match(r"\?([a-z]*):", ways[0])
            if not lead and ways[0].startswith("?"):
                return None
            ways[0] = ways[0][lead.end() :] if lead else ways[0]
            said = [_opens(w, fold or bool(lead) and "i" in lead[1]) for w in ways]
            if None in said:
                return None
            signs, empty = set().union(*(x for x, _ in said)), any(e for _, e in said)
        elif c == "[":
            signs, negated, rest = _class(pattern)
            if signs is None or negated:
                return None
        elif c == "\\":
            if pattern[1].isalnum() and pattern[1] not in _CLASSES:
                return None
            signs, rest = _CLASSES.get(pattern[1], {pattern[1]}), pattern[2:]
        elif c in ".$|)*+?{" or ord(c) > 126:
            return None
        else:
            signs, rest = {c}, pattern[1:]
        often = _QUANTIFIER.match(rest)
        pattern = rest[often.end() :] if often else rest
        out |= {y for x in signs for y in ((x.lower(), x.upper()) if fold else (x,))}
        if not empty and not (often and (often[1] or often[2] and not int(often[2]))):
            return out, False
    return out, True


def sought(pattern: str) -> str:
    """The pattern as texts are searched for it: with :func:`ascii_bounds`, and behind a look at the next sign, which alone rules out most places."""
    ways = _group(f"({pattern})")[0]
    said = [_opens(w) for w in ways]
    if any(x is None or x[1] or "\n" in x[0] for x in said) or (len(ways) > 1 and re.search(r"\(\?[a-z]+\)", pattern)):
        return ascii_bounds(pattern)
    signs = "".join(x if x.isalnum() else "\\" + x for x in sorted(set().union(*(x for x, _ in said))))
    return f"(?=[{signs}]){ascii_bounds(pattern)}" if len(ways) == 1 else f"(?=[{signs}])(?:{'|'.join(map(ascii_bounds, ways))})"


def in_lines(pattern: str) -> bool:
    """Whether all that the pattern matches lies in one line and does not ask for other lines, as far as its signs tell."""
    rest = pattern
    while rest:
        c = rest[0]
        if c == "[":
            signs, negated, rest = _class(rest)
            if signs is None or ("\n" in signs) != negated:
                return False
            continue
        if c == "\\":
            if rest[1:2].isalnum() and rest[1] not in (*_CLASSES, "b"):
                return False
            rest = rest[2:]
            continue
        if c in "$\n" or (c == "^" and not re.match(r"\(\?i?m\)", pattern)) or re.match(r"\(\?(?!i?:|i?m?\))", rest):
            return False
        rest = rest[1:]
    return True


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    pattern: str
    field: bool = False
    severity: str = "high"
    #: What a text must hold for the rule to match at all.
    needs: str = ""
    #: Whether a field rule has a third group, which is no part of the value.
    tail: bool = False
    #: Words in lower case of which a text must hold one, in any case, for the rule to match; none says nothing.
    words: tuple[str, ...] = ()
    #: A short pattern that is found in all that the rule matches.
    shape: str = ""
    #: Whether the words stand before a colon, equals or number sign of their line.
    before: bool = False


def _words(field: str) -> tuple[str, ...]:
    """A word for each way to write a field's name: its longest part that is not optional."""
    firm = re.sub(r"\(\?:[^()]*\)\?", "\0", field)
    inside = re.match(r"\(\?:([^()]*)\)", firm)
    ways = (inside[1] if inside else re.sub(r"\(\?:[^()]*\)", "\0", firm)).split("|")
    return tuple(max(re.split(r".\?|\0", w), key=len).strip().lower() for w in ways)


def _line(name: str, label: str, field: str, value: str) -> Rule:
    return Rule(name, label, rf"(?im)(^[ \t>*_-]*(?:{field}){_SEP})({value})", True, words=_words(field), before=True)


def _inline(name: str, label: str, field: str, value: str) -> Rule:
    return Rule(name, label, rf"((?i:\b(?:{field})){_SEP})({value})", True, words=_words(field), before=True)


_ID_FIELDS = "account|acct|policy|member|device|serial|license|licence|certificate|claim"
FIELD_RULES = [
    _line("line_patient", "PATIENT NAME", "patient(?: name)?|name", _NAME),
    _line("line_preferred", "PATIENT NAME", "preferred name", _NAME),
    _line("line_alias", "PATIENT NAME", "alias|aka|also known as", r"[^\n|;]+"),
    Rule("header_caps_name", "PATIENT NAME", r"(\b)([A-Z]{2,}, [A-Z]{2,})", True, needs=", "),
    _line("line_dob", "DOB", "dob|date of birth|birth ?date", _DATE),
    Rule("ocr_dob", "DOB", rf"((?i:\bd[o0]b)[ \t]*=[ \t]*)({_DATE})", True, words=("dob", "d0b"), before=True),
    _line("line_mrn", "MRN", "mrn|medical record(?: number| no)?", _CODE),
    _line("line_encounter", "ENCOUNTER ID", "encounter(?: id| number| no)?|visit(?: id| number)|csn", _CODE),
    _line("line_id", "ID", f"(?:{_ID_FIELDS})(?: id| number| no)?", _CODE),
    _line("line_admit_time", "TIME", "admission time|admit time", r"[0-9]{1,2}:[0-9]{2}(?: ?[AaPp][Mm])?"),
    _line("line_date", "DATE", "(?:admission|admit|collection|collected|result|resulted|discharge|service)(?: date)?", _DATE),
    _line("line_phone", "PHONE", "phone|tel|telephone|mobile|cell|fax|pager", _PHONE),
    _line("line_email", "EMAIL", "e-?mail", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"),
    _line("line_address", "ADDRESS", "address|home address|mailing address", r"[^\n]+"),
    _line("line_facility", "FACILITY", "facility|hospital|clinic|site", _REST),
    _line("line_room", "ROOM", "room|unit|ward|bed", r"[A-Za-z0-9-]+"),
    _line("line_provider", "PROVIDER NAME", "attending|provider|physician|pcp|resident|consultant|surgeon|nurse", r"(?:Dr\.? )?" + _NAME),
    _inline("inline_provider", "PROVIDER NAME", "provider", r"(?:Dr\.? )" + _NAME),
    _line("line_contact", "CONTACT NAME", "emergency contact|next of kin|contact|spouse|mother|father|daughter|son|guardian", _NAME),
    _inline("inline_contact", "CONTACT NAME", "emergency contact|next of kin", _NAME),
    _line("line_insurer", "ORGANIZATION", "insurance|insurer|payer|payor", _REST),
    _line("line_employer", "ORGANIZATION", "employer", _REST),
    _line("line_occupation", "OCCUPATION", "occupation|job", _REST),
    _line("line_pharmacy", "ORGANIZATION", "(?:preferred )?pharmacy", _REST),
    Rule("inline_dob", "DOB", rf"((?i:\b(?:dob|date of birth|born(?: on)?)){_LOOSE})({_DATE})", True, words=("dob", "date of birth", "born")),
    _inline("inline_patient", "PATIENT NAME", "patient name", _NAME),
    _inline("inline_patient_caps", "PATIENT NAME", "patient", r"[A-Z]{2,}(?: [A-Z]{2,})+"),
    _inline("inline_preferred", "PATIENT NAME", "preferred name", _NAME),
    _inline("inline_mrn", "MRN", "mrn|medical record number", _CODE),
    Rule("equals_mrn", "MRN", rf"((?i:\bmrn)[ \t]*=[ \t]*)({_CODE})", True, words=("mrn",), before=True),
    _inline("inline_encounter", "ENCOUNTER ID", "encounter(?: id| number)?|csn", _CODE),
    _inline("inline_id", "ID", f"(?:{_ID_FIELDS})(?: id| number| no)", _CODE),
    _inline("inline_facility", "FACILITY", "facility", r"[A-Z][^\n|;.,]+"),
    Rule("documented_as", "PATIENT NAME", rf"((?i:\balso documented as) )({_NAME})", True, words=("also documented as",)),
    Rule("seen_by", "PROVIDER NAME", r"((?i:\bseen by) )(Dr\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?)", True, words=("seen by",)),
    _inline("inline_room", "ROOM", "room|unit", r"[A-Za-z0-9-]*[0-9][A-Za-z0-9-]*"),
    _inline("inline_insurer", "ORGANIZATION", "insurance|insurer", r"[A-Z][^\n|;.,]+"),
    _inline("inline_employer", "ORGANIZATION", "employer", r"[A-Z][^\n|;.,]+"),
    _inline("inline_occupation", "OCCUPATION", "occupation", r"[A-Za-z][^\n|;.,]+"),
]

_STREET = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl"
DIRECT_RULES = [
    Rule("email", "EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", needs="@"),
    Rule("url", "URL", r"https?://[^\s\"'<>)]+", needs="://"),
    Rule("ipv4", "IP", rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b", needs="."),
    Rule("ipv6", "IP", r"\b[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}\b", needs=":"),
    Rule("device_tag", "ID", r"\b(?:SN|DEV|UDI)-[A-Z0-9]*[0-9][A-Z0-9]*\b", words=("sn-", "dev-", "udi-")),
    Rule("iso_timestamp", "DATE", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(?::[0-9]{2})?(?:Z|[+-][0-9]{2}:?[0-9]{2})", shape=_FOUR),
    Rule("ssn", "ID", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", shape=_FOUR),
    Rule("ssn_loose", "ID", r"\b[0-9]{3}[ .][0-9]{2}[ .][0-9]{4}\b", shape=_FOUR),
    Rule("zip4", "ID", r"\b[0-9]{5}-[0-9]{4}\b", shape=_FOUR),
    Rule("npi", "ID", r"(?i:\bNPI)[ :#]*[0-9]{10}\b", words=("npi",)),
    Rule("registration", "ID", r"(?i:\b(?:registration|licen[cs]e) (?:no|number))[.: #]*[A-Z0-9-]{4,}", words=("registration", "licen")),
    Rule("card", "ID", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", shape=_FOUR),
    Rule("driver_licence", "ID", r"\b[A-Z][0-9]{3}-[0-9]{4}-[0-9]{4}\b", shape=_FOUR),
    Rule("passport", "ID", r"\b[A-Z][0-9]{8}\b", shape=_FOUR),
    Rule("us_phone", "PHONE", r"(?:\+1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|\b[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}\b", shape=_FOUR),
    Rule("quarter", "DATE", r"\bQ[1-4] [0-9]{4}\b", shape=_FOUR),
    Rule("nth_quarter", "DATE", r"(?i:\b(?:first|second|third|fourth) quarter(?: of)? )[0-9]{4}\b", words=("quarter",)),
    Rule("relative_period", "DATE", r"(?i:\b(?:last|next|this|past) (?:week|month|quarter|year|spring|summer|autumn|fall|winter))\b", words=("last ", "next ", "this ", "past ")),
    Rule("street", "ADDRESS", rf"\b[0-9]+ (?:[A-Z][a-z]+ )+(?:{_STREET})\b(?:, [A-Z][a-z]+)?(?:, [A-Z]{{2}} [0-9]{{5}})?"),
    Rule("room", "ROOM", r"(?i:\b(?:room|bed) )[0-9]+[A-Za-z]?\b", words=("room ", "bed ")),
    Rule("state_zip", "LOCATION", r"\b[A-Z]{2} [0-9]{5}\b", shape=_FOUR),
    Rule("laboratory", "ORGANIZATION", r"\b(?:[A-Z][a-z]+ )+Laborator(?:y|ies)\b", words=("laborator",)),
    Rule("university", "ORGANIZATION", r"\b(?:University|College|Institute) of (?:[A-Z][a-z]+ ?)+", words=("university of", "college of", "institute of")),
    Rule("care_facility", "ORGANIZATION", r"\b(?:[A-Z][a-z]+ )+(?:Hospital|Clinic|Medical Center|Nursing Home|Hospice)\b", words=("hospital", "clinic", "medical center", "nursing home", "hospice")),
    Rule("pavilion", "FACILITY", r"\b(?:[A-Z][a-z]+ )+Pavilion\b", words=("pavilion",)),
    Rule("cooperative", "ORGANIZATION", r"\b(?:[A-Z][a-z]+ )+Cooperative\b", words=("cooperative",)),
    Rule("titled_provider", "PROVIDER NAME", r"\bDr\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?", words=("dr",)),
    Rule("middle_initial", "NAME", r"\b[A-Z][a-z]+ [A-Z]\. [A-Z][a-z]+\b", needs=". "),
    Rule("dashed_code", "ID", r"\b[A-Z]{2,}[0-9]*-[A-Z0-9]{5,}\b", needs="-"),
    Rule("hex_code", "ID", r"\b[0-9A-F]{12,}\b"),
    Rule("vehicle_code", "ID", r"\b[A-HJ-NPR-Z0-9]{17}\b"),
]

RESIDUAL_RULES = [
    Rule("group_number", "identifier", r"(?i:\bgroup (?:no|number))[.: #]*[A-Z0-9-]{4,}", words=("group n",)),
    Rule("left_employer", "employer", r"(?i:\bemployer)[ \t]*:[ \t]*[A-Za-z]", words=("employer",)),
    Rule("left_occupation", "occupation", r"(?i:\boccupation)[ \t]*:[ \t]*[A-Za-z]", words=("occupation",)),
    Rule("left_admit_time", "admission time", r"(?i:\badmission time)[ \t]*:[ \t]*[0-9]", words=("admission time",)),
    Rule("left_email", "email", DIRECT_RULES[0].pattern, needs="@"),
    Rule("left_url", "URL", DIRECT_RULES[1].pattern, needs="://"),
    Rule("left_ip", "IP address", DIRECT_RULES[2].pattern),
    Rule("left_ssn", "SSN", DIRECT_RULES[6].pattern),
    Rule("left_phone", "phone or fax", DIRECT_RULES[14].pattern),
    Rule("left_dob", "DOB", rf"(?i:\b(?:dob|date of birth))[ \t]*:[ \t]*(?:{_DATE})", words=("dob", "date of birth")),
    Rule("left_iso_date", "exact date", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"),
    Rule("left_slash_date", "exact date", r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b"),
    Rule("left_month_date", "exact date", r"(?i:\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* )[0-9]{1,2}\b"),
    Rule("left_record", "identifier", rf"(?i:\b(?:mrn|{_ID_FIELDS}) ?(?:id|number|no)?)[ \t]*:[ \t]*[A-Za-z]*[0-9]{{4,}}"),
    Rule("left_street", "street address", DIRECT_RULES[18].pattern),
    Rule("left_zip", "ZIP or postal code", r"(?i:\b(?:zip|postal)(?: code)?)[ \t]*:[ \t]*[A-Z0-9-]{4,}", severity="medium", words=("zip", "postal")),
    Rule("left_room", "unit or room", DIRECT_RULES[19].pattern, severity="medium", words=("room ", "bed ")),
    Rule("left_unit", "unit or room", r"(?i:\b(?:unit|floor|ward))[ \t]*:[ \t]*[A-Z0-9]+", severity="medium", words=("unit", "floor", "ward")),
    Rule("left_facility", "facility", DIRECT_RULES[23].pattern, severity="medium", words=("hospital", "clinic", "medical center", "nursing home", "hospice")),
    Rule("left_name", "possible full name", DIRECT_RULES[26].pattern, severity="medium"),
    Rule("left_code", "ID-like string", r"\b[A-Z]{1,4}[0-9]{6,}\b", severity="medium"),
    Rule("left_age", "age over 89", r"(?i:\b(?:9[0-9]|1[01][0-9])[ -](?:year|yr)s?[ -]old)\b", severity="medium", words=("old",)),
    Rule("left_context", "rare identifying context", r"(?i:\b(?:mayor|celebrity|only survivor|first patient|lottery winner))\b", severity="review", words=("mayor", "celebrity", "only survivor", "first patient", "lottery winner")),
]

#: Most rules that a table may hold.
MOST = 10_000
_COLUMNS = "name string, label string, pattern string, field boolean, severity string, needs string, tail boolean, words array<string>, shape string, before boolean"


def as_table(spark, rules):
    """Rules as a table, a row each."""
    return spark.createDataFrame([(r.name, r.label, r.pattern, r.field, r.severity, r.needs, r.tail, list(r.words), r.shape, r.before) for r in rules], _COLUMNS)


def from_table(rows) -> list[Rule]:
    """Rules of a table ``(name, label, pattern)`` that may have the other columns of a rule, in the order of ``ord`` if it has that, else of their names.

    A rule without a name, label or pattern, a name that occurs twice, and more than ``MOST`` rules are errors.
    """
    have = [c for c in ("name", "label", "pattern", "field", "severity", "needs", "tail", "words", "shape", "before") if c in rows.columns]
    found = rows.select(*have, *([c for c in ("ord",) if c in rows.columns])).limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} rules")
    if any(not (r.name and r.label and r.pattern) for r in found) or len({r.name for r in found}) < len(found):
        raise ValueError("each rule needs a name of its own, a label and a pattern")
    found.sort(key=lambda r: r.ord if "ord" in rows.columns else r.name)
    return [Rule(**{c: tuple(r[c]) if c == "words" else r[c] for c in have if r[c] is not None}) for r in found]


def read_rules(spark, path: str) -> list[Rule]:
    """Rules of JSON lines."""
    return from_table(spark.read.schema(_COLUMNS + ", ord long").json(path))


#: Label priority, high to low (fixed values).
PRIORITY = [
    "DOB", "EMAIL", "PHONE", "MRN", "ENCOUNTER ID", "ID", "ADDRESS", "ROOM", "PATIENT NAME", "PROVIDER NAME", "CONTACT NAME",
    "NAME", "OCCUPATION", "FACILITY", "ORGANIZATION", "LOCATION", "TIME", "DATE", "URL", "IP",
]
