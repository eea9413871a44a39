"""Personal data in filing documents, found by anchors that local parsers expand.

Records: filing documents, one row per filing with a text column (``document``). The reference project keeps
filings as nested company documents; any text column of them can be scanned.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, functions as F

from .kinds import LONG, STRING, rows, struct

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "account", "iban", "ssn", "street", "secret")
KINDS = BASE_KINDS + ADDED_KINDS

# Anchors and the parser each one starts. Letters are matched in any case.
ANCHORS = {
    "email": ["@"],
    "phone": ["+"],
    "digit": list("0123456789"),
    "url": ["http://", "https://", "ftp://", "mailto:", "www."],
    "account": ["account", "acct", "a/c", "customer no", "member id", "passport", "konto", "compte", "cuenta"],
    "iban": ["iban"],
    "ssn": ["ssn", "social security"],
    "secret": ["token", "secret", "password", "passwd", "api key", "api_key", "apikey", "access key", "access_key",
               "private key", "private_key", "credential"],
    "street": [" street", " avenue", " road", " boulevard", " lane"],
}

# The base kinds. Quantifiers never give back digits, so that a long run of digits is read once.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+(?<=[0-9])")
NOT_DIGITS = re.compile(r"[^0-9]+")

URL_TAIL = re.compile(r"[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+")
GAP = re.compile(r"[\s:#.=-]{0,4}(?:(?:no|nr|num|number|id)\b[\s:#.=-]{0,4})?", re.I)
ACCOUNT = re.compile(r"[A-Z0-9](?:[ -]?[A-Z0-9]){4,33}(?![A-Za-z0-9])")
SSN = re.compile(r"([0-9]{3})[- ]?([0-9]{2})[- ]?([0-9]{4})(?![0-9])")
ASSIGNED = re.compile(r"""s?["']?\s{0,3}(?::=|=>|=|:|\bis\b)\s{0,3}["']?""", re.I)
SECRET = re.compile(r"[A-Za-z0-9_\-+/~]{8,}(?:=|\.[A-Za-z0-9_\-+/~=]+)*")
STREET_HEAD = re.compile(r"[0-9]{1,5}[A-Za-z]?(?: [A-Z][a-z]+){1,3}\Z")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, cues in ANCHORS.items():
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def iban_ok(code: str) -> bool:
    """ISO 13616 check: moved front to back, letters as two digits, remainder 1 by 97."""
    code = code.replace(" ", "").replace("-", "")
    if not 15 <= len(code) <= 34 or not code[:2].isalpha() or not code[2:4].isdigit():
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str, ats: list[int]) -> list[tuple[int, int]]:
    """Around each at-sign: as many local characters to the left as there are, then the longest domain."""
    found, free = [], 0
    for at in ats:
        start = at
        while start > free and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
            found.append((start, free := m.end()))
        else:
            # no address may begin left of this sign any more: the run to its left ends here
            free = max(free, at + 1)
    return found


def _ip_ok(address: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in address.split("."))


def _card_ok(number: str) -> bool:
    digits = NOT_DIGITS.sub("", number)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(number: str) -> bool:
    # the shortest match has a digit, one more character and a digit
    return len(number) >= 4 and 8 <= len(NOT_DIGITS.sub("", number)) <= 15


# What an anchor starts: kind, pattern and check. A pattern reads from the anchor; whatever it reads is used up, also if
# the check fails, as a search from left to right would have it.
FROM_DIGIT = (("ip", IP, _ip_ok), ("card", CARD, _card_ok))
FROM_PLUS = (("phone", PHONE, _phone_ok),)


def _expand(kind: str, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The span that belongs to a cue, or nothing."""
    if kind == "url":
        m = URL_TAIL.match(text, end)
        stop = m.end() if m else end
        while stop > end and text[stop - 1] in ".,;:!?)]'":
            stop -= 1
        return (start, stop) if stop - end >= 3 and "." in text[start:stop] else None
    if kind == "street":
        head = STREET_HEAD.search(text, max(0, start - 64), start)
        whole = end == len(text) or not text[end].isalnum()
        return (head.start(), end) if head and whole else None
    gap = GAP.match(text, end)
    at = gap.end()
    if start and text[start - 1].isalnum():
        return None
    if kind == "ssn":
        m = SSN.match(text, at)
        ok = m and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"
        return m.span() if ok else None
    if kind == "secret":
        m = (gap := ASSIGNED.match(text, end)) and SECRET.match(text, gap.end())
        ok = m and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])
        return m.span() if ok else None
    m = ACCOUNT.match(text, at)
    if not m or at == end:
        return None
    if kind == "iban":
        return m.span() if iban_ok(m[0]) else None
    digits = sum(c.isdigit() for c in m[0])
    return m.span() if digits >= 5 and 2 * digits >= len(m[0].replace(" ", "").replace("-", "")) else None


def ascii_lower(text: str) -> str:
    """Lower case of A-Z alone, which keeps every position."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans per kind, each list in order of position; base kinds as their patterns define them."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    ats, free = [], dict.fromkeys([*ANCHORS, "ip", "card"], 0)
    for last, (kind, size) in _automaton().iter(ascii_lower(text)):
        if kind == "email":
            ats.append(last)
            continue
        start = last - size + 1
        if kind in ("digit", "phone"):
            for base, pattern, ok in FROM_DIGIT if kind == "digit" else FROM_PLUS:
                if start >= free[base] and (m := pattern.match(text, start)):
                    free[base] = m.end()
                    if ok(m[0]):
                        spans[base].append(m.span())
            continue
        if start < free[kind]:
            continue
        span = _expand(kind, text, start, last + 1)
        if span and span[0] >= free[kind]:
            spans[kind].append(span)
            free[kind] = span[1]
    spans["email"] = _emails(text, ats)
    return spans


def spans_text(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


PERSONAL_DATA = struct(n_email=LONG, n_ip=LONG, n_card=LONG, n_phone=LONG, n_added=LONG, base_sha256=STRING,
                       spans=STRING)


@F.arrow_udf(PERSONAL_DATA)
def _personal_data(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        found_rows = []
        for text in batch:
            found = find_spans(text.as_py() or "")
            base = spans_text(found, BASE_KINDS)
            found_rows.append((*(len(found[k]) for k in BASE_KINDS), sum(len(found[k]) for k in ADDED_KINDS),
                               hashlib.sha256(base.encode()).hexdigest(), spans_text(found, KINDS)))
        yield rows(PERSONAL_DATA, found_rows)


def personal_data(document: Column | str) -> Column:
    """What personal data the text of a filing document holds: a struct of counts, a digest and spans.

    An Aho-Corasick automaton reads the text once and reports at-signs, plus-signs, digits, URL schemes and identifier
    cues; a small deterministic parser grows each anchor to its boundaries and validates it (domains, number ranges, Luhn
    and IBAN check digits, social security ranges, house numbers before street words, values with letters and digits
    assigned to a token, key or password). Spans are (kind, start, end) in code points with exclusive ends. The base kinds
    follow the given patterns exactly; ``url``, ``account``, ``iban``, ``ssn``, ``street`` and ``secret`` are added and may
    overlap them.

    NULL and empty texts have no spans. Rows are independent: repeated rows give equal results, other columns are not
    looked at, and texts of any length are read whole, in time linear in their length.
    """
    return _personal_data(document)
