"""Personal data by anchor expansion.

An Aho-Corasick pass finds anchors: at-signs, plus signs, digits, URL schemes and
identifier cues. At each anchor a deterministic parser expands left and right, settles
the span's boundaries and validates it. No expression runs over the whole text.

Kinds: email, ip, card and phone follow their grammars, leftmost and without overlap
within a kind; a match that fails its check is dropped and the scan goes on behind it.
The method adds login (a URL that names a user) and account (an identifier behind a cue,
such as a token or an IBAN whose check digits hold).

Defined results: a null text is empty and has no spans; positions count code points;
repeated rows get equal results; an empty table gives an empty result. A very long text is
read whole in its task, in time that grows with its length. Other columns stay, but for input
columns named as a result column, which give way to it.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from depscope.llm.arrow import add_columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "account")

#: Identifier cues, lower case: what follows after ``=`` or ``:`` is an account's name or secret.
CUES = ("token", "api_key", "apikey", "password", "passwd", "secret", "account", "iban", "ssn", "user_id")

DIGITS = frozenset("0123456789")
ALNUM = DIGITS | frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
IDENTIFIER = ALNUM | frozenset("_-")
USERINFO = ALNUM | frozenset("._~%!$&'()*+,;=:-")
#: Changes no length, so positions stay; only ASCII letters are folded.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in DIGITS:
        found.add_word(digit, "digit")
    for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme"), *((c, "cue") for c in CUES)):
        found.add_word(word, kind)
    found.make_automaton()
    return found


def run_end(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def parse_email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at``; it starts at ``floor`` or later."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = run_end(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (more := run_end(text, end + 1, LABEL)) > end + 1:
        end, dots = more, dots + 1
    return (start, end) if dots else None


def parse_ip(text: str, start: int) -> tuple[int, bool] | None:
    """End and validity of four dotted numbers from ``start``."""
    end, at, valid = start, start, True
    for k in range(4):
        if k:
            if end >= len(text) or text[end] != ".":
                return None
            at = end + 1
        end = run_end(text, at, DIGITS)
        if end == at:
            return None
        part = text[at:end].lstrip("0")
        valid &= len(part) < 4 and int(part or 0) <= 255
    return end, valid


def parse_card(text: str, start: int) -> tuple[int, bool] | None:
    """End and validity of a run of digits with single blanks or hyphens between."""
    digits, end, n = [text[start]], start + 1, len(text)
    while end < n:
        if text[end] in DIGITS:
            digits.append(text[end])
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    if len(digits) < 2:
        return None
    return end, 12 <= len(digits) <= 19 and luhn(digits)


def luhn(digits: list[str]) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def parse_phone(text: str, start: int) -> tuple[int, bool] | None:
    """End and validity of a number that the plus sign at ``start`` begins."""
    if start + 1 >= len(text) or text[start + 1] not in DIGITS:
        return None
    end = run_end(text, start + 2, PHONE)
    while end > start + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end < start + 4:
        return None
    return end, 9 <= sum(c in DIGITS for c in text[start:end]) <= 15


def parse_login(text: str, at: int) -> tuple[int, int] | None:
    """A URL with a user name before its host; ``at`` is where ``://`` starts."""
    start = at
    while start and text[start - 1] in ALNUM:
        start -= 1
    user = run_end(text, at + 3, USERINFO)
    if start == at or user == at + 3 or user >= len(text) or text[user] != "@":
        return None
    end = run_end(text, user + 1, LABEL | {"."})
    return (start, end) if end > user + 1 else None


def iban_holds(value: str) -> bool:
    moved = value[4:] + value[:4]
    return all(c in ALNUM for c in moved) and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def parse_account(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The identifier behind the cue ``text[start:end]``, with an equals sign or colon between."""
    if start and text[start - 1] in IDENTIFIER:
        return None
    at = run_end(text, end, frozenset(" "))
    if at >= len(text) or text[at] not in "=:":
        return None
    at = run_end(text, at + 1, frozenset(" \"'"))
    stop = run_end(text, at, IDENTIFIER)
    value = text[at:stop]
    if text[start:end].lower() == "iban":
        return (at, stop) if 15 <= len(value) <= 34 and iban_holds(value) else None
    return (at, stop) if len(value) >= 6 and any(c in DIGITS for c in value) else None


def find(text: str) -> list[tuple[int, int, str]]:
    """All spans as (start, kind's place, end, kind), in order of start, then kind."""
    free = dict.fromkeys(KINDS, 0)
    found = []

    def keep(kind: str, start: int, end: int, valid: bool = True) -> None:
        free[kind] = end
        if valid:
            found.append((start, KINDS.index(kind), end, kind))

    run = -1
    for last, what in anchors().iter(text.translate(LOWER)):
        if what == "digit":
            first = last != run + 1  # a run of digits is tried for an address at its start only
            run = last
            if last >= free["card"] and (hit := parse_card(text, last)):
                keep("card", last, *hit)
            if last >= free["ip"] and (first or last == free["ip"]) and (hit := parse_ip(text, last)):
                keep("ip", last, *hit)
        elif what == "at":
            if last >= free["email"] and (hit := parse_email(text, last, free["email"])):
                keep("email", *hit)
        elif what == "plus":
            if last >= free["phone"] and (hit := parse_phone(text, last)):
                keep("phone", last, *hit)
        elif what == "scheme":
            if last - 2 >= free["login"] and (hit := parse_login(text, last - 2)):
                keep("login", *hit)
        else:
            start = max((last + 1 - len(c) for c in CUES if text[last + 1 - len(c) : last + 1].lower() == c), default=-1)
            if start >= free["account"] and (hit := parse_account(text, start, last + 1)):
                keep("account", *hit)
    return sorted(found)


def describe(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


FIELDS = [
    *((f"n_{k}", T.LongType()) for k in BASE),
    ("base_sha256", T.StringType()),
    ("spans", T.StringType()),
    ("redacted", T.StringType()),
]


def redact(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """``text`` with each span's kind in its place; of overlapping spans, one mark for the union."""
    out, at = [], 0
    for start, _, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, text: str = "text", redacted: bool = True) -> DataFrame:
    """``docs`` with counts by kind, base_sha256, spans and, if asked for, the redacted text."""

    def compute(values: list[str | None]) -> list[list]:
        out = []
        for value in values:
            spans = find(value or "")
            base = [s for s in spans if s[1] < len(BASE)]
            counts = [sum(s[1] == k for s in base) for k in range(len(BASE))]
            row = [*counts, hashlib.sha256(describe(base).encode()).hexdigest(), describe(spans)]
            out.append([*row, redact(value or "", spans)] if redacted else row)
        width = len(FIELDS) - (not redacted)
        return list(map(list, zip(*out, strict=True))) if out else [[]] * width

    return add_columns(docs, text, FIELDS if redacted else FIELDS[:-1], compute)
