"""URL filter: host and path rules first, then a weighted vocabulary.

One Aho-Corasick pass over a lower-cased URL finds vocabulary terms; a term counts
where it stands alone, that is with no letter or digit directly before or after it.
One strict term rejects; soft terms reject when enough different ones occur.

Defined results: a null URL, and one without ``://``, has an empty host and path, fits
no rule, and is judged by its terms alone (a null has none, so it is allowed); repeated
rows get equal results; an empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from depscope.llm.arrow import add_columns

#: Fixed values: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: The vocabulary that holds if no other is passed in: (term, weight). One strict term rejects, several different
#: soft ones do. General words of unwanted pages, from no particular table.
VOCABULARY = (
    *((term, "strict") for term in ("casino", "porn", "xxx", "malware", "phishing", "warez", "spam", "viagra", "cialis", "escort")),
    *((term, "soft") for term in (
        "ads", "adult", "affiliate", "bet", "bets", "betting", "bonus", "cheap", "click", "clickbait", "coupon", "crack", "dating",
        "deal", "deals", "discount", "download", "free", "gambling", "jackpot", "keygen", "loan", "loans", "lottery", "pills", "poker",
        "popup", "pharmacy", "replica", "track", "tracker", "win", "winner",
    )),
)

FIELDS = [("host", T.StringType()), ("path", T.StringType()), ("rule", T.StringType()), ("verdict", T.StringType())]

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALONE = set("abcdefghijklmnopqrstuvwxyz0123456789")


@lru_cache(maxsize=4)
def automaton(vocabulary: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    """Terms by weight, letters A-Z folded; a term with both weights is strict, an empty one is left out."""
    found = ahocorasick.Automaton()
    for term, weight in sorted(vocabulary, key=lambda row: row[1] == "strict"):
        folded = term.translate(LOWER)
        if folded:
            found.add_word(folded, (weight, folded))
    found.make_automaton()
    return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as the rules see them."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(LOWER), tail[:stop]


def longest_rule(host: str, path: str, rules: dict[str, list[tuple[str, str, str]]]) -> tuple[str | None, str | None]:
    """The longest rule that fits, with its verdict. ``rules``: by host, (path, rule, verdict)."""
    best = (None, None)
    parts = host.split(".") if host else []
    for k in range(len(parts)):
        for start, rule, verdict in rules.get(".".join(parts[k:]), ()):
            if path.startswith(start) and len(rule) > len(best[0] or ""):
                best = (rule, verdict)
    return best


def term_counts(url: str, terms: ahocorasick.Automaton) -> tuple[set[str], set[str]]:
    """The strict and soft terms that stand alone in a lower-cased URL."""
    strict, soft = set(), set()
    if not len(terms):
        return strict, soft
    for end, (weight, term) in terms.iter(url):
        before, after = end - len(term), end + 1
        if (before < 0 or url[before] not in ALONE) and (after == len(url) or url[after] not in ALONE):
            (strict if weight == "strict" else soft).add(term)
    return strict, soft


def judge(
    pages: DataFrame,
    url: str = "url",
    rules: tuple[tuple[str, str], ...] = RULES,
    vocabulary: tuple[tuple[str, str], ...] | DataFrame = VOCABULARY,
    soft_limit: int = 2,
) -> DataFrame:
    """``pages`` with host, path, rule, verdict, and the counts n_strict and n_soft.

    ``vocabulary``: rows of term and weight, strict or soft, or such a table; it is held by every task, so it is meant
    to be a list of words. ValueError for any other weight.
    """
    if isinstance(vocabulary, DataFrame):
        vocabulary = tuple((r["term"], r["weight"]) for r in vocabulary.where("term IS NOT NULL").select("term", "weight").collect())
    known = tuple(vocabulary)
    if any(weight not in ("strict", "soft") for _, weight in known):
        raise ValueError("a term's weight is strict or soft")

    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        host, _, path = rule.partition("/")
        by_host.setdefault(host, []).append((f"/{path}", rule, verdict))

    def compute(urls: list[str | None]) -> list[list]:
        terms, out = automaton(known), []
        for value in urls:
            host, path = split_url(value)
            rule, verdict = longest_rule(host, path, by_host)
            hard, mild = term_counts((value or "").translate(LOWER), terms)
            rejected = bool(hard) or len(mild) >= soft_limit
            out.append((host, path, rule, verdict or ("block" if rejected else "allow"), len(hard), len(mild)))
        return list(map(list, zip(*out, strict=True))) if out else [[]] * 6

    return add_columns(pages, url, [*FIELDS, ("n_strict", T.LongType()), ("n_soft", T.LongType())], compute)
