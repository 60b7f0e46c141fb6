"""Periodic runs of words: passages that say the same few words four times over or more.

A run is a stretch of consecutive words with smallest period q, ``least`` words and four periods long at least,
that no neighbouring word extends. For each period p the places 0, 3p, 6p, ... of a text form a grid; their number over all periods
is harmonic, n log n. In a run with period p more than 3p places in a row hold the word that
stands p further on, so the grid meets one of them. From every grid place that holds the same word as the place p further
on, all of a piece's texts and many periods at a time, the longest common extension of both places is found to either side by
binary search over prefix hashes in NumPy. Runs found from several places and with multiples of their period are one
(start, end), which keeps its least period. Words are numbered exactly, and each run's are compared; should prefix hashes
have lied, the text is solved by comparing words alone.

Within a run, all words after the first period go from the collapsed text.

A null text is an empty one and stays null; a text of fewer than ``least`` words has no runs; equal texts
have equal results; an empty table gives an empty result. A very long text is one task's work, in blocks of ``BLOCK`` grid
places at a time. Input columns called like a result column give way.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame

from depscope.llm.arrow import add_columns

#: A run holds its period so many times.
TIMES = 4
#: Grid places in work at once.
BLOCK = 1 << 20
#: Odd, so that its powers have inverses.
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(ids: np.ndarray) -> np.ndarray:
    """64 well-mixed bits for each number."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Prefixes:
    """Hashes of any stretches of ``ids``; equal stretches have equal hashes wherever they stand."""

    def __init__(self, ids: np.ndarray) -> None:
        self.powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(ids), BASE))), dtype=np.uint64)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed(ids) * self.powers[:-1], dtype=np.uint64)))

    def same(self, at: np.ndarray, apart: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretch at ``at`` and the one ``apart`` places on agree over ``length`` words."""
        one = (self.sums[at + length] - self.sums[at]) * self.powers[apart]
        return one == self.sums[at + apart + length] - self.sums[at + apart]


def furthest(hi: np.ndarray, agree) -> np.ndarray:
    """The greatest length up to ``hi`` over which each pair agrees, for all pairs by one binary search."""
    lo, hi = np.zeros_like(hi), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi + 1) >> 1
        ok = agree(mid)
        lo = np.where(open_ & ok, mid, lo)
        hi = np.where(open_ & ~ok, mid - 1, hi)
    return lo


def once(runs: np.ndarray) -> np.ndarray:
    """``runs`` (start, end, period) sorted, each stretch with its least period alone."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def grid(begins: np.ndarray, sizes: np.ndarray):
    """(place, period, begin, end) of all grid places of texts that begin at ``begins``, in blocks."""
    periods = sizes // TIMES
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    count = -(-(sizes[text] - period) // (3 * period))
    block = np.cumsum(count) // BLOCK
    for rows in np.split(np.arange(len(text)), np.flatnonzero(np.diff(block)) + 1):
        n = count[rows]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p, t = np.repeat(period[rows], n), np.repeat(text[rows], n)
        yield begins[t] + 3 * p * nth, p, begins[t], begins[t] + sizes[t]


def plain_runs(ids: np.ndarray, least: int) -> np.ndarray:
    """The runs of one text by comparing its words for every period."""
    found = [np.empty((0, 3), np.int64)]
    for p in range(1, len(ids) // TIMES + 1):
        same = np.concatenate(([False], ids[:-p] == ids[p:], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        start, end = edges[::2], edges[1::2] + p
        long = end - start >= max(least, TIMES * p)
        found.append(np.stack([start[long], end[long], np.full(long.sum(), p)], axis=1))
    return once(np.concatenate(found))


def all_runs(ids: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """(start, end, period) of all runs of the texts whose words ``ids`` lists one after the other; sorted."""
    begins = np.cumsum(sizes) - sizes
    hashes, found = Prefixes(ids), [np.empty((0, 3), np.int64)]
    for at, p, begin, end in grid(begins, sizes):
        met = ids[at] == ids[at + p]
        at, p, begin, end = at[met], p[met], begin[met], end[met]
        ahead = furthest(end - p - at, lambda n: hashes.same(at, p, n))  # noqa: B023  used at once
        behind = furthest(at - begin, lambda n: hashes.same(at - n, p, n))  # noqa: B023
        start, stop = at - behind, at + p + ahead
        long = stop - start >= np.maximum(least, TIMES * p)
        found.append(once(np.stack([start[long], stop[long], p[long]], axis=1)))
    runs = once(np.concatenate(found))
    wrong = {int(np.searchsorted(begins, s, side="right")) - 1 for s, e, p in runs.tolist() if not np.array_equal(ids[s : e - p], ids[s + p : e])}
    for text in wrong:
        b, e = begins[text], begins[text] + sizes[text]
        elsewhere = runs[(runs[:, 0] < b) | (runs[:, 0] >= e)]
        runs = once(np.concatenate([elsewhere, plain_runs(ids[b:e], least) + [b, b, 0]]))
    return runs


FIELDS = [
    ("n_words", "long"),
    ("n_runs", "long"),
    ("start", "long"),
    ("length", "long"),
    ("period", "long"),
    ("exponent_milli", "long"),
    ("runs", "array<struct<start: long, length: long, period: long>>"),
    ("collapsed", "string"),
]


def described(texts: list[str | None], least: int) -> list[list]:
    """The values of FIELDS for each text."""
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]  # bytes: split at ASCII blanks only
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter((number[w] for own in words for w in own), np.int64)
    sizes = np.array([len(own) for own in words], np.int64)
    runs = all_runs(ids, sizes, least)
    begins = np.cumsum(sizes) - sizes
    cuts = np.searchsorted(runs[:, 0], np.append(begins, len(ids)))
    out = []
    for k, own in enumerate(words):
        mine = (runs[cuts[k] : cuts[k + 1]] - [begins[k], begins[k], 0]).tolist()
        mine = sorted(((s, e - s, p) for s, e, p in mine), key=lambda r: (r[0], r[2]))
        best = min(mine, key=lambda r: (-r[1], r[0], r[2])) if mine else (None, None, None)
        kept = own
        if mine:
            keep = np.ones(len(own), bool)
            for s, n, p in mine:
                keep[s + p : s + n] = False
            kept = [own[i] for i in np.flatnonzero(keep).tolist()]
        text = None if texts[k] is None else b" ".join(kept).decode("utf-8", "surrogatepass")
        listed = [{"start": s, "length": n, "period": p} for s, n, p in mine]
        out.append((len(own), len(mine), *best, 1000 * best[1] // best[2] if mine else None, listed, text))
    return list(map(list, zip(*out, strict=True))) if out else [[] for _ in FIELDS]


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 6) -> DataFrame:
    """``docs`` without its text, with n_words, n_runs, the longest run (ties: the first, then the least period), all ``runs`` by
    start and period, and the ``collapsed`` text: the words left, joined by single spaces."""
    return add_columns(docs, text, FIELDS, lambda values: described(values, least), drop=True)
