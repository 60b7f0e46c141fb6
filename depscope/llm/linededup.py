"""Line dedup by pairwise alignment.

Documents overlap where they share lines. A rare line, one that ``rare`` rows at most hold, pairs each document that has it with
every earlier one. More common lines would make too many pairs; each later document that has one names one partner, the earliest
that has it, so a line that a third of all documents hold costs a third of all documents one pair each. Lines of fewer than
``short`` words are looked up together with the lines behind them, up to ``short`` words. All this only finds pairs.

What goes is decided by the alignment of a pair's lines, as patience diff does it: lines at both heads and both tails are taken off
while they agree; of the lines that are unique on both sides, the longest run that increases on both sides is aligned; then the
lines between each two of these are treated alike. Aligned lines that follow each other on both sides are a block, and a
block of ``min_words`` words or more leaves the later document, with the blank lines that follow its lines. A
passage that stands in another order than in the partner is left out of the increasing run and stays, unless another partner
has it in order; so does a second copy of a passage in one document.

A partner's lines come in pages of ``PAGE``, only those pages that share lines and, near a page's border, its neighbour,
so that a pair costs a bounded number of bytes however long the partner is.

Later means a greater doc_id; a null doc_id is later than all others. Rows equal in doc_id
and text are one document and fare alike; of rows equal in doc_id only, the one with the
greater text hash is later. A null text stays null and has no lines; an empty table gives an
empty result; result columns replace input columns of their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from itertools import pairwise

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depscope.functions.columns import unused
from depscope.llm.arrow import add_columns
from depscope.scratch import materialise

#: Lines of a page, and how near to its border a shared line brings the neighbour along.
PAGE, NEAR = 256, 16


def content(lines: list[bytes]) -> list[int]:
    """Places of the lines that have a word."""
    return [k for k, line in enumerate(lines) if line.strip()]


def line_hashes(lines: list[bytes]) -> list[int]:
    """A signed 64-bit hash of each trimmed line."""
    hashes = [xxhash.xxh64_intdigest(line.strip()) for line in lines]
    return np.array(hashes, np.uint64).view(np.int64).tolist()


def searched(lines: list[bytes], hashes: list[int], short: int) -> list[int]:
    """What each line is looked up by: its hash, or that of a short line and those behind it."""
    out = list(hashes)
    words = [len(line.split(None, short)) for line in lines]
    for k, own in enumerate(words):
        end = k + 1
        while own < short and end < len(words):
            own += words[end]
            end += 1
        if end > k + 1:
            out[k] = xxhash.xxh64_intdigest(np.array(hashes[k:end], np.int64).tobytes()) - (1 << 63)
    return out


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of ``pairs`` (i, j), sorted by i, in which j increases too."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back[k] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """The pairs of places (in a, in b) that patience diff aligns, sorted."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ours, theirs = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {line: b0 + k for k, line in enumerate(b[b0:b1]) if theirs[line] == 1}
        run = increasing([(k, at[a[k]]) for k in range(a0, a1) if a[k] in at and ours[a[k]] == 1])
        out += run
        if run:
            work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in pairwise([(a0 - 1, b0 - 1), *run, (a1, b1)])]
    return sorted(out)


def blocks(aligned: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, end) of the runs that go on by one on both sides."""
    out: list[list[int]] = []
    last = None
    for i, j in aligned:
        if last == (i - 1, j - 1):
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
        last = (i, j)
    return [(a, b) for a, b in out]


def partners(pages: list[dict]) -> list[list]:
    """The lines of each partner; None stands between pages that don't follow each other."""
    out: list[list] = []
    last = None
    for page in sorted(pages, key=lambda p: (p["n"], p["d"] if not p["n"] else 0, p["t"], p["page"])):
        now = (page["n"], page["d"], page["t"])
        if last is None or last[0] != now:
            out.append([])
        elif last[1] + 1 != page["page"]:
            out[-1].append(None)
        out[-1] += page["lines"]
        last = (now, page["page"])
    return out


def common_lines(lines: list, words: list[int], others: list[list], min_words: int) -> set[int]:
    """Which lines go: those of the blocks aligned with one of ``others``."""
    gone: set[int] = set()
    for other in others:
        for a, b in blocks(aligned(lines, other)):
            if sum(words[a:b]) >= min_words:
                gone.update(range(a, b))
    return gone


def without(text: str, pages: list[dict], min_words: int) -> tuple[str, int, int]:
    """The text left, its count of content lines before, and how many of them went."""
    raw = text.encode("utf-8", "surrogatepass").split(b"\n")
    places = content(raw)
    if not pages:
        return text, len(places), 0
    lines = [raw[p] for p in places]
    gone = {places[k] for k in common_lines(line_hashes(lines), [len(x.split()) for x in lines], partners(pages), min_words)}
    if not gone:
        return text, len(places), 0
    left, dropping = [], False
    for k, line in enumerate(raw):
        dropping = k in gone or (dropping and not line.strip())
        if not dropping:
            left.append(line)
    return b"\n".join(left).decode("utf-8", "surrogatepass"), len(places), len(gone)


def overlaps(docs: DataFrame, text: str, doc_id: str, short: int, rare: int) -> DataFrame:
    """(d, t, m) of each document that shares lines with earlier ones; t hashes the text, m lists its partners' pages."""

    def compute(values: list[str | None]) -> list[list]:
        out = []
        for value in values:
            lines = [line for line in (value or "").encode("utf-8", "surrogatepass").split(b"\n") if line.strip()]
            hashes = line_hashes(lines)
            out.append((hashes, searched(lines, hashes, short)))
        return list(map(list, zip(*out, strict=True))) if out else [[], []]

    named = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("x"), F.xxhash64(f"`{text}`").alias("t"))
    lists = T.ArrayType(T.LongType())
    keyed = materialise(add_columns(named, "x", [("lines", lists), ("keys", lists)], compute, drop=True), "linededup-keys")
    lines = keyed.select("d", "t", F.posexplode("keys").alias("i", "h"))
    own = F.struct(F.col("d").isNull().alias("n"), "d", "t")
    first = lines.groupBy("h").agg(
        F.min(F.struct(F.col("d").isNull().alias("n"), "d", "t", "i")).alias("p"), F.max(own).alias("q"), F.count("*").alias("c")
    )
    shared = first.where(~(F.struct("p.n", "p.d", "p.t").eqNullSafe(F.col("q")))).select("h", "p", "c")
    # written, so that both sides of the join are shuffled anew and a very common line's rows can be split
    shared = materialise(shared, "linededup-shared")
    met = lines.join(shared, "h")
    common = met.where(F.col("c") > rare).where(~own.eqNullSafe(F.struct("p.n", "p.d", "p.t"))).select("d", "t", "p")
    few = met.where(F.col("c") <= rare).groupBy("h").agg(F.collect_list(F.struct(own.alias("o"), "i")).alias("g"))
    pairs = few.select(F.explode("g").alias("x"), "g").select("x", F.explode(F.expr("filter(g, y -> y.o < x.o)")).alias("y"))
    pairs = pairs.select("x.o.d", "x.o.t", F.struct("y.o.n", "y.o.d", "y.o.t", "y.i").alias("p")).unionByName(common)
    page = F.explode(F.array_distinct(F.array(*[F.floor((F.col("p.i") + k) / PAGE).cast("int") for k in (-NEAR, 0, NEAR)])))
    pairs = pairs.select("d", "t", F.col("p.n").alias("pn"), F.col("p.d").alias("pd"), F.col("p.t").alias("pt"), page.alias("page")).where("page >= 0").distinct()
    pages = keyed.where(F.size("lines") > 0).select("d", "t", "lines").dropDuplicates(["d", "t"])
    pages = pages.select(F.col("d").alias("od"), F.col("t").alias("ot"), F.explode(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / PAGE).cast("int"))).alias("k"), "lines")
    pages = pages.select("od", "ot", "k", F.slice("lines", F.col("k") * PAGE + 1, PAGE).alias("lines"))
    same = F.col("pd").eqNullSafe(F.col("od")) & (F.col("pt") == F.col("ot")) & (F.col("page") == F.col("k"))
    held = F.struct(F.col("pn").alias("n"), F.col("pd").alias("d"), F.col("pt").alias("t"), "page", "lines")
    return pairs.join(pages, same).groupBy("d", "t").agg(F.collect_list(held).alias("m"))


def dedup_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = 5, short: int = 5, rare: int = 8
) -> DataFrame:
    """``docs`` with its text changed, and n_lines (before) and n_removed."""
    pages = overlaps(docs, text, doc_id, short, rare)
    d, t, m, x = (unused(docs.columns, name) for name in ("__d", "__t", "__m", "__x"))
    pages = pages.withColumnsRenamed({"d": d, "t": t, "m": m})
    joined = docs.join(
        pages,
        F.col(f"`{doc_id}`").eqNullSafe(F.col(d)) & (F.xxhash64(f"`{text}`") == F.col(t)),
        "left",
    )
    both = F.struct(F.col(f"`{text}`").alias("text"), F.col(m).alias("m"))
    kept = [f"`{c}`" for c in docs.columns if c not in (text, "n_lines", "n_removed")]

    def compute(values: list[dict]) -> list[list]:
        out = [(None, 0, 0) if v["text"] is None else without(v["text"], v["m"] or [], min_words) for v in values]
        return list(map(list, zip(*out, strict=True))) if out else [[]] * 3

    fields = [(text, T.StringType()), ("n_lines", T.LongType()), ("n_removed", T.LongType())]
    order = [f"`{c}`" for c in docs.columns if c not in ("n_lines", "n_removed")]
    return add_columns(joined.select(*kept, both.alias(x)), x, fields, compute, drop=True).select(
        *order, "n_lines", "n_removed"
    )
