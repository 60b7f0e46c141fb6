"""Line dedup against a second patience diff, over the pairs that shared lines name."""

import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from depscope.llm import linededup


def spark_hash(text):
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def order(row):
    d, text = row
    return d is None, d or 0, spark_hash(text)


def longest(pairs):
    """The longest run of (i, j), rising in both, by comparing all of them; of several, the one whose members come latest."""
    size = []
    for k, (_, j) in enumerate(pairs):
        size.append(1 + max((size[m] for m in range(k) if pairs[m][1] < j), default=0))
    out, want, after = [], max(size, default=0), len(pairs)
    while want:
        after = max(k for k in range(after) if size[k] == want and (not out or pairs[k][1] < out[-1][1]))
        out.append(pairs[after])
        want -= 1
    return out[::-1]


def patience(a, b, i=0, j=0):
    """Aligned places of the lists ``a`` and ``b``, which begin at i and j."""
    if a and b and a[0] == b[0]:
        return [(i, j), *patience(a[1:], b[1:], i + 1, j + 1)]
    if a and b and a[-1] == b[-1]:
        return [*patience(a[:-1], b[:-1], i, j), (i + len(a) - 1, j + len(b) - 1)]
    once = longest([(k, b.index(x)) for k, x in enumerate(a) if a.count(x) == b.count(x) == 1])
    if not once:
        return []
    out, (x, y) = [], (0, 0)
    for k, m in [*once, (len(a), len(b))]:
        out += [*patience(a[x:k], b[y:m], i + x, j + y), (i + k, j + m)]
        x, y = k + 1, m + 1
    return out[:-1]


def lines_of(text):
    return [x.strip() for x in text.split("\n") if x.strip()]


def keys_of(lines, short=5):
    """What each line is looked up by: itself, or if it is short with those behind it."""
    out = []
    for k, line in enumerate(lines):
        end = k + 1
        while len(" ".join(lines[k:end]).split()) < short and end < len(lines):
            end += 1
        out.append((tuple(lines[k:end])))
    return out


def by_definition(rows, min_words=5, rare=8, counts=None):
    """(text left, lines, lines gone) of each document (d, text)."""
    known = sorted({(d, t) for d, t in rows if t is not None}, key=order)
    lines = {row: lines_of(row[1]) for row in known}
    times = Counter(k for d, t in rows if t is not None for k in keys_of(lines[d, t]))
    holders, out = {}, {}
    for row in known:
        gone, own = set(), lines[row]
        words = [len(x.split()) for x in own]
        with_whom = {p for k in set(keys_of(own)) for p in (holders.get(k, []) if times[k] <= rare else holders.get(k, [])[:1])}
        for partner in with_whom:
            met, at = dict(patience(own, lines[partner])), 0
            while at < len(own):
                end = at
                while end in met and (end == at or met[end] == met[end - 1] + 1):
                    end += 1
                if end > at and sum(words[at:end]) >= min_words:
                    gone.update(range(at, end))
                at = max(end, at + 1)
        for k in set(keys_of(own)):
            holders.setdefault(k, []).append(row)
        raw, left, going, at = row[1].split("\n"), [], False, -1
        for line in raw:
            if line.strip():
                at += 1
                going = at in gone
            if not going:
                left.append(line)
        out[row] = ("\n".join(left) if gone else row[1], len(own), len(gone))
    return out


PICK = random.Random(1)
POOL = [" ".join(PICK.choice(["red", "green", "blue", "ink", "pen"]) for _ in range(PICK.choice([1, 3, 6, 9]))) for _ in range(30)]


def some_rows():
    pick = random.Random(3)
    rows = [(d, "\n".join(pick.choice([*POOL, "", " "]) for _ in range(pick.randrange(14)))) for d in range(60)]
    rows += [(None, "\n".join(POOL[:5])), (None, "\n".join(POOL[3:9])), (70, None), (70, ""), (5, "\n".join(POOL[9:4:-1])), rows[20], rows[20], (None, None)]
    return [*rows, (3, "\n".join([" ".join(POOL), "a " * 9000, *POOL[:3]])), (80, "\n".join(["own words that begin it here", "a " * 9000]))]


def held_against(spark, rows, **options):
    frame = spark.createDataFrame(rows, "d long, text string").withColumn("n_lines", F.lit("old")).withColumn("__m", F.lit("own"))
    got = linededup.dedup_lines(frame, doc_id="d", **options).collect()
    want = by_definition(rows, options.get("min_words", 5), options.get("rare", 8))
    assert Counter((r["d"], r["text"], r["n_lines"], r["n_removed"]) for r in got) == Counter(
        (d, *(want[d, text] if text is not None else (None, 0, 0))) for d, text in rows
    )
    assert {r["__m"] for r in got} <= {"own"}
    return {d: text for (d, _), (text, _, _) in want.items()}


@pytest.mark.parametrize(("rare", "min_words"), [(8, 5), (0, 5), (100, 12)])
def test_as_defined(spark, rare, min_words):
    held_against(spark, some_rows(), rare=rare, min_words=min_words)


def test_alignment_decides(spark, monkeypatch):
    """Without the longest increasing run, only heads and tails of pairs agree."""
    p, q, r = ([f"{name} line {k} of some words" for k in range(4)] for name in "PQR")
    own = ["its own first line stays", "and its own second one does, too"]
    rows = [(1, "\n".join([*p, "between the first two of them", *q])), (5, "\n".join([own[0], *p, own[1], *q, "a last line of its own"])), (9, "\n".join([own[0] + " here", *q[:3], *p, "the end of it all is this"]))]
    left = held_against(spark, rows)
    assert left[5] == "\n".join([*own, "a last line of its own"])
    assert left[9] == "\n".join([own[0] + " here", *q[:3], "the end of it all is this"])  # crosses, and the longer run goes
    page = {"n": False, "d": 1, "t": 0, "page": 0, "lines": linededup.line_hashes([x.encode() for x in lines_of(rows[0][1])])}
    assert [linededup.without(text, [page], 5)[0] for _, text in rows[1:]] == [left[5], left[9]]
    monkeypatch.setattr(linededup, "increasing", lambda pairs: [])
    assert [linededup.without(text, [page], 5)[0] for _, text in rows[1:]] == [text for _, text in rows[1:]]


def test_alignment_of_any_lists():
    pick = random.Random(6)
    for _ in range(400):
        a, b = ([pick.choice("abcdefghijkl") for _ in range(pick.randrange(14))] for _ in "ab")
        got = linededup.aligned(a, b)
        assert all(a[i] == b[j] for i, j in got) and got == sorted(got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
        assert len(got) == len(patience(a, b))


def test_long_partners_come_in_pages(spark, monkeypatch):
    monkeypatch.setattr(linededup, "PAGE", 20)
    monkeypatch.setattr(linededup, "NEAR", 3)
    lines = [f"line {k} of a very long text" for k in range(200)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["other words to begin with here", *lines[15:24], "x", *lines[118:121], *lines[190:]])), (3, "\n".join(lines[::7]))]
    held_against(spark, rows)


def test_recall_of_shared_blocks(spark):
    """How many of all lines in any block that an earlier document has, in whatever order, go."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["n_removed"] for r in linededup.dedup_lines(docs).collect()}
    seen, shared, found = set(), 0, 0
    for d, text in sorted(map(tuple, docs.collect())):
        lines = lines_of(text or "")
        runs = [(a, b) for a in range(len(lines)) for b in range(a + 1, min(a + 6, len(lines)) + 1) if len(" ".join(lines[a:b]).split()) >= 5]
        gone = {k for a, b in runs if tuple(lines[a:b]) in seen for k in range(a, b)}
        seen.update(tuple(lines[a:b]) for a, b in runs)
        shared, found = shared + len(gone), found + min(len(gone), got[d])
    assert shared > 50 and found >= 0.9 * shared
