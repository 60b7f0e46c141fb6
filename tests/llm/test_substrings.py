"""Substring dedup against windows compared one by one."""

import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from depscope.llm import queries, substrings


def spark_hash(text):
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def plainly(rows, least=20):
    """(text left, words, words gone) by (d, text)."""
    out, seen = {}, set()
    known = {(d, x) for d, x in rows if x is not None}
    for d, x in sorted(known, key=lambda r: (r[0] is None, r[0] or 0, spark_hash(r[1]))):
        words = x.encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - least + 1):
            window = tuple(words[k : k + least])
            if window in seen:
                gone[k : k + least] = [True] * least
            seen.add(window)
        out[d, x] = (b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode(), len(words), sum(gone))
    return out


def held_against(spark, rows, least=20, frame=None):
    frame = spark.createDataFrame(rows, "d long, x string") if frame is None else frame
    got = substrings.dedup_substrings(frame, "x", "d", least).collect()
    want = plainly(rows, least)
    # of several texts of one doc_id the rows are told apart by their counts and what is left
    assert Counter((r["d"], r["x"], r["n_words"], r["n_removed"]) for r in got) == Counter(
        (d, *(want[d, x] if x is not None else (None, 0, 0))) for d, x in rows
    )
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
    return got


def texts(seed, count, words=40, most=160):
    """Texts that share passages, whole and edited."""
    pick = random.Random(seed)
    pool = [[f"w{pick.randrange(words)}" for _ in range(pick.randrange(5, 70))] for _ in range(6)]
    for _ in range(count):
        out = []
        while len(out) < pick.randrange(most):
            part = list(pick.choice(pool)) if pick.random() < 0.5 else [f"w{pick.randrange(words * 50)}" for _ in range(pick.randrange(30))]
            if part and pick.random() < 0.3:
                part[pick.randrange(len(part))] = "edit"
            out += part
        yield " ".join(out)


def test_against_all_windows(spark, monkeypatch):
    # several shards, and several slices of each
    monkeypatch.setattr(substrings, "SHARD", 5)
    monkeypatch.setattr(substrings, "SLICE", 60)
    rows = list(enumerate(texts(1, 70)))
    rows += [(None, rows[3][1]), (None, rows[4][1] + " more"), (80, None), (81, ""), (82, rows[5][1].replace(" ", "\n")), rows[6], rows[6]]
    rows += [(7, rows[8][1] + " of another text"), (83, "x y " * 40), (84, "z " * 20), (85, "\x1c z " * 19), (86, "z " * 19), (-1, rows[60][1])]
    frame = spark.createDataFrame(rows, "d long, x string")
    for c in ("__d", "__t", "__m", "__x", "t", "n", "u", "spans", "n_words", "key", "at"):
        frame = frame.withColumn(c, F.lit("old"))
    got = held_against(spark, rows, frame=frame)
    assert {r["__m"] for r in got} == {r["u"] for r in got} == {"old"}


def test_small_windows_and_few_words(spark):
    held_against(spark, list(enumerate(texts(5, 40, words=3, most=60))), least=7)
    held_against(spark, [(0, "a b c"), (1, "b c a b"), (2, "a b"), (3, None)], least=2)


def test_a_window_that_only_later_documents_share(spark):
    """Its anchor is first seen in a document that doesn't hold it, so it is found as its own anchor."""
    pick = random.Random(3)
    common = [f"c{k}" for k in range(24)]
    rows = [(d, " ".join([f"{d}-{k}" for k in range(30)] + common + [f"{d}+{k}" for k in range(30)])) for d in range(12)]
    for d in range(12, 40):  # one of four tails behind the passage
        rows.append((d, " ".join([f"{d}-{k}" for k in range(9)] + common + [f"tail{pick.randrange(4)}-{k}" for k in range(8)] + [f"{d}"])))
    held_against(spark, rows)


def test_a_very_long_text_and_empty_tables(spark):
    pick = random.Random(2)
    own = [f"w{pick.randrange(9000)}" for _ in range(60_000)]
    rows = [(0, " ".join(own)), (1, " ".join(own[100:30_000] + ["x"] + own[5:90])), (2, " ".join(own + own[:50])), (3, "short")]
    held_against(spark, rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.dedup_substrings(none).count() == 0


def test_first_places_of_frequent_keys(spark):
    """A key that fills several ranges, one at each border, single ones."""
    pick = random.Random(8)
    rows = [(pick.choice([5, 5, 5, pick.randrange(400)]), k, k % 3) for k in range(3000)]
    first, count = {}, Counter(k for k, _, _ in rows)
    for k, at, _ in rows:
        first[k] = min(at, first.get(k, at))
    want = sorted((at, part, first[k]) for k, at, part in rows if count[k] > 1)
    frame = spark.createDataFrame(rows, "key long, at long, part long")
    assert sorted(map(tuple, substrings.first_places(frame).collect())) == want
    keys = frame.selectExpr("cast(cast(key as string) as binary) AS key", "at", "part")
    assert sorted(map(tuple, substrings.first_places(keys).collect())) == want


def test_automaton():
    pick = random.Random(4)
    passages = [[pick.choice("abc") for _ in range(pick.randrange(30))] for _ in range(20)]
    automaton, first = substrings.Automaton(4), {}
    for n, words in enumerate(passages):
        automaton.add(words, n * 1000)
        for k in range(len(words) - 3):
            first.setdefault(tuple(words[k : k + 4]), n * 1000 + k)
    for _ in range(50):
        words = [pick.choice("abcd") for _ in range(40)]
        assert automaton.earliest(words) == [first.get(tuple(words[k : k + 4]), -1) for k in range(37)]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r)[1:3] for r in queries.op13_substring_dedup(spark, d).collect()}
    assert got == {k: v[1:] for (k, _), v in plainly(rows).items()}
