"""Periodic runs against a plain search over all periods and places."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from depscope.llm import periodic, queries


def plainly(words, least=6):
    n, out = len(words), set()
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            start, end = i, j + p
            shorter = any(all(words[k] == words[k + q] for k in range(start, end - q)) for q in range(1, p))
            if end - start >= max(least, 4 * p) and not shorter:
                out.add((start, end - start, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def found(texts):
    made = periodic.described(texts, 6)
    return [[(r["start"], r["length"], r["period"]) for r in runs] for runs in made[6]], made


def some_texts(seed, count):
    pick = random.Random(seed)
    for _ in range(count):
        words = [pick.choice("ab" if pick.random() < 0.5 else "abcde") for _ in range(pick.randrange(60))]
        if words and pick.random() < 0.6:
            a, p = pick.randrange(len(words)), pick.randrange(1, 7)
            words[a:] = [words[a + k % min(p, len(words) - a)] for k in range(len(words) - a)]
        yield " ".join(words)


def test_as_defined(monkeypatch):
    texts = [*some_texts(1, 300), None, "", "a a a a a", "a a a a a a", "a b " * 40 + "a", " ".join("abcabcabcabcab" * 3)]
    for block in (periodic.BLOCK, 7):
        monkeypatch.setattr(periodic, "BLOCK", block)
        runs, made = found(texts)
        for text, own, left, best in zip(texts, runs, made[7], zip(*made[2:6], strict=True), strict=True):
            words = (text or "").split()
            assert own == plainly(words)
            assert left == (None if text is None else collapsed(words, own))
            top = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else None
            assert best == ((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)


@settings(max_examples=60)
@given(st.lists(st.lists(st.sampled_from(["x", "y"]), max_size=40).map(" ".join), max_size=4))
def test_any_texts(texts):
    assert found(texts)[0] == [plainly(t.split()) for t in texts]


def test_hashes_that_lie(monkeypatch):
    monkeypatch.setattr(periodic.Prefixes, "same", lambda self, at, apart, length: np.ones(len(at), bool))
    texts = list(some_texts(2, 60))
    assert found(texts)[0] == [plainly(t.split()) for t in texts]


def test_frames(spark):
    long = "one two three " * 30_000
    rows = [(1, "a b " * 9), (1, "a b " * 9), (None, None), (2, ""), (3, long), (4, "x\ty\x0bz\n" * 4), (5, "p\x1cq " * 6)]
    frame = spark.createDataFrame(rows, "d long, x string").withColumn("runs", F.lit("old")).withColumn("__source", F.lit(3))
    got = sorted(periodic.periodic_runs(frame, "x").collect(), key=lambda r: (r["d"] or 0, r["n_words"]))
    assert [(r["d"], r["n_words"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["collapsed"], r["__source"]) for r in got] == [
        (None, 0, 0, None, None, None, None, None, 3), (1, 18, 1, 0, 18, 2, 9000, "a b", 3), (1, 18, 1, 0, 18, 2, 9000, "a b", 3), (2, 0, 0, None, None, None, None, "", 3),
        (3, 90_000, 1, 0, 90_000, 3, 30_000_000, "one two three", 3), (4, 12, 1, 0, 12, 3, 4000, "x y z", 3), (5, 6, 1, 0, 6, 1, 6000, "p\x1cq", 3),
    ]
    assert periodic.periodic_runs(frame.limit(0), "x").count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(got) == len(docs)
    for doc in docs:
        words, h = (doc["text"] or "").encode().split(), zlib.crc32(str(doc["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 500:
            continue
        runs = plainly(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
        left = collapsed([w.decode() for w in words], runs)
        want = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, left)))
        assert got[doc["doc_id"]] == want
