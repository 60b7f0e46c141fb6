"""Importance resampling against plain Python: CRCs of runs by zlib, counts, weights, noise and draws."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from depscope.llm import importance, queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, longest=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return len(words), [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def buckets_of(text, longest=2, buckets=10_000):
    return [zlib.crc32(f.encode()) % buckets for f in runs(text, longest)[1]]


def plainly(docs, target, share=(25, 100), least=20, seed=7, buckets=10_000):
    source, other = Counter(), Counter()
    for _, text in docs:
        source.update(buckets_of(text))
    for text in target:
        other.update(buckets_of(text))
    s, t, out = source.total(), other.total(), []
    gain = [math.floor(1000 * math.log(((other[b] + 1) * (s + buckets)) / ((source[b] + 1) * (t + buckets)))) for b in range(buckets)]
    for d, text in docs:
        found = buckets_of(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, runs(text)[0]])
    eligible = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, row in enumerate(eligible[: share[0] * len(eligible) // share[1]]):
        row[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="aB é9\n_", max_size=200))))
def test_buckets_are_those_of_the_strings(texts):
    words, text_of, made = importance.features(texts, 3, 10_000)
    assert words.tolist() == [runs(t)[0] for t in texts]
    for k, text in enumerate(texts):
        got = Counter(b for at in made for b in at[text_of == k].tolist() if b >= 0)
        assert got == Counter(buckets_of(text, 3))


def test_long_words_and_moves():
    text = "x" * 100_000 + " " + "é" * 70 + " y " + "z" * importance.WIDE + " " + "z" * (importance.WIDE + 1)
    assert Counter(b for at in importance.features([text], 2, 10_000)[2] for b in at.tolist() if b >= 0) == Counter(buckets_of(text))
    first, more = b"some bytes", b"\x00\xff" * 33
    crc = importance.moved(np.array([zlib.crc32(first)], np.uint32), np.array([len(more)]))[0] ^ zlib.crc32(more)
    assert crc == zlib.crc32(first + more)


def test_against_plain_python(spark):
    pick = random.Random(11)
    words = ["Red", "green", "BLUE", "inK", "pen", "été", "x9"]
    docs = [(d, " ".join(pick.choice(words) for _ in range(pick.randrange(60)))) for d in range(80)]
    docs += [(None, docs[5][1]), (None, None), (81, None), (82, ""), (83, "... --"), docs[7], docs[7], (3, "red " * 25), (84, "w " * 30_000)]
    target = ["red green, ink!", None, "", "pen pen x9 ÉTÉ"]
    frame = spark.createDataFrame(docs, "d long, x string")
    for c in ("rank", "score", "n_features", "__words", "__part", "__o0", "__own", "__start", "words", "weight"):
        frame = frame.withColumn(c, F.lit("old"))
    other = spark.createDataFrame([(t,) for t in target], "y string")
    got = importance.resample(frame, other, "x", "d", "y").collect()
    assert Counter((r["d"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got) == plainly(docs, target)
    assert {r["__part"] for r in got} == {r["__words"] for r in got} == {"old"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.resample(none, one).count() == 0
    assert [tuple(r) for r in importance.resample(one, none).select("n_features", "rank").collect()] == [(3, None)]


def test_sql(spark):
    tables = duckdb.connect()
    for t in ("documents", "benchmark"):
        tables.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = Counter(tables.sql(queries.oracle_sql()["op11_importance_resampling"]).fetchall())
    assert Counter(map(tuple, queries.op11_importance_resampling(spark, "/root/testdata/sf0.001").collect())) == want
