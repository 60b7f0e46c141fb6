"""The near-dedup stage against all pairs by exact similarity."""

import random

import numpy as np

import corpus_pipeline
from depscope.llm import similar


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def survivors(rows, least=0.8):
    """doc_ids that lead their group, by brute force."""
    sets = {d: grams(t) for d, t in rows}
    lead = {d: d for d in sets}

    def root(d):
        while lead[d] != d:
            d = lead[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 5 * least * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                lead[y] = x
    return {d for d in sets if root(d) == d}


def test_similar_pairs_of_any_distance(spark):
    pick = random.Random(3)
    rows = []
    for k in range(40):
        base = [f"w{pick.randrange(400)}" for _ in range(pick.randrange(40, 160))]
        rows.append((10 * k, " ".join(base)))
        for c in range(1, 6):  # more and more words changed: similar to dissimilar
            words = list(base)
            for _ in range(c if k % 2 else 2 * c):
                words[pick.randrange(len(words))] = f"x{pick.randrange(400)}"
            rows.append((10 * k + c, " ".join(words)))
    shared = " ".join(f"boiler{k}" for k in range(30))
    rows += [(1000 + k, f"{shared} own{k} " + " ".join(f"u{k}v{j}" for j in range(k))) for k in range(12)]
    long = [f"common{k}" for k in range(300)]
    for k in range(24):  # long texts that are mostly what many have: all of their shingles are looked at
        words = list(long)
        for c in range(pick.randrange(2, 14)):
            words[20 * c + pick.randrange(9)] = f"z{pick.randrange(6)}"
        rows.append((3000 + k, " ".join(words)))
        rows.append((4000 + k, " ".join([*long[100:180], *(f"own{k}x{j}" for j in range(200))])))  # a passage quoted
    rows += [(2000, None), (2001, ""), (2002, "few words"), (2003, "Few  words")]
    docs = spark.createDataFrame(
        [(d, t, "en", "a", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    want = survivors(rows)
    for rare, wide in ((8, 2), (1, 32), (10**6, 10**6)):
        got = [r["doc_id"] for r in similar.one_of_each(docs, rare=rare, wide=wide).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want
    assert 40 < len(want) < len(rows) - 40


def test_sketches_rule_out_no_similar_pair():
    pick = np.random.default_rng(4)
    dropped = 0
    for size in (1, 3, 40, 300, 5000):
        base = pick.integers(0, 2**64, size, dtype=np.uint64)
        for share in (0.0, 0.05, 0.1, 0.2, 0.5, 1.0):
            other = base.copy()
            changed = pick.random(size) < share
            other[changed] = pick.integers(0, 2**64, int(changed.sum()), dtype=np.uint64)
            other = np.concatenate([other, pick.integers(0, 2**64, int(size * share / 3), dtype=np.uint64)])
            a, b = np.unique(base), np.unique(other)
            may = similar.can_be_similar(similar.sketch(a), similar.sketch(b), len(a), len(b))
            assert may or not similar.similar(a, b)
            dropped += not may
    assert dropped > 8
    many = np.arange(9000, dtype=np.uint64)  # all in one range
    assert similar.can_be_similar(similar.sketch(many), similar.sketch(many[:10]), 9000, 10)


def test_groups_in_blocks(spark):
    """Sets of a shingle in blocks of any size: the pairs that comparing all gives."""
    pick = np.random.default_rng(2)
    base = pick.integers(0, 2**64, 400, dtype=np.uint64)
    sets = {}
    for k in range(60):
        own = base[: int(pick.integers(60, 400))].copy() if k % 3 else pick.integers(0, 2**64, int(pick.integers(1, 300)), dtype=np.uint64)
        changed = pick.random(len(own)) < pick.choice([0.01, 0.1, 0.4])
        own[changed] = pick.integers(0, 2**64, int(changed.sum()), dtype=np.uint64)
        sets[k] = np.unique(own)
    sketches = {k: similar.sketch(v) for k, v in sets.items()}
    named = spark.createDataFrame([(h, k, len(sets[k]), k // 2) for h in (1, 2) for k in sets if (k + h) % 5], "h long, id long, n long, c long")
    frame = spark.createDataFrame([(k, bytearray(v)) for k, v in sketches.items()], "id long, sketch binary")
    want = {
        (a, b)
        for a in sets
        for b in sets
        if a < b and a // 2 != b // 2 and any((a + h) % 5 and (b + h) % 5 for h in (1, 2))
        and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b]))
        and similar.can_be_similar(sketches[a], sketches[b], len(sets[a]), len(sets[b]))
    }
    counted = named.join(named.groupBy("h").count().withColumnRenamed("count", "g"), "h")
    whole = spark.createDataFrame([(k, bytearray(v.tobytes()), bytearray(sketches[k])) for k, v in sets.items()], "id long, whole binary, sketch binary")
    alike = {(a, b) for a, b in want if similar.similar(sets[a], sets[b])}
    for block in (2048, 7, 1):
        assert {(r["a"], r["b"]) for r in similar.met_in_groups(counted, frame, similar.SIMILARITY, block).collect()} == want
        links = {(r["a"], r["b"]) for r in similar.met_in_groups(counted, whole, similar.SIMILARITY, block).collect()}
        assert links <= alike and joined(links) == joined(alike)
    assert len(want) > 20 and len(alike) > 5


def joined(links):
    """Groups of the sets' groups, two sets each, as the links join them."""
    found = similar.Joined()
    for a, b in sorted(links):
        found.join(a // 2, b // 2)
    return [found.root(c) for c in range(30)]
