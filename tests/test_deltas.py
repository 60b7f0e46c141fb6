"""Figures after changes against figures made whole."""

import random
from collections import Counter

from depscope import scratch
from depscope.operators import coupling, deltas, graph


def test_coupling(spark):
    pick = random.Random(3)
    old = [(pick.randrange(9), pick.randrange(9)) for _ in range(40)]
    lost, new = old[:12], [(pick.randrange(12), pick.randrange(12)) for _ in range(9)]
    frames = [spark.createDataFrame(x, "src long, dst long") for x in (old, new, lost, old[12:] + new)]
    got = deltas.coupling_after(coupling.coupling(frames[0]), frames[1], frames[2]).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, coupling.coupling(frames[3]).select("entity", "afferent", "efferent", "instability").collect()))


def test_components_over_edits(spark):
    pick = random.Random(4)
    now = {(pick.randrange(30), pick.randrange(30)) for _ in range(45)}
    known = graph.strong_components(spark.createDataFrame(sorted(now), "src long, dst long"))
    kinds = Counter()
    for step in range(6):
        lost = set(pick.sample(sorted(now), pick.choice([0, 1, 3])))
        new = {(pick.randrange(33), pick.randrange(33)) for _ in range(pick.choice([0, 1, 3]))} - now
        now = (now - lost) | new
        frames = [spark.createDataFrame(sorted(x), "src long, dst long") for x in (now, new, lost)]
        known = scratch.materialise(deltas.components_after(frames[0], known, frames[1], frames[2]), "test-deltas")
        names, at = sorted({x for p in now for x in p}), {}
        at = {x: k for k, x in enumerate(names)}
        follow = [[] for _ in names]
        for a, b in now:
            follow[at[a]].append(at[b])
        want = {x: names[c] for x, c in zip(names, graph.tarjan(follow).tolist(), strict=True)}
        assert dict(map(tuple, known.collect())) == want, step
        kinds[len(set(want.values()))] += 1
    assert len(kinds) > 1  # components split and merged
    scratch.release()
