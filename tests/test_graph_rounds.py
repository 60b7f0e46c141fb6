"""Levels, pivots and rounds of large graphs: tasks of few edges over chains, ladders, grids, hubs and random graphs, against plain searches."""

import random
from collections import deque

import numpy as np
import pytest

from depscope import scratch
from depscope.operators import graph


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def components_of(pairs):
    nodes = sorted({x for p in pairs for x in p})
    at = {n: k for k, n in enumerate(nodes)}
    follow = [[] for _ in nodes]
    for a, b in pairs:
        follow[at[a]].append(at[b])
    comp = graph.tarjan(follow)
    return {n: nodes[comp[k]] for n, k in at.items()}


def depths_of(pairs, roots):
    follow = {}
    for a, b in pairs:
        follow.setdefault(a, []).append(b)
    depth, queue = dict.fromkeys(roots, 0), deque(roots)
    while queue:
        at = queue.popleft()
        for to in follow.get(at, ()):
            if to not in depth:
                depth[to] = depth[at] + 1
                queue.append(to)
    return {n: depth.get(n) for n in {x for p in pairs for x in p} | set(roots)}


def ladder(rungs, pick):
    """Up one rail, down the other, with rungs here and there: components of many cycles, and long ways between them."""
    pairs = [(2 * k, 2 * k + 2) for k in range(rungs)] + [(2 * k + 3, 2 * k + 1) for k in range(rungs)]
    pairs += [(2 * k, 2 * k + 1) if pick.random() < 0.5 else (2 * k + 1, 2 * k) for k in range(0, rungs, 7)]
    return [p for p in pairs if pick.random() < 0.995]


def mixed(pick, nodes=150):
    pairs = [(pick.randrange(nodes), pick.randrange(nodes)) for _ in range(nodes)]
    pairs += [(1000 + k, 1001 + k) for k in range(60)] + [(2000 + k, 2000 + (k + 1) % 60) for k in range(60)]  # a chain, a cycle
    pairs += [(3000, 3001 + k) for k in range(80)] + [(3001 + k, 3000) for k in range(80)]  # a hub
    return [*pairs, (1060, 2000), (2050, 3000), (3007, 5)]


def hidden(pairs, pick):
    """The same graph under numbers that tell nothing of places."""
    names = {x: pick.randrange(1 << 62) for p in pairs for x in p}
    return [(names[a], names[b]) for a, b in pairs]


def graphs():
    pick = random.Random(7)
    return {
        "ladder": hidden(ladder(120, pick), pick),
        "mixed": hidden(mixed(pick), pick),
        "dense": [(pick.randrange(60), pick.randrange(60)) for _ in range(500)],
        "random": hidden([(pick.randrange(150), pick.randrange(150)) for _ in range(400)], pick),
    }


@pytest.mark.parametrize("name", graphs())
def test_against_plain_searches(spark, name):
    pairs = graphs()[name]
    edges = frame(spark, [*pairs, (-9, -9), (None, 3)])
    want = {3: 3} | components_of([*pairs, (-9, -9)])
    assert dict(map(tuple, graph.strong_components(edges, most=150).collect())) == want
    roots = [pairs[0][0], pairs[9][1], -5]
    depths = depths_of(pairs, roots)
    near = dict(map(tuple, graph.hop_distance(edges, spark.createDataFrame([(r,) for r in roots], "node long"), most=150).collect()))
    assert {n: near[n] for n in depths} == depths
    scratch.release()


def test_bypassed_keeps_distances():
    pick = random.Random(2)
    for _ in range(60):
        n, m = 12, pick.randrange(1, 40)
        src, dst = (np.array([pick.randrange(n) for _ in range(m)]) for _ in "ab")
        hops = np.array([pick.randrange(1, 5) for _ in range(m)])
        into, out = (np.array([pick.random() < 0.3 for _ in range(n)]) for _ in "ab")
        made = graph.bypassed(n, src, dst, hops, into, out)
        assert len(made) <= m
        rows = np.array(made, int).reshape(-1, 3)
        for start in np.flatnonzero(into).tolist():
            before, after = (graph.nearest(graph.weighted(n, *e), {start: 0}) for e in ((src, dst, hops), rows.T))
            assert all(before.get(k) == after.get(k) for k in np.flatnonzero(out).tolist())


def test_linked_keeps_reach():
    pick = random.Random(3)
    for _ in range(60):
        n = 14
        pairs = [(a, b) for a, b in ((pick.randrange(n), pick.randrange(n)) for _ in range(pick.randrange(1, 40))) if a < b]
        src, dst = np.array(pairs, int).reshape(-1, 2).T
        border = np.array([pick.random() < 0.4 for _ in range(n)])
        made = graph.linked(n, src, dst, border)
        assert len(made) <= len(pairs)
        rows, one = np.array(made, int).reshape(-1, 3).T, np.ones(len(src), int)
        for start in np.flatnonzero(border).tolist():
            before, after = (graph.nearest(graph.weighted(n, *e), {start: 0}) for e in ((src, dst, one), rows))
            assert all((k in before) == (k in after) for k in np.flatnonzero(border).tolist())


def written_during(work):
    before = set(scratch.written())
    out = work()
    return out, [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in scratch.written() if p not in before]


def test_a_long_ladder_takes_few_rounds(spark):
    pick = random.Random(1)
    pairs = hidden(ladder(1500, pick), pick)
    edges = frame(spark, pairs)
    got, tables = written_during(lambda: dict(map(tuple, graph.strong_components(edges, most=600).collect())))
    assert got == components_of(pairs)
    assert tables.count("graph-rest") <= 6 and "scc-reach" not in tables  # it shrinks, and no path is followed hop by hop
    root = spark.createDataFrame([pairs[0][:1]], "node long")
    near, tables = written_during(lambda: dict(map(tuple, graph.hop_distance(edges, root, most=600).collect())))
    assert near == depths_of(pairs, pairs[0][:1])
    assert tables.count("graph-rest") <= 6 and len(tables) < 60
    scratch.release()
