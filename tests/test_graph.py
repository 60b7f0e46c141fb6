"""Components, reach and cycles against known partitions and a plain implementation."""

import random

import pytest

from depscope.operators import components, coupling, cycles, graph

LETTERS = [(0, 1), (1, 2), (2, 0), (2, 8), (8, 9), (1, 3), (3, 4), (4, 5), (5, 6), (6, 3), (5, 7)]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r["scc"], set()).add(r["node"])
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("most", [graph.EDGES, 4])
def test_known_components(spark, most):
    found = groups(graph.strong_components(frame(spark, LETTERS), most=most).collect())
    assert found == [[0, 1, 2], [3, 4, 5, 6], [7], [8], [9]]


def test_deep_chain_needs_no_recursion(spark):
    n = 5000
    found = graph.strong_components(frame(spark, [(k, (k + 1) % n) for k in range(n)]))
    assert found.select("scc").distinct().collect()[0][0] == 0


def test_hop_limit(spark):
    roots = spark.createDataFrame([(0,)], "node long")
    for most in (graph.EDGES, 4):
        depth = {r["node"]: r["depth"] for r in graph.hop_distance(frame(spark, LETTERS), roots, furthest=2, most=most).collect()}
        assert depth[0] == 0 and depth[2] == 2 and depth[3] == 2 and depth[4] is None


def test_empty_graph(spark):
    edges = frame(spark, [])
    assert graph.strong_components(edges).count() == 0
    assert coupling.coupling(edges).count() == 0
    assert cycles.cycles(cycles.cycle_members(edges)).count() == 0


def test_cycle_of_a_package(spark):
    names = [("a", "b"), ("a", "c"), ("b", "c"), ("b", "a"), ("c", "a"), ("init", "a"), ("loop", "loop")]
    edges = spark.createDataFrame(names, "src string, dst string")
    members = cycles.cycle_members(edges)
    found = {(r["scc"], r["size"]): r["severity"] for r in cycles.cycles(members).collect()}
    assert found == {("a", 3): "medium", ("loop", 1): "medium"}
    assert {r["node"] for r in members.where("scc = 'a'").collect()} == {"a", "b", "c"}
    assert cycles.cycle_edges(edges, cycles.cycle_members(edges, loops=False)).count() == 5


def test_simple_cycles(spark):
    pick = random.Random(6)
    pairs = [(pick.randrange(9), pick.randrange(9)) for _ in range(28)]
    edges = frame(spark, [*pairs, *pairs[:5]])
    found = sorted(tuple(r["path"]) for r in cycles.simple_cycles(edges, cycles.cycle_members(edges), 5).collect())
    follow, want = {}, set()
    for a, b in pairs:
        follow.setdefault(a, set()).add(b)

    def walk(path):
        for to in follow.get(path[-1], ()):
            if to == path[0]:
                want.add(tuple(path))
            elif to > path[0] and to not in path and len(path) < 5:
                walk([*path, to])

    for start in range(9):
        walk([start])
    assert found == sorted(want) and {len(p) for p in found} >= {1, 2, 3, 4, 5}


def test_coupling_sums(spark):
    rows = coupling.coupling(frame(spark, LETTERS + LETTERS[:3])).collect()
    assert sum(r["afferent"] for r in rows) == sum(r["efferent"] for r in rows) == len(LETTERS) + 3
    assert all(0 <= r["instability"] <= 1 for r in rows)


def test_undirected_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    parent = {x: x for p in pairs for x in p}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    want = {x: top(x) for p in pairs for x in p if any(a != b and x in (a, b) for a, b in pairs)}
    edges = spark.createDataFrame(pairs + [(None, 1)], "a long, b long")
    assert dict(map(tuple, components.components(edges).collect())) == want
