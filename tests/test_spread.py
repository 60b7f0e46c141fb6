"""Rows of a task are bounded, whatever the tables' size."""

import random

from depscope import scratch
from depscope.operators import cycles, deltas, graph, quality, spread
from depscope.plans import adapters as ad
from depscope.plans import graph_queries as gq
from depscope.sources.tables import read_table

DATA = "/root/testdata/sf0.001"


def tasks(frame):
    return frame.rdd.getNumPartitions()


def test_changes_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 500)
    lines = [tuple(r) for r in read_table(spark, DATA, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag").collect()]
    was, now = ({(a, b) for a, b, flag in lines if flag not in (gone, None)} for gone in ("N", "R"))
    for frame, want in zip(gq._changes(spark, DATA), (was, now, now - was, was - now), strict=True):
        assert tasks(frame) >= len(lines) // 500
        assert sorted(map(tuple, frame.collect())) == sorted(want)


def test_handoff(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 500)
    assert tasks(ad.supplier_handoff(spark, DATA)) >= read_table(spark, DATA, "lineitem").count() // 500


def test_strengths(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 500)
    edges = ad.part_supplier(spark, DATA)
    assert tasks(edges) >= read_table(spark, DATA, "lineitem").count() // 500
    assert tasks(gq.edge_strength(spark, DATA)) >= edges.count() // 500


def test_small_classes_cost_no_call(spark, monkeypatch):
    seen = []
    bits = quality._sharing_bits
    monkeypatch.setattr(quality, "_sharing_bits", lambda masks: seen.append(masks.count()) or bits(masks))
    usage = spark.createDataFrame([(c, m, f) for c in range(20) for m, f in ((1, "a"), (2, "a"), (2, "b"), (3, "b"))], "class_id int, method_id int, field string")
    assert {tuple(r) for r in quality.cohesion(usage).select("n_methods", "sharing").collect()} == {(3, 2)}
    assert seen == [0]


def test_graph_steps_are_dealt(spark, monkeypatch):
    """With few rows a task, components, hops and components after changes are those of one task, and the widest steps have a task for each ROWS."""
    pick = random.Random(7)
    edges = {(pick.randrange(60), pick.randrange(60)) for _ in range(110)} | {(k, k + 1) for k in range(100, 160)}
    lost, new = set(pick.sample(sorted(edges), 8)), {(pick.randrange(60), pick.randrange(170)) for _ in range(8)} - edges
    frame, now, came, went = (spark.createDataFrame(sorted(x), "src long, dst long") for x in (edges, (edges - lost) | new, new, lost))
    roots = spark.createDataFrame([(0,), (100,)], "node long")

    def rows(found):
        return sorted(map(tuple, found.collect()), key=repr)

    before = rows(graph.strong_components(frame)), rows(graph.hop_distance(frame, roots)), rows(graph.strong_components(now))
    monkeypatch.setattr(spread, "ROWS", 20)
    found = scratch.materialise(graph.strong_components(frame, 60), "test-spread")  # fewer than the edges, so that there are levels
    assert rows(found) == before[0]
    assert rows(graph.hop_distance(frame, roots)) == before[1]
    assert rows(deltas.components_after(now, found, came, went)) == before[2]
    assert tasks(graph.endpoints(frame, len(edges))) >= 2 * len(edges) // 20
    assert tasks(graph.plain(frame, len(edges))) >= len(edges) // 20
    assert tasks(deltas._between(frame, found, len(edges))) >= len(edges) // 20
    scratch.release()


def test_cycles_of_two_detectors_are_solved_once(spark, monkeypatch):
    solved, given = [], []
    whole, counted = cycles.strong_components, cycles.once
    monkeypatch.setattr(cycles, "strong_components", lambda edges: solved.append(edges) or whole(edges))
    monkeypatch.setattr(cycles, "once", lambda rows, label: given.append(label) or counted(rows, label))
    assert gq.cycles_dedup(spark, DATA).count() == 1
    assert len(solved) == 1 and given == ["cycle-edges", "cycle-components"]
