"""Graph figures brought up to date by the edges that came and went.

A run that parses a few files again knows which edges they lost and gained. Coupling changes by signed sums at the ends of these
edges. Components change in two places: one that lost an inner edge is solved anew, alone; and a new edge between two
components can only merge those that lie on a way from its end back to its beginning, so the search for these begins at new edges
and the components found there are solved alone, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.operators import graph
from depscope.operators.spread import dealt
from depscope.scratch import materialise, once


def coupling_after(before: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(entity, afferent, efferent, instability) from that ``before`` and changed edges (src, dst); an edge that came twice counts twice.

    An entity without edges has no row."""
    signed = added.select("src", "dst", F.lit(1).alias("n")).unionByName(removed.select("src", "dst", F.lit(-1).alias("n")))
    nothing = F.lit(0).alias("i")
    ends = signed.select(F.col("src").alias("entity"), nothing, F.col("n").alias("o")).unionByName(
        signed.select(F.col("dst").alias("entity"), F.col("n").alias("i"), F.lit(0).alias("o"))
    )
    change = ends.where("entity IS NOT NULL").groupBy("entity").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    met = before.join(change, "entity", "full")
    afferent, efferent = (F.coalesce(c, F.lit(0)) + F.coalesce(d, F.lit(0)) for c, d in (("afferent", "i"), ("efferent", "o")))
    now = met.select("entity", afferent.alias("afferent"), efferent.alias("efferent")).where("afferent + efferent > 0")
    return now.withColumn("instability", F.col("efferent").cast("double") / (F.col("afferent") + F.col("efferent")))


def _between(edges: DataFrame, components: DataFrame, total: int) -> DataFrame:
    """(a, b) with the components of both ends in place of ``edges`` (src, dst), of which there are at most ``total``."""
    first = components.select(F.col("node").alias("src"), F.col("scc").alias("a"))
    second = components.select(F.col("node").alias("dst"), F.col("scc").alias("b"))
    return dealt(dealt(edges, total, "src").join(first, "src"), total, "dst").join(second, "dst")


def components_after(edges: DataFrame, before: DataFrame, added: DataFrame, removed: DataFrame, most: int = graph.EDGES) -> DataFrame:
    """(node, scc) of the graph ``edges`` as it is now, from that ``before`` its edges (src, dst) ``added`` and ``removed``."""
    edges, before, added, removed = (once(x, "deltas-given") for x in (edges, before, added, removed))
    total, n_nodes, n_added, n_removed = (x.count() for x in (edges, before, added, removed))
    links, came, went = (x.select("src", "dst").where("src <> dst") for x in (edges, added, removed))
    # split: components that lost an edge between their nodes
    broken = materialise(_between(went, before, n_removed).where("a = b").select(F.col("a").alias("scc")).distinct(), "deltas-broken")
    known = before
    if not broken.isEmpty():
        members = materialise(dealt(before, n_nodes, "scc").join(broken, "scc", "left_semi").select("node", "scc"), "deltas-members")
        leaving = dealt(links, total, "src").join(members.select(F.col("node").alias("src")), "src", "left_semi")
        inner = _between(leaving, members, total).where("a = b").select("src", "dst")
        anew = graph.strong_components(materialise(inner, "deltas-inner"), most)
        alone = members.join(anew, "node", "left_anti").select("node", F.col("node").alias("scc"))
        known = dealt(before, n_nodes, "scc").join(broken, "scc", "left_anti").select("node", "scc").unionByName(anew).unionByName(alone)
    fresh = graph.endpoints(added, n_added).join(before, "node", "left_anti")
    known = known.select("node", "scc").unionByName(fresh.select("node", F.col("node").alias("scc")))
    gone = graph.endpoints(removed, n_removed).join(graph.endpoints(edges, total), "node", "left_anti")
    known = materialise(dealt(known, n_nodes + 2 * n_added, "node").join(gone, "node", "left_anti"), "deltas-known")
    # merge: components on a way from a new edge's end to a new edge's beginning
    new = materialise(dealt(_between(came, known, n_added).where("a <> b").select("a", "b"), n_added, "a", "b").distinct(), "deltas-new")
    if new.isEmpty():
        return known
    whole = _between(links, known, total).where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    whole = materialise(dealt(whole, total, "src", "dst").distinct(), "deltas-condensed")
    ahead = graph.reachable(whole, new.select(F.col("b").alias("node")).distinct(), most)
    behind = graph.reachable(graph.transpose(whole), new.select(F.col("a").alias("node")).distinct(), most)
    region = materialise(ahead.join(behind, "node", "left_semi"), "deltas-region")
    inside = dealt(whole, total, "src").join(region.select(F.col("node").alias("src")), "src", "left_semi")
    inside = dealt(inside, total, "dst").join(region.select(F.col("node").alias("dst")), "dst", "left_semi")
    merged = graph.strong_components(inside, most).select(F.col("node").alias("scc"), F.col("scc").alias("into")).where("scc <> into")
    return known.join(merged, "scc", "left").select("node", F.coalesce("into", "scc").alias("scc"))
