"""Cycles: one per strongly connected component, with severity, edges, flags and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.functions import metrics
from depscope.operators.graph import strong_components
from depscope.operators.spread import dealt
from depscope.scratch import materialise, once


def cycle_members(edges: DataFrame, loops: bool = True, components: DataFrame | None = None) -> DataFrame:
    """(node, scc, size) of the nodes on cycles; with ``loops`` a node with an edge to itself is one."""
    edges = once(edges, "cycle-edges")
    found = once(strong_components(edges) if components is None else components, "cycle-components")
    sizes = dealt(found, found.count(), "scc").groupBy("scc").agg(F.count("*").alias("size")).where("size > 1")
    members = found.join(sizes, "scc", "left").withColumn("size", F.coalesce("size", F.lit(1).cast("long")))
    own = edges.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
    kept = F.col("size") > 1
    if loops:
        members, kept = members.join(own, "node", "left"), kept | F.coalesce("loop", F.lit(False))
    return members.where(kept).select("node", "scc", "size")


def cycle_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges inside a component, with scc and size."""
    ends = members.select("node", "scc", "size")
    return (
        edges.join(ends.withColumnRenamed("node", "src"), "src")
        .join(ends.select(F.col("node").alias("dst"), F.col("scc").alias("scc2")), "dst")
        .where("scc = scc2")
        .drop("scc2")
    )


def cycles(members: DataFrame, kind: str = "import") -> DataFrame:
    """(scc, size, cycle_type, severity, description): a cycle of any size is one small row; its members are those of its scc."""
    return members.groupBy("scc").agg(F.max("size").alias("size")).select(
        "scc",
        "size",
        F.lit(kind).alias("cycle_type"),
        metrics.cycle_severity(kind, F.col("size")).alias("severity"),
        F.concat(F.lit(f"{kind} cycle of "), F.col("size").cast("string")).alias("description"),
    )


def typed_cycles(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Cycles among the edges of each type alone, united; a type that is named twice counts once."""
    out = None
    for kind in dict.fromkeys(kinds):
        own = edges.where(F.col("relationship_type") == kind).select("src", "dst")
        found = cycles(materialise(cycle_members(own), "cycle-members"), kind)
        out = found if out is None else out.unionByName(found)
    return out


def simple_cycles(edges: DataFrame, members: DataFrame, longest: int) -> DataFrame:
    """(length, path, scc) of every way of at most ``longest`` edges that comes back to where it began and meets no other node twice.

    A cycle is told once, from its least node on, so a path only goes on to greater nodes of its component; repeats of an edge
    count as one. There is a row for each cycle, however many they are, and a round for each length."""
    links = materialise(cycle_edges(edges.select("src", "dst").distinct(), members).select("src", "dst", "scc"), "cycle-links")
    back = links.select(F.col("src").alias("last"), F.col("dst").alias("first"))
    found = links.where("src = dst").select(F.array("src").alias("path"), "scc")
    paths = links.where("src < dst").select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"), "scc")
    for length in range(2, longest + 1):
        paths = materialise(paths, "cycle-paths")
        found = found.unionByName(paths.join(back, ["last", "first"], "left_semi").select("path", "scc"))
        if length < longest:
            ahead = links.select(F.col("src").alias("last"), F.col("dst").alias("to"))
            further = paths.join(ahead, "last").where((F.col("to") > F.col("first")) & ~F.array_contains("path", F.col("to")))
            paths = further.select("first", F.col("to").alias("last"), F.array_append("path", F.col("to")).alias("path"), "scc")
    return found.select(F.size("path").alias("length"), "path", "scc")


def cycle_strength(inner: DataFrame) -> DataFrame:
    """(scc, size, n_edges, mean_strength, severity) from cycle edges with strength."""
    return (
        inner.groupBy("scc", "size")
        .agg(F.count("*").alias("n_edges"), F.avg("strength").alias("mean_strength"))
        .withColumn("severity", metrics.strength_severity(F.col("size"), F.col("mean_strength")))
    )


def flag_entities(rows: DataFrame, members: DataFrame, key: str = "id", kind: str = "import") -> DataFrame:
    """``rows`` with in_cycle and the greatest severity of the cycles of ``members`` (node, size) they are in."""
    severity = metrics.cycle_severity(kind, F.col("size"))
    worst = members.groupBy(F.col("node").cast("string").alias("__e")).agg(
        F.max_by(severity, metrics.severity_rank(severity)).alias("severity")
    )
    joined = rows.join(worst, F.col(key).cast("string") == F.col("__e"), "left")
    return joined.withColumn("in_cycle", F.col("__e").isNotNull()).drop("__e")


def flag_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``edges`` with in_cycle: both ends in one component."""
    ends = members.select("node", "scc")
    return (
        edges.join(ends.select(F.col("node").alias("src"), F.col("scc").alias("a")), "src", "left")
        .join(ends.select(F.col("node").alias("dst"), F.col("scc").alias("b")), "dst", "left")
        .withColumn("in_cycle", F.coalesce(F.col("a") == F.col("b"), F.lit(False)))
        .drop("a", "b")
    )


def cycle_statistics(found: DataFrame) -> DataFrame:
    """One row of counts by type and severity."""
    tests = {f"n_{k}": F.col("cycle_type") == k for k in ("import", "call")}
    tests |= {f"n_{s}": F.col("severity") == s for s in ("high", "medium", "low")}
    return found.agg(F.count("*").alias("total"), *[F.count_if(t).alias(n) for n, t in tests.items()])
