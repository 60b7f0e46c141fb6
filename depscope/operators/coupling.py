"""Coupling of the ends of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.functions import metrics, names
from depscope.operators.spread import spread
from depscope.scratch import materialise


def coupling(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """(entity, afferent, efferent, instability); edges count as often as they occur, or
    with ``distinct`` once for each pair. One shuffle: an edge adds to both its ends."""
    pairs = edges.select("src", "dst")
    if distinct:
        pairs = pairs.distinct()
    ends = F.array(
        F.struct(F.col("src").alias("entity"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("dst").alias("entity"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )
    summed = (
        pairs.select(F.explode(ends).alias("x"))
        .groupBy(F.col("x.entity").alias("entity"))
        .agg(F.sum("x.i").alias("afferent"), F.sum("x.o").alias("efferent"))
    )
    return summed.withColumn("instability", metrics.instability(F.col("afferent"), F.col("efferent")))


def graph_totals(edges: DataFrame) -> DataFrame:
    """One row: modules, edges, mean degree."""
    per_node = coupling(edges)
    return per_node.agg(
        F.count("*").alias("total_modules"),
        F.sum("efferent").alias("total_edges"),
        (F.sum(F.col("afferent") + F.col("efferent")) / F.count("*")).alias("mean_degree"),
    )


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each name: first known path, least depth, excluded if any copy is."""
    return nodes.groupBy("name").agg(
        F.min("path").alias("path"), F.min("depth").alias("depth"), F.bool_or("excluded").alias("excluded")
    )


def strengths(edges: DataFrame) -> DataFrame:
    """Distinct named edges (src, dst, src_name, dst_name) with strength."""
    edges = materialise(edges.select("src", "dst", "src_name", "dst_name"), "strengths")
    total = edges.count()
    per_node = coupling(spread(edges.select("src", "dst"), total, "src", "dst"), distinct=True)
    out = per_node.select(F.col("entity").alias("src"), F.col("efferent").alias("ce"))
    into = per_node.select(F.col("entity").alias("dst"), F.col("afferent").alias("ca"))
    value = names.edge_strength(F.col("src_name"), F.col("dst_name"), F.col("ce"), F.col("ca"))
    met = spread(spread(edges, total, "src").join(out, "src"), total, "dst").join(into, "dst")
    return met.select("src", "dst", value.alias("strength"))


def dedup_first_type(edges: DataFrame, order: list[str]) -> DataFrame:
    """One edge for each pair of ends, with the type that comes first by ``order``."""
    first = F.struct(*order, "relationship_type")
    return edges.groupBy("src", "dst").agg(
        F.min(first)["relationship_type"].alias("relationship_type"), F.count("*").alias("n_edges")
    )


def edge_counters(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: valid and invalid. Edges (src, dst) are valid if both ends are in ``nodes`` (node) and differ."""
    known = nodes.select("node").distinct()
    marked = edges.join(known.select(F.col("node").alias("src"), F.lit(True).alias("a")), "src", "left").join(
        known.select(F.col("node").alias("dst"), F.lit(True).alias("b")), "dst", "left"
    )
    valid = F.coalesce(F.col("a") & F.col("b") & (F.col("src") != F.col("dst")), F.lit(False))
    return marked.agg(F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"))
