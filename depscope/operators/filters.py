"""Filters of nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_noise(most: int = 200) -> Column:
    """Keeps all but pure sources and pure sinks of a degree over ``most``."""
    ca, ce = F.col("afferent"), F.col("efferent")
    return ~(((ca == 0) | (ce == 0)) & (ca + ce > most))


def within_depth(most: int) -> Column:
    """Keeps nodes reached in ``most`` hops; 0 keeps all."""
    return F.lit(True) if most <= 0 else F.coalesce(F.col("depth") <= most, F.lit(False))


def starts_with_any(name: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [name.startswith(p) for p in prefixes], F.lit(not prefixes))


def keep_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are in ``nodes`` (node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(
        nodes.select(F.col("node").alias("dst")), "dst", "left_semi"
    ).select(edges.columns)


def drop_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with no end in ``nodes`` (node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_anti").join(
        nodes.select(F.col("node").alias("dst")), "dst", "left_anti"
    ).select(edges.columns)


def outside_own_package(importer: Column, imported: Column) -> Column:
    """Keeps edges whose importer isn't inside the imported package."""
    return ~F.startswith(importer, F.concat(imported, F.lit(".")))


def visible(level: int, expanded: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes up to ``level``, and those whose parent is in ``expanded`` (id)."""
    opened = expanded.select(F.col("id").alias("parent_id")).distinct().withColumn("__open", F.lit(True))
    return (
        nodes.join(opened, "parent_id", "left")
        .where((F.col("level") <= level) | F.coalesce("__open", F.lit(False)))
        .drop("__open")
    )


def visible_edges(edges: DataFrame, shown: DataFrame) -> DataFrame:
    return keep_edges(edges, shown.select(F.col("id").alias("node"))).where("src <> dst")
