"""Connected components of an undirected edge table, as a driver loop over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.scratch import materialise


def _star(pairs: DataFrame) -> DataFrame:
    """(node, low): the least of each node's neighbours; combined before the shuffle."""
    return pairs.groupBy("node").agg(F.min("other").alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its least node.

    Alternating large and small stars: every round links neighbours to the least one they
    share. A round is two aggregations and two joins; rounds grow with the logarithm of the
    largest component's diameter. Null ends are ignored, self loops and repeats do no harm.
    """
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL")
    current = materialise(
        ends.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(),
        "components",
    )
    state = None
    while True:
        both = current.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(
            current.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
        )
        # large star: each larger neighbour, to the least of the node and its neighbours
        low = _star(both).select("node", F.least("node", "low").alias("low"))
        large = (
            both.where("other > node")
            .join(low, "node")
            .select(F.col("other").alias("hi"), F.col("low").alias("lo"))
            .where("hi <> lo")
            .distinct()
        )
        large = materialise(large, "components")
        # small star: each node and its smaller neighbours, to the least of them
        low = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("low"))
        linked = large.withColumnRenamed("hi", "node").join(low, "node")
        small = linked.select(F.col("lo").alias("hi"), F.col("low").alias("lo")).unionByName(
            low.select(F.col("node").alias("hi"), F.col("low").alias("lo"))
        )
        current = materialise(small.where("hi <> lo").distinct(), "components")
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots).distinct()
