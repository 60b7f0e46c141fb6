"""The five levels as one node table, and views of it. Nodes: id, name, level, kind, parent_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depscope.operators.ranking import with_rank
from depscope.scratch import materialise

LEVELS = ("package", "module", "class", "method", "field")


def graph_nodes(levels: dict[str, DataFrame]) -> DataFrame:
    """One table from a frame (id, name, parent_id) for each kind; a node without an id is named by its
    name, and without both by its kind and a number."""
    out = None
    for level, kind in enumerate(LEVELS):
        if kind in levels:
            made = F.concat(F.lit(f"{kind}_"), F.monotonically_increasing_id().cast("string"))
            own = levels[kind].select(
                F.coalesce(F.col("id"), F.col("name"), made).alias("id"),
                "name",
                F.lit(level).alias("level"),
                F.lit(kind).alias("kind"),
                "parent_id",
            )
            out = own if out is None else out.unionByName(own)
    return out


def entity_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def orphans(nodes: DataFrame) -> DataFrame:
    """Nodes that name no parent or one that isn't there: the roots of the view."""
    ids = nodes.select(F.col("id").alias("parent_id")).distinct()
    return nodes.join(ids, "parent_id", "left_anti")


def childless(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """Nodes that none of ``children`` (parent_id) names as its parent."""
    return nodes.join(children.select(F.col("parent_id").alias("id")), "id", "left_anti")


def super_nodes(nodes: DataFrame, level: int, least: int = 2) -> DataFrame:
    """Groups below ``level``: (level, parent_id, n_children), from ``least`` children up."""
    return (
        nodes.where(F.col("level") > level)
        .groupBy("level", "parent_id")
        .agg(F.count("*").alias("n_children"))
        .where(F.col("n_children") >= least)
    )


def clusters(nodes: DataFrame) -> DataFrame:
    """(container, n_members, first_member, last_member); members stay rows of ``nodes``."""
    return (
        nodes.where("parent_id IS NOT NULL")
        .groupBy(F.col("parent_id").alias("container"))
        .agg(F.count("*").alias("n_members"), F.min("id").alias("first_member"), F.max("id").alias("last_member"))
    )


def tree_counts(nodes: DataFrame) -> DataFrame:
    """Counts by kind, and the total with a null kind."""
    return nodes.rollup("kind").agg(F.count("*").alias("n"))


def tree_search(nodes: DataFrame, query: str) -> DataFrame:
    """(id, kind, matched) of the nodes whose name holds ``query`` whatever the case, and of all their ancestors.

    Hits climb by one join a level with the levels above alone, so the lowest and largest level is
    read once. A node's parent has a lower level than the node.
    """
    matched = F.contains(F.lower("name"), F.lit(query.lower()))
    # each level's hits are written, as the next level and the result both read them
    hits = materialise(nodes.where(matched).select("id", "kind", matched.alias("matched"), "parent_id"), "tree-hits")
    out = hits
    for level in range(len(LEVELS) - 2, -1, -1):
        wanted = hits.select(F.col("parent_id").alias("id")).where("id IS NOT NULL").distinct()
        above = nodes.where(F.col("level") <= level).join(wanted, "id", "left_semi")
        hits = materialise(above.select("id", "kind", matched.alias("matched"), "parent_id"), "tree-hits")
        out = out.unionByName(hits)
    return out.select("id", "kind", "matched").distinct()


def tree_order(nodes: DataFrame) -> DataFrame:
    """``nodes`` with position among their siblings: by level, then name as a reader expects it, then id.

    Names are compared by Unicode's collation: letters first, then accents, then case, small before capital."""
    own = Window.partitionBy("parent_id").orderBy("level", F.collate("name", "UNICODE"), "name", "id")
    return nodes.withColumn("position", F.row_number().over(own))


def circle(nodes: DataFrame, order: Column, groups: int = 3, radius: float = 10.0) -> DataFrame:
    """``nodes`` with rank, x, y and z on a circle; its radius grows with the rank modulo ``groups``.

    Ranks come from ranges of ``order``, so no task holds all nodes.
    """
    ranked, total = with_rank(nodes, [order])
    angle = 2 * F.pi() * F.col("rank") / F.lit(max(1, total))
    far = radius * (1 + F.pmod("rank", F.lit(groups)))
    return ranked.withColumns(
        {"x": F.cos(angle) * far, "y": F.pmod("rank", F.lit(groups)).cast("double"), "z": F.sin(angle) * far}
    )


def dependency_matrix(edges: DataFrame, members: DataFrame, most: int = 10) -> DataFrame:
    """(src, dst, n, relationship_type) for every pair of the ``most`` first members (node).

    Only edges between those are counted; cells are ``most`` squared.
    """
    first = materialise(members.select("node").distinct().orderBy("node").limit(most), "matrix-members")
    ends = [F.broadcast(first.select(F.col("node").alias(c))) for c in ("src", "dst")]
    cells = ends[0].crossJoin(ends[1])
    inner = edges.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi")
    found = inner.groupBy("src", "dst").agg(
        F.count("*").alias("n"), F.min("relationship_type").alias("relationship_type")
    )
    return cells.join(found, ["src", "dst"], "left").select(
        "src", "dst", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "relationship_type"
    )


def matrix_summary(matrix: DataFrame) -> DataFrame:
    """One row: total off the diagonal, greatest row sum, mean per member."""
    rows = matrix.where("src <> dst").groupBy("src").agg(F.sum("n").alias("n"))
    return rows.agg(
        F.sum("n").alias("total"), F.max("n").alias("most_in_row"), (F.sum("n") / F.count("*")).alias("mean_per_member")
    )


def in_out_panel(edges: DataFrame, shown: int = 2) -> DataFrame:
    """(node, n_out, n_in, first_out, first_in): degrees, and the least ``shown`` names on each side.

    Edges are counted by pair before anything else, and of a side's pairs only ``shown`` are kept
    by rank, so a node with many neighbours is never one list.
    """
    pairs = edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.count("*").alias("n"))
    sides = pairs.select(F.col("src").alias("node"), F.lit("out").alias("side"), F.col("dst").alias("other"), "n").unionByName(
        pairs.select(F.col("dst").alias("node"), F.lit("in").alias("side"), F.col("src").alias("other"), "n")
    )
    totals = sides.groupBy("node").agg(
        *[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(f"n_{s}") for s in ("out", "in")]
    )
    rank = F.row_number().over(Window.partitionBy("node", "side").orderBy("other"))
    few = sides.withColumn("rank", rank).where(F.col("rank") <= shown)

    def firsts(side: str) -> Column:
        own = F.collect_list(F.when(F.col("side") == side, F.col("other")))
        return F.array_join(F.sort_array(own).cast("array<string>"), ",").alias(f"first_{side}")

    return totals.join(few.groupBy("node").agg(firsts("out"), firsts("in")), "node")
