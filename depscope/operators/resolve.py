"""Joining names to entities: merges, targets, parents, externals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depscope.scratch import materialise


def _last(rows: DataFrame, key: str, columns: list[str], order: str | None) -> DataFrame:
    """One row a key: the last by ``order``, of equals or without an order the greatest in its columns."""
    values = F.struct(*columns)
    by = values if order is None else F.struct(F.col(order), values.alias("__v"))
    return rows.groupBy(key).agg(F.max_by(values, by).alias("__x")).select(key, "__x.*")


def merge_modules(left: DataFrame, right: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """All keys of both sides, one row each; a column's value from ``right`` wins where there is one. Of several rows
    with a key on one side the last by ``order`` counts."""
    left, right = (_last(side, key, columns, order) for side in (left, right))
    r = right.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__r"))
    l = left.select(key, *columns, F.lit(True).alias("__l"))  # noqa: E741
    origin = F.when(F.col("__r") & F.col("__l"), "both").when(F.col("__r"), "right").otherwise("left")
    return l.join(r, key, "full").select(
        key, *[F.coalesce(f"__{c}", c).alias(c) for c in columns], origin.alias("origin")
    )


def _grams(ids: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(id, g): the different runs of so many characters of each id."""

    def runs(size: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length("id") - size + 1, F.lit(1)))
        return F.transform(places, lambda k: F.substring(F.col("id"), k, F.lit(size)))

    return ids.select("id", F.explode(F.array_distinct(F.concat(*map(runs, sizes)))).alias("g"))


def _containing(names: DataFrame, ids: DataFrame) -> DataFrame:
    """(name, id): the least id that contains each name, for names that some id contains.

    A name of up to three characters is a run of an id, so the least id of each run answers it. A
    longer one meets the ids that have its rarest run of three, and no others.
    """
    least = _grams(ids, (1, 2, 3)).groupBy(F.col("g").alias("name")).agg(F.min("id").alias("short"), F.count("*").alias("n"))
    long = names.where(F.length("name") > 3).select(F.col("name").alias("id"))
    asked = _grams(long, (3,)).withColumnRenamed("id", "name").join(least.select(F.col("name").alias("g"), "n"), "g", "left")
    rarest = asked.groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r"))
    met = rarest.where("r.n > 0").select("name", F.col("r.g").alias("g")).join(_grams(ids, (3,)), "g")
    met = met.where(F.contains(F.col("id"), F.col("name"))).groupBy("name").agg(F.min("id").alias("long"))
    found = names.join(least.where(F.length("name") <= 3).select("name", "short"), "name", "left").join(met, "name", "left")
    return found.select("name", F.coalesce("short", "long").alias("id")).where("id IS NOT NULL")


def resolve_targets(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, id, how): each name's node; exact name, then an id that ends in ``:name`` or, without a colon, is the name, then the
    least id that contains the name, else ``mod:name``.

    All three are equi-joins, so no name is compared with all ids, at any size.
    """
    wanted = names.select("name").where("name IS NOT NULL").distinct()
    exact = nodes.groupBy("name").agg(F.min("id").alias("exact"))
    words = F.split("id", ":")
    ends = F.transform(F.sequence(F.least(F.lit(2), F.size(words)), F.size(words)), lambda k: F.array_join(F.slice(words, k, F.size(words)), ":"))
    tails = nodes.where("id IS NOT NULL").select(F.explode(ends).alias("name"), "id")
    suffix = tails.groupBy("name").agg(F.min("id").alias("suffix"))
    known = materialise(wanted.join(exact, "name", "left").join(suffix, "name", "left"), "resolved")
    rest = known.where("exact IS NULL AND suffix IS NULL").select("name")
    inside = _containing(rest, nodes.select("id").where("id IS NOT NULL").distinct()).withColumnRenamed("id", "inside")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("suffix").isNotNull(), "suffix").when(F.col("inside").isNotNull(), "contains").otherwise("new")
    found = F.coalesce("exact", "suffix", "inside", F.concat(F.lit("mod:"), "name"))
    return known.join(inside, "name", "left").select("name", found.alias("id"), how.alias("how"))


def longest_prefix_parent(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(child, parent): the longest proper prefix of each child that is a parent's name, empty names aside.

    A child's prefixes of the lengths that parents have are joined by equality, so nothing is
    compared pair by pair. Those lengths are one array of different numbers.
    """
    known = parents.select("parent").where("parent <> ''").distinct()
    lengths = known.agg(F.sort_array(F.collect_set(F.length("parent"))).alias("n")).scalar()
    wanted = children.select("child").distinct()
    prefixes = wanted.withColumn("lengths", lengths).select(
        "child", F.explode(F.expr("filter(lengths, n -> n < length(child))")).alias("n")
    ).select("child", "n", F.expr("substring(child, 1, n)").alias("parent"))
    best = prefixes.join(known, "parent").groupBy("child").agg(F.max_by("parent", "n").alias("parent"))
    return wanted.join(best, "child", "left").select("child", "parent")


def known_edges(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """Imports (src, dst) whose target is a known node."""
    return imports.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def missing_externals(imports: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imported names that are no node, as nodes (node, external), and the edges to them."""
    edges = imports.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    return edges.select(F.col("dst").alias("node")).distinct().withColumn("external", F.lit(True)), edges.distinct()


def neighbourhood(edges: DataFrame, parents: DataFrame, node) -> DataFrame:
    """(node, role): what ``node`` is linked to, its parent, children and siblings. ``parents``: (node, parent)."""
    linked = edges.where(F.col("src") == node).select(F.col("dst").alias("node")).unionByName(
        edges.where(F.col("dst") == node).select(F.col("src").alias("node"))
    )
    own = parents.where(F.col("node") == node).select("parent")
    siblings = parents.join(own, "parent", "left_semi").where(F.col("node") != node).select("node")
    children = parents.where(F.col("parent") == node).select("node")
    tagged = [(linked, "connected"), (own.withColumnRenamed("parent", "node"), "parent"), (children, "child")]
    out = siblings.withColumn("role", F.lit("sibling"))
    for frame, role in tagged:
        out = out.unionByName(frame.withColumn("role", F.lit(role)))
    return out.where("node IS NOT NULL").distinct()
