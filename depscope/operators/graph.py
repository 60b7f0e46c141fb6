"""Reachability, hop distance and strongly connected components over edge tables (src, dst).

Large graphs shrink in levels. A level deals nodes to clusters, each around a centre and within ``HOPS`` edges of it. A
task solves clusters of at most ``most`` edges (of a task, ``EDGES`` unless given): it merges the nodes of a strong component into one, and puts
edges between the cluster's border nodes in place of all paths through its inside, where these are fewer than the
edges there. So chains, ladders and other long graphs shrink by a factor each level, whatever their length. A cluster
of more edges is solved in pieces, in which components become stars, but no node goes.

What hardly shrinks branches well, so that few hops lead everywhere. Components are found there from many pivots at once, one
in each part that no component leaves: what a pivot reaches, and what reaches it, splits its part in four. Hop distances go
by rounds, one for each hop of what is left.

When all is solved, levels are unfolded from the last to the first: each cluster is solved again with what is known of its border. There
is no limit of rounds, and a task's work is bounded whatever the graph's size: the last level, with at most
``most`` edges, is one cluster. The state between rounds is written to the shared folder. Joins and aggregates over large graphs are dealt
to tasks by the number of edges (``spread.dealt``); a ``total`` of 0 leaves that to Spark.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depscope.operators.spread import dealt
from depscope.scratch import materialise, once

#: Edges that a task solves at once.
EDGES = 20_000
#: One node of so many is a centre, and its cluster reaches so many edges far.
CENTRES, HOPS = 10, 6
#: A level is worth its cost if it leaves fewer edges than one of so many.
GAIN = 1.3
#: Tables written in rounds after which they become one, so that plans stay short.
FOLD = 8


def plain(edges: DataFrame, total: int = 0) -> DataFrame:
    """Distinct edges without loops and nulls."""
    return dealt(edges.select("src", "dst").where("src <> dst"), total, "src", "dst").distinct()


def endpoints(edges: DataFrame, total: int = 0) -> DataFrame:
    """(node): every end of an edge, loops included."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).where("node IS NOT NULL")
    return dealt(ends, 2 * total, "node").distinct()


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- in one task: a graph of bounded size, its nodes numbered in their order


def successors(n: int, src: np.ndarray, dst: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        out[a].append(b)
    return out


def tarjan(follow: list[list[int]]) -> np.ndarray:
    """The least member of each node's component; no recursion, so depth is no limit."""
    n = len(follow)
    index, low, out, stack, count = [-1] * n, [0] * n, [-1] * n, [], 0
    for root in range(n):
        if index[root] >= 0:
            continue
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        work = [(root, iter(follow[root]))]
        while work:
            at, rest = work[-1]
            for to in rest:
                if index[to] < 0:
                    index[to] = low[to] = count
                    count += 1
                    stack.append(to)
                    work.append((to, iter(follow[to])))
                    break
                if out[to] < 0:
                    low[at] = min(low[at], index[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[at])
                if low[at] == index[at]:
                    members = []
                    while not members or members[-1] != at:
                        members.append(stack.pop())
                    least = min(members)
                    for member in members:
                        out[member] = least
    return np.array(out, np.int64)


def nearest(follow: list[list[tuple[int, int]]], starts: dict[int, int]) -> dict[int, int]:
    """Distances from ``starts`` along weighted edges."""
    near, heap = dict(starts), [(d, node) for node, d in starts.items()]
    heapq.heapify(heap)
    while heap:
        d, at = heapq.heappop(heap)
        if d > near[at]:
            continue
        for to, hops in follow[at]:
            if d + hops < near.get(to, d + hops + 1):
                near[to] = d + hops
                heapq.heappush(heap, (d + hops, to))
    return near


def weighted(n: int, src: np.ndarray, dst: np.ndarray, hops: np.ndarray) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, w in zip(src.tolist(), dst.tolist(), hops.tolist(), strict=True):
        out[a].append((b, w))
    return out


def bypassed(n: int, src: np.ndarray, dst: np.ndarray, hops: np.ndarray, into: np.ndarray, out: np.ndarray) -> list[tuple[int, int, int]]:
    """Edges with the same distances from the nodes of ``into`` to those of ``out`` as all edges of one cluster give: one for each
    pair, or those of the cluster that lie on such a path, whichever are fewer."""
    ahead, behind = weighted(n, src, dst, hops), weighted(n, dst, src, hops)
    heads, tails = np.flatnonzero(into).tolist(), np.flatnonzero(out).tolist()
    if len(heads) * len(tails) <= len(src):
        turned = len(tails) < len(heads)
        ends, made = set(heads if turned else tails), []
        for start in tails if turned else heads:
            for end, d in nearest(behind if turned else ahead, {start: 0}).items():
                if end in ends and end != start:
                    made.append((end, start, d) if turned else (start, end, d))
        return made
    return between(src, dst, hops, nearest(ahead, dict.fromkeys(heads, 0)), nearest(behind, dict.fromkeys(tails, 0)))


def between(src: np.ndarray, dst: np.ndarray, hops: np.ndarray, reached: dict, reaching: dict) -> list[tuple[int, int, int]]:
    edges = zip(src.tolist(), dst.tolist(), hops.tolist(), strict=True)
    return [(a, b, w) for a, b, w in edges if a in reached and b in reaching]


def linked(n: int, src: np.ndarray, dst: np.ndarray, border: np.ndarray) -> list[tuple[int, int, int]]:
    """Edges by which the ``border`` nodes of a cluster without circles lead to each other as by all of its edges: the fewest between
    these nodes alone, or those of the cluster on a way between two of them. Every border node counts, whichever way its own edges go,
    as one that is reached inside is in the component of what it leads to outside."""
    one, ends = np.ones(len(src), np.int64), np.flatnonzero(border).tolist()
    ahead, behind = weighted(n, src, dst, one), weighted(n, dst, src, one)
    on_way = between(src, dst, one, nearest(ahead, dict.fromkeys(ends, 0)), nearest(behind, dict.fromkeys(ends, 0)))
    if len(ends) ** 2 > 4 * len(src):
        return on_way
    known = set(ends)
    leads = {at: (known & nearest(ahead, {at: 0}).keys()) - {at} for at in ends}
    made = [(a, b, 1) for a, to in leads.items() for b in to if not any(b in leads[c] for c in to)]
    return made if len(made) <= len(on_way) else on_way


class Block:
    """Whole groups of rows (g, kind, a, b, hops, part, into, out, label) in one task: edges a to b of kind 0, nodes a of kind 1."""

    def __init__(self, rows: pd.DataFrame) -> None:
        edges, nodes = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
        ends = [c for c in (edges["a"], edges["b"], nodes["a"]) if len(c)]
        codes, self.names = pd.factorize(pd.concat(ends, ignore_index=True), sort=True)
        k, self.n = len(edges), len(self.names)
        self.src, self.dst, self.at = codes[:k], codes[k : 2 * k], codes[2 * k :]
        self.edges, self.nodes = edges, nodes
        self.hops = edges["hops"].to_numpy(np.int64)

    def named(self, codes) -> np.ndarray:
        return np.asarray(self.names)[np.asarray(codes, np.int64)]

    def of_node(self, column: str) -> np.ndarray:
        """A value of each node that its edges and its own row share."""
        out = np.zeros(self.n, np.int64)
        out[self.at] = self.nodes[column].to_numpy(np.int64)
        values = self.edges[column].to_numpy(np.int64)
        out[self.src], out[self.dst] = values, values
        return out

    def flagged(self, column: str) -> np.ndarray:
        out = np.zeros(self.n, bool)
        out[self.at[self.nodes[column].to_numpy(bool)]] = True
        return out


def _blocks(frames: Iterator[pd.DataFrame], most: int) -> Iterator[Block]:
    """Groups of sorted rows, as many as make up ``most`` rows or one group."""
    held = None
    for frame in frames:
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        whole = int((held["g"] != held["g"].iloc[-1]).sum()) if len(held) >= most else 0
        if whole:
            yield Block(held.iloc[:whole])
            held = held.iloc[whole:]
    if held is not None and len(held):
        yield Block(held)


def _contract(block: Block, merge: bool) -> tuple[list, list]:
    """(a, b, hops, part) of the edges that stand for the block's, and (node, name) of nodes merged into another."""
    n, part = block.n, block.of_node("part")
    big = np.zeros(n, bool)
    wide = block.edges["into"].to_numpy(bool)  # of a piece of a cluster: all its nodes stay
    big[block.src[wide]] = big[block.dst[wide]] = True
    comp = tarjan(successors(n, block.src, block.dst)) if merge else np.arange(n)
    stars = np.flatnonzero(big & (comp != np.arange(n)))
    edges = [(int(a), int(b), 1, int(part[a])) for k in stars.tolist() for a, b in ((k, comp[k]), (comp[k], k))]
    keys = np.stack([comp[block.src], comp[block.dst]], axis=1)
    order = np.lexsort((block.hops, keys[:, 1], keys[:, 0]))
    first = np.ones(len(order), bool)
    first[1:] = (keys[order][1:] != keys[order][:-1]).any(axis=1)
    rows = order[first & (keys[order, 0] != keys[order, 1])]
    edges += [(int(keys[k, 0]), int(keys[k, 1]), int(block.hops[k]), int(part[comp[block.src[k]]])) for k in rows[wide[rows]].tolist()]
    rows = rows[~wide[rows]]
    into, out = np.zeros(n, bool), np.zeros(n, bool)
    into[comp[block.flagged("into")]] = True
    out[comp[block.flagged("out")]] = True
    group = block.edges["g"].to_numpy()[rows]
    for one in np.split(rows[np.argsort(group, kind="stable")], np.flatnonzero(np.diff(np.sort(group))) + 1):
        if not len(one):
            continue
        inner, local = np.unique(keys[one], return_inverse=True)
        local = local.reshape(-1, 2)
        ends = (len(inner), local[:, 0], local[:, 1])
        made = linked(*ends, into[inner] | out[inner]) if merge else bypassed(*ends, block.hops[one], into[inner], out[inner])
        edges += [(int(inner[a]), int(inner[b]), w, int(part[inner[a]])) for a, b, w in made]
    merged = np.flatnonzero((comp != np.arange(n)) & ~big)
    return edges, [(int(k), int(comp[k])) for k in merged]


def _made(block: Block, columns: dict[str, list | np.ndarray], nodes: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: block.named(v) if c in nodes else v for c, v in columns.items()})


def _in_blocks(rows: list[DataFrame], solve: Callable[[Block], pd.DataFrame], schema: T.StructType, most: int, total: int = 0) -> DataFrame:
    """``solve`` over the groups of ``rows``; each group is in one task."""
    kind = rows[0].schema["a"].dataType
    full = {"g": "long", "kind": "int", "a": kind, "b": kind, "hops": "long", "part": "long", "into": "boolean", "out": "boolean", "label": kind, "depth": "long"}
    # no nulls, which would make numbers floating
    default = {"hops": F.lit(1), "part": F.lit(0), "into": F.lit(False), "out": F.lit(False), "b": F.col("a"), "label": F.col("a"), "depth": F.lit(0)}
    shaped = [r.select(*[(F.col(c) if c in r.columns else default[c]).cast(t).alias(c) for c, t in full.items()]) for r in rows]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(frames, most):
            yield solve(block)

    together = _union(shaped)
    grouped = dealt(together, total, "g")
    grouped = together.repartition("g") if grouped is together else grouped
    return grouped.sortWithinPartitions("g").mapInPandas(run, schema)


# --- levels


class Level:
    """One level of ``total`` edges: ``dealt`` has them with the group that they are inside of, ``merged`` the nodes that became another's."""

    def __init__(self, dealt: DataFrame, merged: DataFrame, rest: DataFrame, total: int) -> None:
        self.dealt, self.merged, self.rest, self.total = dealt, merged, rest, total

    def inner(self) -> DataFrame:
        """Edges of the clusters that were solved whole."""
        return self.dealt.where("g IS NOT NULL AND NOT big").select("g", F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "hops")

    def nodes(self) -> DataFrame:
        """(g, node) of those clusters."""
        ends = self.dealt.where("g IS NOT NULL AND NOT big").select("g", F.explode(F.array("src", "dst")).alias("node"))
        return dealt(ends, 2 * self.total, "g", "node").distinct()


def clusters(links: DataFrame, seed: int, total: int = 0) -> DataFrame:
    """(node, centre) of the nodes within HOPS edges of a centre: the nearest, of several the least."""
    ends = endpoints(links, total)
    loops = ends.select("node", F.col("node").alias("other"), F.lit(0).alias("far"))
    one = F.lit(1).alias("far")
    both = _union([loops, links.select(F.col("src").alias("node"), F.col("dst").alias("other"), one), links.select(F.col("dst").alias("node"), F.col("src").alias("other"), one)])
    near = ends.where(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(CENTRES)) == 0).select(F.col("node").alias("other"), F.struct(F.lit(0).alias("hops"), F.col("node").alias("centre")).alias("c"))
    for _ in range(HOPS):
        offer = F.struct((F.col("c.hops") + F.col("far")).alias("hops"), F.col("c.centre").alias("centre"))
        offers = dealt(both, 2 * total, "other").join(near, "other").select("node", offer.alias("offer"))
        near = dealt(offers, 2 * total, "node").groupBy("node").agg(F.min("offer").alias("c")).withColumnRenamed("node", "other")
    return near.select(F.col("other").alias("node"), "c.centre")


def _level(links: DataFrame, seed: int, merge: bool, most: int, total: int, keep: DataFrame | None = None) -> Level:
    """The next level of ``links`` (src, dst, hops, part), ``total`` edges; nodes of ``keep`` stay."""
    near = materialise(clusters(links, seed, total), "graph-clusters")
    ends = links
    for end in ("src", "dst"):
        own = near.select(F.col("node").alias(end), F.col("centre").alias(f"c_{end}"))
        ends = dealt(ends, total, end).join(own, end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))
    inside = F.col("c_src") == F.col("c_dst")
    ends = materialise(ends.select("src", "dst", "hops", "part", F.xxhash64("c_src").alias("gs"), F.xxhash64("c_dst").alias("gd"), inside.alias("inside")), "graph-ends")
    wide = ends.where("inside").groupBy("gs").count().where(F.col("count") > most).select("gs", F.ceil(F.col("count") / most).alias("pieces"))
    piece = F.xxhash64("gs", F.pmod(F.xxhash64("src", "dst"), F.col("pieces")))
    g = F.when(F.col("inside"), F.when(F.col("pieces").isNull(), F.col("gs")).otherwise(piece))
    # there are fewer wide clusters than one for each ``most`` edges
    grouped = ends.join(F.broadcast(wide), "gs", "left").select("src", "dst", "hops", "part", "gs", "gd", g.alias("g"), F.col("pieces").isNotNull().alias("big"))
    grouped = materialise(grouped, "graph-dealt")

    cross = grouped.where("g IS NULL")
    yes, no = F.lit(True), F.lit(False)
    flags = [cross.select(F.col("gd").alias("g"), F.col("dst").alias("a"), yes.alias("into"), no.alias("out")), cross.select(F.col("gs").alias("g"), F.col("src").alias("a"), no.alias("into"), yes.alias("out"))]
    if keep is not None:
        own = keep.join(near, "node", "left").select(F.xxhash64(F.coalesce("centre", "node")).alias("g"), F.col("node").alias("a"), yes.alias("into"), no.alias("out"))
        flags.append(own)
    border = dealt(_union(flags), 2 * total, "g", "a").groupBy("g", "a").agg(F.max("into").alias("into"), F.max("out").alias("out")).withColumn("kind", F.lit(1))
    inner = grouped.where("g IS NOT NULL").select("g", F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "hops", "part", F.col("big").alias("into"))
    kind = links.schema["src"].dataType
    schema = T.StructType([T.StructField("merged", T.BooleanType()), T.StructField("src", kind), T.StructField("dst", kind), T.StructField("hops", T.LongType()), T.StructField("part", T.LongType())])

    def solve(block: Block) -> pd.DataFrame:
        edges, merged = _contract(block, merge)
        rows = [(False, *e) for e in edges] + [(True, a, b, 0, 0) for a, b in merged]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return _made(block, dict(zip(schema.names, columns, strict=True)), ["src", "dst"])

    made = materialise(_in_blocks([inner, border], solve, schema, most, 2 * total), "graph-made")
    merged = made.where("merged").select(F.col("src").alias("node"), F.col("dst").alias("name"))
    outside = cross.select("src", "dst", "hops", "part")
    for end in ("src", "dst"):
        outside = dealt(outside, total, end).join(merged.select(F.col("node").alias(end), "name"), end, "left").withColumn(end, F.coalesce("name", end)).drop("name")
    rest = made.where("NOT merged").select("src", "dst", "hops", "part").unionByName(outside.where("src <> dst"))
    rest = dealt(rest, total, "src", "dst", "part").groupBy("src", "dst", "part").agg(F.min("hops").alias("hops")).select("src", "dst", "hops", "part")
    return Level(grouped, merged, materialise(rest, "graph-rest"), total)


# --- hop distance


def hop_distance(edges: DataFrame, roots: DataFrame, furthest: int = 0, most: int = EDGES) -> DataFrame:
    """(node, depth) of all nodes: hops from the nearest of ``roots`` (node), null if unreached.

    ``furthest`` bounds the hops; 0 is unlimited. A root that has no edge counts as a node.
    """
    one, none = F.lit(1).cast("long").alias("hops"), F.lit(0).cast("long")
    edges = once(edges, "hops-given")
    total = edges.count()
    rest = materialise(plain(edges, total).select("src", "dst", one, none.alias("part")), "hops-edges")
    starts = materialise(roots.select("node").where("node IS NOT NULL").distinct(), "hops-roots")
    nodes = dealt(endpoints(edges, total).unionByName(starts), 2 * total, "node").distinct()
    levels: list[Level] = []
    count, near = rest.count(), starts.withColumn("depth", none)
    if count > most:  # if it branches well, few rounds reach all
        near, done = _hops_by_rounds(rest, near, furthest, count, FOLD)
        if done:
            near = near.where(F.col("depth") <= furthest) if furthest else near
            return nodes.join(near, "node", "left").select("node", "depth")
        near = starts.withColumn("depth", none)
    while count > most:
        level = _level(rest, len(levels), False, most, count, starts)
        left = level.rest.count()
        if left * GAIN > count:
            break
        levels.append(level)
        rest, count = level.rest, left
    if count <= most:
        near = materialise(_near_inside(rest.withColumn("g", none), near.withColumn("g", none), most), "hops")
    else:
        near, _ = _hops_by_rounds(rest, near, furthest, count)
    for level in reversed(levels):
        known = near.join(level.nodes(), "node").select("g", "node", "depth")
        found = _near_inside(level.inner().withColumnsRenamed({"a": "src", "b": "dst"}), known, most, level.total)
        near = materialise(dealt(near.unionByName(found), 2 * level.total, "node").groupBy("node").agg(F.min("depth").alias("depth")), "hops")
    near = near.where(F.col("depth") <= furthest) if furthest else near
    return nodes.join(near, "node", "left").select("node", "depth")


def _near_inside(links: DataFrame, known: DataFrame, most: int, total: int = 0) -> DataFrame:
    """(node, depth) of what the ``known`` (g, node, depth) lead to inside their groups of ``links`` (g, src, dst, hops)."""
    kind = known.schema["node"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("depth", T.LongType())])

    def solve(block: Block) -> pd.DataFrame:
        follow = weighted(block.n, block.src, block.dst, block.hops)
        starts: dict[int, int] = {}
        for node, depth in zip(block.at.tolist(), block.nodes["depth"].tolist(), strict=True):
            starts[node] = min(int(depth), starts.get(node, int(depth)))
        near = nearest(follow, starts)
        return _made(block, {"node": list(near), "depth": list(near.values())}, ["node"])

    rows = [links.select("g", F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "hops"), known.select("g", F.lit(1).alias("kind"), F.col("node").alias("a"), "depth")]
    return _in_blocks(rows, solve, schema, most, 2 * total)


def _hops_by_rounds(links: DataFrame, starts: DataFrame, furthest: int, total: int, rounds: int = 0) -> tuple[DataFrame, bool]:
    """(node, depth), and whether that is all; there are ``total`` ``links``. Each round follows the edges of the nodes that the last one came to, or came
    nearer to; ``rounds`` over 0 ends them after so many."""
    frontier = materialise(starts, "hops")
    parts, done = [frontier], 0
    while not (empty := frontier.isEmpty()) and (not rounds or done < rounds):
        done += 1
        ahead = dealt(links, total, "src").join(frontier.select(F.col("node").alias("src"), "depth"), "src")
        step = dealt(ahead, total, "dst").groupBy(F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("hops")).alias("depth"))
        known = _nearest(parts).select("node", F.col("depth").alias("before"))
        step = step.join(known, "node", "left").where("before IS NULL OR depth < before").select("node", "depth")
        frontier = materialise(step.where(F.col("depth") <= furthest) if furthest else step, "hops")
        parts.append(frontier)
        if len(parts) > FOLD:
            parts = [materialise(_nearest(parts), "hops")]
    return materialise(_nearest(parts), "hops"), empty


def _nearest(parts: list[DataFrame]) -> DataFrame:
    out = _union(parts)
    return out.groupBy("node").agg(F.min("depth").alias("depth")) if len(parts) > 1 else out


def reachable(edges: DataFrame, roots: DataFrame, most: int = EDGES) -> DataFrame:
    """(node): everything that ``roots`` lead to, roots included."""
    return hop_distance(edges, roots, most=most).where("depth IS NOT NULL").select("node")


# --- strong components


def strong_components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """(node, scc) for every node; scc is the least node of its component."""
    one, none = F.lit(1).cast("long").alias("hops"), F.lit(0).cast("long")
    edges = once(edges, "scc-given")
    total = edges.count()
    rest = materialise(plain(edges, total).select("src", "dst", one, none.alias("part")), "scc-edges")
    steps: list[Level | DataFrame] = []
    count = rest.count()
    while count > most:
        rest, count = _trimmed(rest, count, most)
        if count <= most:
            break
        level = _level(rest, len(steps), True, most, count)
        left = level.rest.count()
        steps.append(level)
        if left * GAIN > count:
            found, cut = _by_pivots(level.rest, left)
            steps.append(found)
            rest, count = cut, cut.count()
        else:
            rest, count = level.rest, left
    labels = _components_inside(rest.withColumn("g", none), None, most)
    for step in reversed(steps):
        labels = materialise(labels, "scc")
        if isinstance(step, DataFrame):
            labels = labels.unionByName(step)
            continue
        members = labels.unionByName(step.merged.join(labels.withColumnRenamed("node", "name"), "name").select("node", "scc"))
        members = materialise(members, "scc")
        known = members.join(step.nodes(), "node").select("g", "node", "scc")
        inside = materialise(_components_inside(step.inner().withColumnsRenamed({"a": "src", "b": "dst"}), known, most, step.total), "scc")
        labels = inside.unionByName(members.join(inside.select("node"), "node", "left_anti"))
    return endpoints(edges, total).join(_least_named(materialise(labels, "scc")), "node", "left").select("node", F.coalesce("scc", "node").alias("scc"))


def _trimmed(links: DataFrame, count: int, most: int) -> tuple[DataFrame, int]:
    """``links`` without edges whose beginning nothing leads to or whose end leads nowhere, as long as a tenth of them goes."""
    while True:
        led = dealt(links.select(F.col("dst").alias("src")), count, "src").distinct()
        inner = materialise(dealt(links, count, "src").join(led, "src", "left_semi"), "scc-led")
        n_led = inner.count()  # what an edge left here leads to keeps its own edges, so these tell which ends lead on
        leading = dealt(inner.select(F.col("src").alias("dst")), n_led, "dst").distinct()
        inner = dealt(inner, n_led, "dst").join(leading, "dst", "left_semi")
        links, before = materialise(inner.select("src", "dst", "hops", "part"), "scc-edges"), count
        count = links.count()
        if count <= most or count > 0.9 * before:
            return links, count


def _named_components(block: Block) -> pd.DataFrame:
    """(node, scc) of a block whose nodes with one label are in one component; one without a label is named by its least node."""
    follow = successors(block.n, block.src, block.dst)
    label, first, last = {}, {}, {}
    for node, key in zip(block.at.tolist(), zip(block.nodes["g"].tolist(), block.nodes["label"].tolist(), strict=True), strict=True):
        label[node] = key[1]
        if key in last:
            follow[last[key]].append(node)
        first.setdefault(key, node)
        last[key] = node
    for key, node in last.items():
        follow[node].append(first[key])
    comp = tarjan(follow).tolist()
    given = {comp[node]: name for node, name in label.items()}
    names = block.named(comp).tolist()
    return pd.DataFrame({"node": block.named(np.arange(block.n)), "scc": [given.get(c, name) for c, name in zip(comp, names, strict=True)]})


def _components_inside(links: DataFrame, known: DataFrame | None, most: int, total: int = 0) -> DataFrame:
    """(node, scc) of each group of ``links`` (g, src, dst), where the nodes of ``known`` (g, node, scc) with one scc are in one component."""
    kind = links.schema["src"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("scc", kind)])

    rows = [links.select("g", F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))]
    if known is not None:
        rows.append(known.select("g", F.lit(1).alias("kind"), F.col("node").alias("a"), F.col("scc").alias("label")))
    return _in_blocks(rows, _named_components, schema, most, 2 * total)


def _least_named(found: DataFrame) -> DataFrame:
    """``found`` (node, scc) with each component named by its least node."""
    least = found.groupBy("scc").agg(F.min("node").alias("least")).where("least <> scc")
    return found.join(least, "scc", "left").select("node", F.coalesce("least", "scc").alias("scc"))


def _by_pivots(links: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(node, scc) of the components of one pivot in each part, and the ``links``, of ``total``, that are left between nodes of one new part.

    A pivot is a node of its part with many edges in and out. A round goes a hop forward from all pivots and a
    hop backward, inside their parts."""
    ways = materialise(
        links.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.lit(1).alias("way"), "part").unionByName(
            links.select(F.col("dst").alias("node"), F.col("src").alias("to"), F.lit(2).alias("way"), "part")
        ),
        "scc-ways",
    )
    degree = dealt(ways, 2 * total, "part", "node").groupBy("part", "node").agg(F.count_if(F.col("way") == 1).alias("o"), F.count_if(F.col("way") == 2).alias("i"))
    pivots = degree.groupBy("part").agg(F.max_by("node", F.struct(F.col("o").cast("double") * F.col("i"), "node")).alias("pivot"))
    frontier = materialise(pivots.select(F.col("pivot").alias("node"), F.explode(F.array(F.lit(1), F.lit(2))).alias("way"), "pivot"), "scc-reach")
    seen = [frontier]
    while not frontier.isEmpty():
        step = dealt(ways, 2 * total, "node", "way").join(frontier, ["node", "way"]).select(F.col("to").alias("node"), "way", "pivot")
        step = dealt(step, 2 * total, "node", "way").distinct()
        frontier = materialise(step.join(_union(seen), ["node", "way"], "left_anti"), "scc-reach")
        seen.append(frontier)
        if len(seen) > FOLD:
            seen = [materialise(_union(seen), "scc-reach")]
    met = materialise(_union(seen).groupBy("node").agg(F.sum("way").alias("met"), F.max("pivot").alias("scc")), "scc-met")
    left = links
    for end in ("src", "dst"):
        own = met.select(F.col("node").alias(end), F.col("met").alias(f"m_{end}"))
        left = dealt(left, total, end).join(own, end, "left").withColumn(f"m_{end}", F.coalesce(f"m_{end}", F.lit(0)))
    left = left.where("m_src = m_dst AND m_src < 3").select("src", "dst", "hops", F.xxhash64("part", "m_src").alias("part"))
    return met.where("met = 3").select("node", "scc"), materialise(left, "scc-edges")
