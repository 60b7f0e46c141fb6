"""Near-duplicates by SimHash: fingerprints, vantage-point trees over them, components.

Of two fingerprints within radius r one half differs in r // 2 bits at most, so there is a tree for
each half of the bits, searched with that radius. A tree routes fingerprints to shards by Hamming
distance. A node has a vantage point and a slice of the half's bits that no node above it uses; its
children are ranges of the distance between a fingerprint's slice and the vantage point's. By the
triangle inequality two fingerprints whose slice distances differ by k differ in k bits of that slice
at least, and as slices are disjoint these bounds add up along a path: a search enters a child only
while the sum stays within its radius. Few shards are told apart best by a whole half, more by more
and narrower slices. A fingerprint has one home shard a tree and is also sent to the later shards
that its search enters, so every pair within r meets in a shard of one tree. What it costs: a
search of a whole fingerprint with radius 3 would enter 126 of 18,000 shards on average; both halves
together enter about a tenth of that (figures in the README).
A leaf that holds more than its share, when all slices are used or the tree may not grow, is dealt to
several shards by hash, and a search enters those from its own on.
A shard goes on with the same bounds in memory, compares exactly at the leaves, and gives out
a spanning forest of its links rather than the links, so a dense group costs no more
than its members. Components join the shards' forests.

The trees are fitted to a bounded sample (``sample``, ``max_leaves``), which only sets how even
the shards are; every fingerprint is indexed and searched.

Defined results: a null text is empty and has fingerprint zero, linked like any other;
rows with equal texts are linked; a null doc_id never names a component (a component of
nulls only has a null id); repeated rows each get a result; an empty table gives an empty result.
A very long text is hashed whole in its task, and its bits are counted in blocks of shingles.
Other columns stay, but for an input column named as a result column, which gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depscope.llm.arrow import add_columns
from depscope.operators.components import components
from depscope.scratch import materialise

SEED = 42
SHINGLE = 3
WEIGHTS = (1 << np.arange(63, -1, -1, dtype=np.uint64)).astype(np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint over word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and blanks only
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        hashes = np.array([digest(join(words), SEED)], dtype=np.uint64)
    else:
        lists = [words[k:] for k in range(shingle)]
        hashes = np.fromiter((digest(join(t), SEED) for t in zip(*lists, strict=False)), np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bits are set in over half of ``hashes``."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.uint32)
    return int(WEIGHTS[2 * ones > len(hashes)].sum(dtype=np.uint64).astype(np.int64))


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, drop: bool = False) -> DataFrame:
    """``docs`` with fp, the fingerprint as a signed long."""

    def compute(values: list[str | None]) -> list[list]:
        return [[fingerprint(v, shingle) for v in values]]

    return add_columns(docs, text, [("fp", T.LongType())], compute, drop=drop)


HALF = 32


def slice_distance(points: np.ndarray, vantage: int, cut: int, width: int) -> np.ndarray:
    """Differing bits among the ``width`` ones from bit ``cut`` up."""
    mask = np.uint64(((1 << width) - 1) << cut)
    return np.bitwise_count((points ^ np.uint64(vantage)) & mask).astype(np.int16)


def slice_width(shards: float) -> int:
    """The widest slices of a half that tell ``shards`` apart: each splits random points into about as
    many even parts as the deviation of its distance allows."""
    width = HALF
    while width > 4 and (2 * (np.pi * width / 4) ** 0.5) ** (HALF // width) < shards:
        width //= 2
    return width


@dataclass
class Node:
    """An inner node has a vantage point, a slice and children by distance, (low, high, node); a leaf has its first shard
    and how many there are."""

    shard: int = -1
    parts: int = 1
    vantage: int = 0
    cut: int = -1
    width: int = HALF
    children: tuple = ()


def best_cut(sample: np.ndarray, unused: list[int], width: int, tries: int = 3) -> tuple[int, int]:
    """The unused slice and vantage point whose distances spread the sample best."""
    best = (np.inf, 0, 0)
    for cut in unused:
        for vantage in sample[:: max(1, len(sample) // tries)][:tries].tolist():
            shares = np.bincount(slice_distance(sample, vantage, cut, width)) / len(sample)
            best = min(best, (float(shares @ shares), cut, vantage))
    return best[1], best[2]


def ranges(counts: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Neighbouring distances taken together until each range has ``least`` of the sample."""
    out, low, held = [], 0, 0
    for d, n in enumerate(counts.tolist()):
        held += n
        if held >= least:
            out.append((low, d))
            low, held = d + 1, 0
    if low < len(counts):
        out[-1:] = [(out[-1][0] if out else 0, len(counts) - 1)]
    return out


def fit_tree(sample: np.ndarray, most: float, first: int = 0, split: float = np.inf, half: int = 0) -> tuple[Node, int]:
    """A tree over ``half`` 0 or 1 of the bits whose leaves hold at most ``most`` of the sample where slices allow; shards
    count from ``first``, one for each ``split`` of a leaf's sample. Returns the next free shard, too."""
    count = first
    width = slice_width(len(sample) / most)

    def grow(points: np.ndarray, unused: list[int]) -> Node:
        nonlocal count
        if len(points) <= most or not unused:
            parts = max(1, int(np.ceil(len(points) / split)))
            count += parts
            return Node(count - parts, parts)
        cut, vantage = best_cut(points, unused, width)
        d = slice_distance(points, vantage, cut, width)
        rest = [k for k in unused if k != cut]
        parts = ranges(np.bincount(d, minlength=width + 1), most / 2)
        children = tuple((low, high, grow(points[(d >= low) & (d <= high)], rest)) for low, high in parts)
        return Node(-1, 1, vantage, cut, width, children)

    tree = grow(np.sort(sample.astype(np.uint64)), list(range(half * HALF, (half + 1) * HALF, width)))
    return tree, count


def route(node: Node, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indices of points, whether at home) for each shard that a search enters: of the shards at home the one
    that a point is dealt to and those behind it."""
    stack = [(node, np.arange(len(points)), np.full(len(points), radius, np.int16))]
    while stack:
        at, idx, left = stack.pop()
        if not len(idx):
            continue
        if at.cut < 0:
            home = left == radius  # the full radius is left at home only, as ranges don't overlap
            own = (points[idx] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % at.parts
            for part in range(at.parts):
                enters = ~home | (own <= part)
                yield at.shard + part, idx[enters], (home & (own == part))[enters]
            continue
        d = slice_distance(points[idx], at.vantage, at.cut, at.width)
        for low, high, child in at.children:
            rest = left - np.maximum(0, np.maximum(low - d, d - high))
            stack.append((child, idx[rest >= 0], rest[rest >= 0]))


def visits(tree: Node, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indices of points, whether at home) of each point's home shard and the later ones that its search enters."""
    entered = list(route(tree, points, radius))
    first = np.full(len(points), -1, np.int64)
    for shard, idx, home in entered:
        first[idx[home]] = shard
    for shard, idx, home in entered:
        later = first[idx] <= shard
        if later.any():
            yield shard, idx[later], home[later]


def find_roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def join_links(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after joining a[i] with b[i]."""
    while True:
        parent = find_roots(parent)
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def shard_forest(
    home: np.ndarray, visitors: np.ndarray, radius: int, half: int = 0, leaf: int = 192, width: int = 8
) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) of the forest over links between ``home`` and everything in the shard whose ``half``
    differs in ``radius`` // 2 bits at most; the other tree finds the rest."""
    points = np.concatenate([home, visitors])
    parent = np.arange(len(points))
    everyone = np.arange(len(points))
    inner = list(range(half * HALF, (half + 1) * HALF, width))
    outer = [k for k in range(0, 2 * HALF, width) if k not in inner]
    stack = [(np.arange(len(home)), everyone, np.full(len(points), radius // 2, np.int16), 0)]
    while stack:
        own, seekers, left, level = stack.pop()
        if not len(own) or not len(seekers):
            continue
        if len(own) > leaf and level < len(inner) + len(outer):
            if level == len(inner):  # the bits that the near half leaves of the radius are not known: all of it
                left = np.full(len(seekers), radius, np.int16)
            vantage = int(points[own[len(own) // 2]])
            cut = (inner + outer)[level]
            d, e = (slice_distance(points[x], vantage, cut, width) for x in (own, seekers))
            for k in np.unique(d).tolist():
                rest = left - np.abs(e - k)
                stack.append((own[d == k], seekers[rest >= 0], rest[rest >= 0], level + 1))
            continue
        for at in range(0, len(own), leaf):  # more than one block only if all slices are used up
            some = own[at : at + leaf]
            for to in range(0, len(seekers), 1 << 14):
                these = seekers[to : to + (1 << 14)]
                near = np.bitwise_count(points[some][:, None] ^ points[these][None, :]) <= radius
                i, j = np.nonzero(near)
                a, b = some[i], these[j]
                parent = join_links(parent, a[a != b], b[a != b])
    parent = find_roots(parent)
    moved = np.nonzero(parent != everyone)[0]
    return points[moved], points[parent[moved]]


def links(fps: DataFrame, radius: int = 3, sample: int = 65536, target: int = 65536, max_leaves: int = 16384) -> DataFrame:
    """(a, b) edges that connect the distinct fingerprints ``fps`` (fp) as the links do.

    ``target`` fingerprints are aimed at per shard and tree, and up to twice as many are held; a leaf of more is
    several shards, as it is where a tree would need over ``max_leaves`` leaves.
    """
    spark = fps.sparkSession
    count = fps.count()
    grain = 1 << 30
    part = int(grain * min(1.0, sample / max(1, count)))
    drawn = fps.where(F.pmod(F.xxhash64("fp"), F.lit(grain)) < part).limit(2 * sample)
    points = np.array([r[0] for r in drawn.collect()], dtype=np.int64).view(np.uint64)
    share = max(1, len(points)) / max(1, count)
    most = max(target, count / max_leaves) * share
    low, second = fit_tree(points, most, 0, 2 * target * share, 0)
    high, _ = fit_tree(points, most, second, 2 * target * share, 1)
    shared = spark.sparkContext.broadcast((low, high))
    routed = T.StructType(
        [T.StructField("shard", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("home", T.BooleanType())]
    )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for tree in shared.value:
                for shard, idx, home in visits(tree, points, radius // 2):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(idx), shard, np.int32)), pa.array(points[idx].view(np.int64)), pa.array(home)],
                        names=["shard", "fp", "home"],
                    )

    def search(table: pa.Table) -> pa.Table:
        points = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy()
        half = int(table.num_rows > 0 and table.column("shard")[0].as_py() >= second)
        a, b = shard_forest(points[home], points[~home], radius, half)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return fps.mapInArrow(send, routed).groupBy("shard").applyInArrow(search, "a long, b long")


def clusters(prints: DataFrame, doc_id: str = "doc_id", radius: int = 3) -> DataFrame:
    """(fp, component, component_id) for every fingerprint of ``prints`` (doc_id, fp)."""
    least = materialise(prints.groupBy("fp").agg(F.min(f"`{doc_id}`").alias("least")), "simhash-distinct")
    linked = components(links(least.select("fp"), radius))
    labelled = least.join(linked, least["fp"] == linked["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    named = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return labelled.join(named, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``."""
    prints = with_fingerprint(docs.select(f"`{doc_id}`", f"`{text}`"), text, drop=True)
    prints = materialise(prints, "simhash-prints")
    return prints.join(clusters(prints, doc_id, radius), "fp").select(
        f"`{doc_id}`", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 3) -> DataFrame:
    """The row of ``docs`` with the least doc_id of each component, ties by a hash of the row; of rows
    equal in all columns one stays."""
    columns = [f"`{c}`" for c in docs.columns]
    marked = docs.select(F.struct(*columns).alias("row"), F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("x"), row_key(docs).alias("r"))
    prints = materialise(with_fingerprint(marked.select("d", "x", "r"), "x", drop=True), "simhash-prints")
    groups = clusters(prints.select("d", "fp"), "d", radius)
    key = F.struct(F.col("d").isNull().alias("n"), "d", "r")
    firsts = (
        prints.groupBy("fp").agg(F.min(key).alias("k")).join(groups, "fp").groupBy("component").agg(F.min("k").alias("k"))
    )
    chosen = firsts.select("k.r").distinct()
    return marked.join(chosen, "r", "left_semi").dropDuplicates(["r"]).select("row.*")


def row_key(docs: DataFrame) -> Column:
    """128 bits that name a row of ``docs`` by all its columns."""
    columns = [f"`{c}`" for c in docs.columns]
    halves = (F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns))
    return F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves]))
