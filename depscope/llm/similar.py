"""Near-duplicates by SimHash with exact decisions: Jaccard similarity of word shingles.

Fingerprints of the shingle sets go through the vantage-point trees of ``llm/simhash.py``: what they link,
and sets of one fingerprint, are candidates. Fingerprints within any radius of bits miss some similar
pairs, so candidates come from prefixes, too: a text's distinct shingles are put in one order for all
texts, and two sets with similarity t share a shingle among the first n - ceil(t n) + 1 of each. Any
fixed order will do, and the best has rare shingles first. Shingles that are frequent in a sample of texts come
later than others; then those that more than ``rare`` heads of sets hold, counted over all texts, come last of
all, the most frequent at the end. A head is somewhat longer than a prefix, so that a set's prefix without such shingles lies in it; of the few sets
of which it doesn't, all shingles are looked at. So a passage that many texts quote makes no pairs of them.

A candidate pair is joined only if the shingle sets themselves have similarity t. Before texts move, pairs are
dropped whose sets can't have it: a sketch counts a set's hashes by range, a few to a range, and two sets
share no more than the sum of the lesser counts. First what SimHash
links, and each text that shares a prefix shingle with the least text that has it, which joins large
groups of copies at a linear cost; then the texts of a shingle that are in different groups have their sketches
compared, once for all shingles that the same texts have, and no pair is a row unless its sketches allow it. Many
texts have a shingle there only if they consist of common shingles for more than four fifths, as near copies do;
where more than ``wide`` have one, blocks of a bounded number of whole sets are compared, and only the links that
join groups come out, so a large family of near copies makes no more rows than it has members a block.

Defined results: a text of no more words than a shingle is one shingle, a null text is empty, and empty
texts equal each other; a null doc_id comes last; of rows equal in all columns one stays; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depscope.llm import simhash
from depscope.llm.arrow import add_columns
from depscope.operators.components import components
from depscope.scratch import materialise

SEED = 42
SHINGLE = 5
#: The least similarity, as numerator and denominator so that the bound is exact.
SIMILARITY = (4, 5)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and blanks only
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= width:
        return np.array([digest(join(words), SEED)], np.uint64)
    lists = [words[k:] for k in range(width)]
    return np.unique(np.fromiter((digest(join(t), SEED) for t in zip(*lists, strict=False)), np.uint64))


def ordered(own: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set in the order of all sets: by count in the sample, then hash. ``common`` is sorted."""
    often = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        often = np.where(common[at] == own, counts[at], 0)
    return own[np.lexsort((own, often))]


def prefix_size(n: int, least: tuple[int, int] = SIMILARITY) -> int:
    """Of how many first shingles a similar set must share one."""
    return n + least[0] * n // -least[1] + 1


def head_size(n: int, least: tuple[int, int] = SIMILARITY) -> int:
    """How many first shingles are looked at: all of a small set, a quarter more than a prefix of a large one."""
    return min(n, max(64, prefix_size(n, least) * 5 // 4 + 4))


def similar(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return least[1] * both >= least[0] * (len(a) + len(b) - both)


def sketch(own: np.ndarray) -> bytes:
    """How many of the hashes lie in each of 64 to 16384 even ranges, about two to four; 255 stands for more, too."""
    bits = min(14, max(6, int(len(own) - 1).bit_length() - 2))
    return np.minimum(np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def can_be_similar(a: bytes, b: bytes, n: int, m: int, least: tuple[int, int] = SIMILARITY) -> bool:
    """Whether sets of ``n`` and ``m`` hashes with these sketches may have the similarity."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if x.max() == 255 or y.max() == 255:
        return True
    if len(x) > len(y):
        x, y = y, x
    y = y.reshape(len(x), -1).sum(axis=1, dtype=np.int64)
    both = int(np.minimum(x, y).sum())
    return least[1] * both >= least[0] * (n + m - both)


def common_shingles(docs: DataFrame, text: str, width: int, sample: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found more than once in about ``sample`` texts, at most ``most`` of them, and their counts."""
    grain = 1 << 30
    part = int(grain * min(1.0, sample / max(1, docs.count())))
    drawn = docs.where(F.pmod(F.xxhash64(f"`{text}`"), F.lit(grain)) < part).select(f"`{text}`")

    def compute(values: list[str | None]) -> list[list]:
        return [[shingles(v, width).view(np.int64) for v in values]]

    found = add_columns(drawn, text, [("h", T.ArrayType(T.LongType()))], compute, drop=True)
    counted = found.select(F.explode("h").alias("h")).groupBy("h").count().where("count > 1")
    rows = counted.orderBy(F.desc("count"), "h").limit(most).collect()
    rows = sorted((r["h"] % (1 << 64), r["count"]) for r in rows)
    return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)


def promising(pairs: DataFrame, sketches: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The ``pairs`` (a, b) whose sketches don't rule similarity out. ``sketches``: (id, n, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, PIECE):
            rows = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
            yield batch.select([0, 1]).filter(pa.array([can_be_similar(x, y, n, m, least) for x, y, n, m in rows], pa.bool_()))

    left, right = (sketches.select(F.col("id").alias(e), F.col("sketch").alias(f"s{e}"), F.col("n").alias(f"n{e}")) for e in "ab")
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", "na", "nb")
    return met.mapInArrow(run, "a long, b long")


#: Rows that are Python objects at once, so that a task's memory is that of a few texts.
PIECE = 256


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: tuple[int, int]) -> DataFrame:
    """The ``pairs`` (a, b) whose texts are similar. ``texts``: (id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, PIECE):
            known: dict[int, np.ndarray] = {}
            keep = []
            a, b, x, y = (batch.column(k) for k in range(4))
            for k, (i, j) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
                for sig, values in ((i, x), (j, y)):
                    if sig not in known:
                        known[sig] = shingles(values[k].as_py(), width)
                keep.append(similar(known[i], known[j], least))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), "x")
    right = texts.select(F.col("id").alias("b"), F.col("x").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def likely_pairs(n: np.ndarray, group: np.ndarray, side: np.ndarray, sketches: list[bytes], least: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """(k, places) of sets of different groups whose sizes and sketches allow similarity; of one side and the other if
    there are two."""
    order = np.argsort(n, kind="stable")
    widths = np.array([len(x) for x in sketches])
    tables, folded, rows = {}, {}, np.zeros(len(n), np.int64)
    for width in np.unique(widths).tolist():
        own = order[widths[order] == width]
        rows[own] = np.arange(len(own))
        tables[width] = np.frombuffer(b"".join(sketches[k] for k in own.tolist()), np.uint8).reshape(len(own), width).astype(np.int16)
        folded[width] = tables[width].reshape(len(own), width // 2, 2).sum(axis=2, dtype=np.int16)
    full = np.array([255 in x for x in sketches])
    both = len(np.unique(side)) > 1
    for at, k in enumerate(order.tolist()):
        end = at + int(np.searchsorted(n[order[at:]] * least[0], n[k] * least[1], "right"))
        others = order[at + 1 : end]
        others = others[group[others] != group[k]]
        if both:
            others = others[side[others] != side[k]]
        if not len(others):
            continue
        shared = np.zeros(len(others), np.int64)
        mine = tables[widths[k]][rows[k]]
        for width in np.unique(widths[others]).tolist():
            those = widths[others] == width
            if width <= 2 * widths[k]:
                table = tables[width] if width == widths[k] else folded[width]
                shared[those] = np.minimum(table[rows[others[those]]], mine).sum(axis=1, dtype=np.int64)
            else:  # far wider only where sizes differ by more than a similar pair's
                shared[those] = n[k]
        fit = least[1] * shared >= least[0] * (n[k] + n[others] - shared)
        near = others[fit | full[k] | full[others]]
        if len(near):
            yield k, near


class Joined:
    """Groups that links join."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, group: int) -> int:
        while (up := self.above.get(group, group)) != group:
            group = up
        return group

    def join(self, a: int, b: int) -> bool:
        """Whether they weren't joined before."""
        a, b = self.root(a), self.root(b)
        self.above[max(a, b)] = min(a, b)
        return a != b


def met_in_groups(named: DataFrame, sets: DataFrame, least: tuple[int, int], block: int) -> DataFrame:
    """(a, b) of sets that share a shingle, are in different groups, and whose sketches allow similarity; or, if ``sets``
    has the whole ones, links that join the groups of all such that are similar.

    ``named``: (h, id, n, c, g) with c the group and g how many have the shingle; ``sets``: (id, sketch) and maybe whole. A
    shingle's sets are dealt to blocks of about ``block``, and a task compares two blocks at a time.
    """
    exact = "whole" in sets.columns
    rows = named.withColumn("blocks", F.ceil(F.col("g") / block)).join(sets, "id")
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    dealt = rows.withColumn("own", own).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    kept = ["id", "n", "c", "own", "sketch", *(["whole"] if exact else [])]
    dealt = dealt.select("h", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), *kept)

    def compare(held: dict[str, list]) -> pa.RecordBatch:
        ids, groups = np.array(held["id"], np.int64), held["c"]
        found = likely_pairs(*(np.array(held[c], np.int64) for c in ("n", "c", "own")), held["sketch"], least)
        joined, a, b = Joined(), [], []
        wholes = [np.frombuffer(x, np.uint64) for x in held["whole"]] if exact else []
        for k, near in found:
            for j in near.tolist():
                if exact:
                    apart = joined.root(groups[k]) != joined.root(groups[j])
                    if not (apart and similar(wholes[k], wholes[j], least)):
                        continue
                    joined.join(groups[k], groups[j])
                a.append(min(ids[k], ids[j]))
                b.append(max(ids[k], ids[j]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for batch in sliced(batches, PIECE):
            columns = batch.to_pydict()
            for k, now in enumerate(zip(columns["h"], columns["i"], columns["j"], strict=True)):
                if now != key:
                    if held and len(held["id"]) > 1:
                        yield compare(held)
                    key, held = now, {c: [] for c in kept}
                for c, values in held.items():
                    values.append(columns[c][k])
        if held and len(held["id"]) > 1:
            yield compare(held)

    placed = dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return placed.mapInArrow(run, "a long, b long").distinct()


def mixed_members(named: DataFrame) -> DataFrame:
    """(h, id, n, c, g) of the shingles whose sets are in different groups, g how many they are. ``named``: (h, id, n, c)."""
    # of shingles that the very same sets have, as those of one passage, one is enough: 128 bits name the sets
    same = F.struct(F.count("*"), F.sum(F.xxhash64("id").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit("second"), "id")))
    mixed = named.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("g"), same.alias("same"))
    mixed = mixed.where("x <> y").groupBy("same").agg(F.min(F.struct("h", "g")).alias("k"))
    return named.join(materialise(mixed.select("k.h", "k.g"), "similar-mixed"), "h")


def texts_of(pairs: DataFrame, rows: DataFrame, marked: DataFrame) -> DataFrame:
    """(id, x) of the ends of ``pairs`` alone, written, so that no other text moves. ``rows``: (id, __row)."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    return texts_by_id(ends, rows, marked)


def texts_by_id(ids: DataFrame, rows: DataFrame, marked: DataFrame) -> DataFrame:
    wanted = materialise(rows.join(ids, "id", "left_semi"), "similar-wanted")
    return materialise(marked.join(wanted, "__row").select("id", "x").dropDuplicates(["id"]), "similar-texts")


def fingerprint_pairs(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b) of sets that SimHash links: those of one fingerprint with the least of them, and the least ones of
    linked fingerprints. ``prints``: (id, fp)."""
    low = materialise(prints.groupBy("fp").agg(F.min("id").alias("low")), "similar-fingerprints")
    same = prints.join(low, "fp").where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    linked = simhash.links(low.select("fp"), radius).toDF("f", "g")
    one = low.select(F.col("fp").alias("f"), F.col("low").alias("x"))
    other = low.select(F.col("fp").alias("g"), F.col("low").alias("y"))
    near = linked.join(one, "f").join(other, "g").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionByName(near)


def prefixes(
    sets: DataFrame, rows: DataFrame, marked: DataFrame, everything: Callable[[str | None], np.ndarray], least: tuple[int, int], rare: int
) -> DataFrame:
    """(h, id, n): the shared shingles of each set's prefix, in the order that has those of more than ``rare`` heads last, by count.

    A few more may come with them, which adds candidates and loses none. ``everything`` gives a text's ordered set.
    """
    entries = sets.select("id", F.posexplode("head").alias("pos", "h"))
    counted = entries.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    counted = materialise(counted, "similar-shared")
    held = materialise(entries.join(counted, "h"), "similar-held")
    hot = (F.col("c") > rare).cast("int")
    own = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    among = F.row_number().over(Window.partitionBy("id", "hot").orderBy("c", "pos")) - 1
    sizes = sets.select("id", "n", F.expr(f"n - (n * {least[0]} + {least[1]} - 1) div {least[1]} + 1").alias("p"), F.size("head").alias("k"))
    placed = held.withColumn("hot", hot).withColumn("before", F.coalesce(F.sum("hot").over(own), F.lit(0)))
    placed = placed.withColumn("cool", F.sum("hot").over(Window.partitionBy("id"))).withColumn("among", among).join(sizes, "id")
    placed = materialise(placed.withColumn("cool", F.col("k") - F.col("cool")), "similar-placed")
    # place in the new order: cool ones by their rank, and where all of a set is known, hot ones behind them by count
    at = F.when(F.col("hot") == 0, F.col("pos") - F.col("before")).otherwise(F.col("cool") + F.col("among"))
    known = (F.col("hot") == 0) | (F.col("k") == F.col("n"))
    chosen = placed.where(known & (at < F.col("p"))).select("h", "id", "n")
    short = materialise(placed.where("k < n AND cool < p").select("id").distinct(), "similar-short")
    if short.isEmpty():
        return chosen
    fields = [("all", T.ArrayType(T.LongType()))]
    texts = texts_by_id(short, rows, marked)
    whole = add_columns(texts, "x", fields, lambda values: [[everything(v).view(np.int64) for v in values]], drop=True)
    spread = whole.select("id", F.posexplode("all").alias("pos", "h"))
    marks = spread.join(counted.where(F.col("c") > rare), "h", "left")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("c", F.lit(0)), "pos"))
    deep = marks.withColumn("rank", rank).join(sizes, "id").where("rank <= p").select("h", "id", "n")
    deep = materialise(deep, "similar-deep")
    met = entries.join(deep.select("h").distinct(), "h").join(sizes, "id").select("h", "id", "n")
    return chosen.join(short, "id", "left_anti").select("h", "id", "n").unionByName(deep).unionByName(met).distinct()


def links(
    sets: DataFrame,
    rows: DataFrame,
    marked: DataFrame,
    everything: Callable[[str | None], np.ndarray],
    width: int,
    least: tuple[int, int],
    radius: int,
    rare: int,
    wide: int,
) -> DataFrame:
    """(a, b) edges that connect the distinct sets as all similar pairs do.

    ``sets``: (id, n, fp, head, sketch); ``rows``: (id, __row); ``marked``: (__row, x).
    """
    held = materialise(prefixes(sets, rows, marked, everything, least, rare), "similar-prefixes")
    low = held.groupBy("h").agg(F.min("id").alias("low"), F.min_by("n", "id").alias("m"), F.count("*").alias("c"))
    low = materialise(low.where("c > 1").drop("c"), "similar-low")

    def fits(n: str, m: str):
        return least[1] * F.least(n, m) >= least[0] * F.greatest(n, m)

    star = held.join(low, "h").where("id <> low").where(fits("n", "m")).select(F.col("low").alias("a"), F.col("id").alias("b"))
    star = materialise(star.unionByName(fingerprint_pairs(sets.select("id", "fp"), radius)).distinct(), "similar-star")
    sketches = sets.select("id", "n", "sketch")
    likely = materialise(promising(star, sketches, least), "similar-likely")
    first = materialise(verified(likely, texts_of(likely, rows, marked), width, least), "similar-first")
    groups = components(first)
    named = held.join(low.select("h"), "h", "left_semi").join(groups, held["id"] == groups["node"], "left").select(
        "h", "id", "n", F.coalesce("component", "id").alias("c")
    )
    named = materialise(named, "similar-named")
    members = materialise(mixed_members(named), "similar-members")
    few, many = members.where(F.col("g") <= wide), members.where(F.col("g") > wide)
    rest = met_in_groups(few, sketches.select("id", "sketch"), least, wide)
    rest = materialise(rest.join(likely, ["a", "b"], "left_anti"), "similar-rest")
    edges = first.unionByName(verified(rest, texts_of(rest, rows, marked), width, least))
    if many.isEmpty():
        return edges
    texts = texts_by_id(many.select("id").distinct(), rows, marked)
    whole = add_columns(texts, "x", [("whole", T.BinaryType())], lambda values: [[everything(v).tobytes() for v in values]], drop=True)
    whole = materialise(whole.join(sketches.select("id", "sketch"), "id"), "similar-whole")
    return edges.unionByName(materialise(met_in_groups(many, whole, least, 512), "similar-many"))


def one_of_each(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    width: int = SHINGLE,
    least: tuple[int, int] = SIMILARITY,
    sample: int = 8192,
    most: int = 1 << 16,
    radius: int = 3,
    rare: int = 8,
    wide: int = 32,
) -> DataFrame:
    """The row of ``docs`` with the least doc_id of each group of similar texts, ties by a hash of the row."""
    columns = [f"`{c}`" for c in docs.columns]
    own = [F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("x"), simhash.row_key(docs).alias("__row")]
    marked = docs.select(F.struct(*columns).alias("row"), *own)
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text, width, sample, most))

    def everything(value: str | None) -> np.ndarray:
        return ordered(shingles(value, width), *shared.value)

    def compute(values: list[str | None]) -> list[list]:
        made = [shingles(v, width) for v in values]
        sigs = [xxhash.xxh3_128_digest(own.tobytes(), SEED) for own in made]
        heads = [ordered(own, *shared.value)[: head_size(len(own), least)].view(np.int64) for own in made]
        return [sigs, [len(own) for own in made], [simhash.majority(own) for own in made], heads, [sketch(own) for own in made]]

    fields = [("sig", T.BinaryType()), ("n", T.LongType()), ("fp", T.LongType()), ("head", T.ArrayType(T.LongType())), ("sketch", T.BinaryType())]
    prints = add_columns(marked.select("d", "__row", "x"), "x", fields, compute, drop=True, piece_bytes=2 << 20)
    # written with the number, so that it stays the row's
    prints = materialise(prints.withColumn("id", F.monotonically_increasing_id()), "similar-prints")
    key = F.struct(F.col("d").isNull().alias("n"), "d", F.col("__row").alias("r"))
    # of rows with one set the first stands for it; the rest is taken from any of them, as the set gives it anyway
    firsts = materialise(prints.groupBy("sig").agg(F.min(key).alias("k"), F.min("id").alias("id")), "similar-firsts")
    spare = materialise(prints.select("id").join(firsts, "id", "left_anti"), "similar-spare")  # few copies are known to be few
    sets = prints.join(spare, "id", "left_anti").select("id", "n", "fp", "head", "sketch")
    chosen = firsts.select("id", F.col("k.r").alias("__row"))
    texts = marked.select("__row", "x")
    groups = components(links(sets, chosen, texts, everything, width, least, radius, rare, wide))
    named = firsts.join(groups, firsts["id"] == groups["node"], "left")
    best = named.groupBy(F.coalesce("component", "id").alias("c")).agg(F.min("k").alias("k")).select(F.col("k.r").alias("__row"))
    # what goes is listed, not what stays, and only rows that occur more than once are brought together
    gone = materialise(prints.select("__row").join(best, "__row", "left_anti").distinct(), "similar-gone")
    twice = materialise(prints.groupBy("__row").count().where("count > 1").select("__row"), "similar-twice")
    kept = marked.join(gone, "__row", "left_anti")
    again = kept.join(twice, "__row", "left_semi").dropDuplicates(["__row"])
    return kept.join(twice, "__row", "left_anti").unionByName(again).select("row.*")
