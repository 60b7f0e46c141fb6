"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are dealt into blocks. Time goes by slots of one block. A source
with weight w of total W releases its i-th block of a cycle at floor((i-1) W / w) and owes it
by ceil(i W / w); in each slot the released block with the earliest deadline goes. So before
any slot each source is less than one block away from its share. Sources of one weight are
scheduled as one of their weights' sum and take turns with its slots, which keeps each of
them less than a block away from its own share, too.

A source that has no blocks left leaves its slots empty: the others keep theirs, so each
stays less than one block away from its weight's part of the common clock, which the slots
count, and the rows in order of slot and place are the mixture. All documents are kept.

A cycle of W slots repeats, so the driver computes one: its work depends on the sum of the
weights of all sources, not on documents, and a step on the number of different weights.
Sources, and ranks inside a source, are counted by tasks; ranks come from shares of a source
by hash, and a row that occurs very often is shared out again by where its copies stand, so
no task holds a whole source or all copies.

Defined results: a null source is a source of its own; a source without a given weight has
the default weight; a weight that isn't a positive whole number raises ValueError;
documents in a source are ordered by a hash of the row, ties by doc_id; rows equal in all
columns are each placed; a null size counts as 1, and one below 1 as 1; an empty table gives an
empty result; columns named block, slot or place give way to the result's, and any other column may have any name.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depscope.functions.columns import unused
from depscope.llm.order import with_order
from depscope.operators.ranking import with_rank
from depscope.scratch import materialise


def cycle(weights: list[int]) -> list[int]:
    """Which source has each of the sum(weights) slots of a cycle, earliest deadline first."""
    total = sum(weights)
    waiting = [(0, s, 1) for s in range(len(weights))]  # release, source, block of the cycle
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slots = []
    for now in range(total):
        while waiting and waiting[0][0] <= now:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-i * total // weights[s]), s, i))
        _, s, i = heapq.heappop(ready)
        slots.append(s)
        if i < weights[s]:
            heapq.heappush(waiting, (i * total // weights[s], s, i + 1))
    return slots


def source_table(docs: DataFrame, weights: dict, default_weight: int) -> DataFrame:
    """(s, n, w, turn, peers) for each source of ``docs`` (s): rows, weight, its turn among the sources of its weight,
    from 0 by name with null last, and how many those are."""
    spark, kind = docs.sparkSession, docs.schema["s"].dataType.simpleString()
    given = F.broadcast(spark.createDataFrame(list(weights.items()), f"g {kind}, w long"))  # a row for each given weight
    counted = docs.groupBy("s").agg(F.count("*").alias("n")).join(given, F.col("s").eqNullSafe(F.col("g")), "left")
    counted = counted.select("s", "n", F.coalesce("w", F.lit(default_weight).cast("long")).alias("w"))
    ranked, _ = with_rank(counted, ["w", F.col("s").isNull(), "s"])
    firsts = ranked.groupBy("w").agg(F.min("rank").alias("first"), F.count("*").alias("peers"))  # a row for each weight
    placed = ranked.join(F.broadcast(firsts), "w")
    return materialise(placed.select("s", "n", "w", (F.col("rank") - F.col("first")).alias("turn"), "peers"), "mixing-sources")


def ranked(rows: DataFrame, sources: DataFrame, per_share: int) -> DataFrame:
    """``rows`` (s, h, d, size, at, row) with the columns of ``sources`` and before: the sizes of what precedes a row in its
    source, in the order of h, then d.

    A source is split by ranges of h into shares of about ``per_share`` rows; a share is sorted on
    its own, and the sums of the shares before it are added. The copies of a row with more than
    ``per_share`` of them are shares of their own, dealt by where they stand.
    """
    span = 1 << 32
    often = rows.groupBy("s", "h").agg(F.count("*").alias("copies")).where(F.col("copies") > per_share)
    often = materialise(often, "mixing-often").select(F.col("s").alias("s2"), F.col("h").alias("h2"), "copies")
    known = sources.withColumnRenamed("s", "s1")
    keyed = rows.join(known, F.col("s").eqNullSafe(F.col("s1")), "left").drop("s1")
    keyed = keyed.join(often, F.col("s").eqNullSafe(F.col("s2")) & (F.col("h") == F.col("h2")), "left")
    dealt = F.pmod("at", F.ceil(F.col("copies") / per_share))
    share = F.struct(
        F.floor(F.col("h") * F.ceil(F.col("n") / per_share) / span).alias("t"),
        F.coalesce("h2", F.lit(-1)).alias("hot"),
        F.coalesce(dealt, F.lit(0)).alias("part"),
    )
    keyed = keyed.withColumn("share", share).drop("s2", "h2", "copies")
    sums = keyed.groupBy("s", "share").agg(F.sum("size").alias("size"))
    first = F.sum("size").over(Window.partitionBy("s").orderBy("share").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(F.col("s").alias("s3"), F.col("share").alias("share3"), F.coalesce(first, F.lit(0)).alias("first"))
    starts = materialise(starts, "mixing-starts")  # a row for each share
    own = Window.partitionBy("s", "share").orderBy("h", "d", "at").rowsBetween(Window.unboundedPreceding, -1)
    inside = keyed.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
    met = inside.join(starts, F.col("s").eqNullSafe(F.col("s3")) & (F.col("share") == F.col("share3")))
    return met.withColumn("before", F.col("first") + F.col("inside"))


def mix(
    docs: DataFrame,
    weights: dict[str | None, int] | None = None,
    default_weight: int = 1,
    source: str = "source",
    doc_id: str = "doc_id",
    block: int = 16,
    size: str | None = None,
    per_share: int = 4096,
) -> DataFrame:
    """``docs`` with block (of its source), slot (of the schedule) and place (in the block).

    Order by slot and place is the mixture; ``in_order`` lays it out. ``weights`` are whole blocks per cycle. A
    block is ``block`` documents, or as many units of the column ``size``, such as tokens or bytes; a
    document goes in the block that it begins in.
    """
    given = weights or {}
    if any(not isinstance(w, int) or w < 1 for w in [default_weight, *given.values()]):
        raise ValueError("weights must be positive whole numbers")
    spark = docs.sparkSession
    units = F.lit(1) if size is None else F.greatest(F.lit(1), F.coalesce(F.col(f"`{size}`"), F.lit(1)))
    columns = [f"`{c}`" for c in docs.columns]
    ordered, file, number = with_order(docs.select(*columns))
    own = {
        "s": F.col(f"`{source}`"),
        "h": F.pmod(F.xxhash64(*columns), F.lit(1 << 32)),
        "d": F.col(f"`{doc_id}`"),
        "size": units.cast("long"),
        "at": F.xxhash64(file, number),
        "row": F.struct(*columns),
    }
    rows = ordered.select(*[c.alias(n) for n, c in own.items()])
    sources = source_table(rows.select("s"), given, default_weight)
    groups = [tuple(r) for r in sources.groupBy("w").agg(F.max("peers")).orderBy("w").collect()]  # a row for each weight
    order, places = cycle([w * peers for w, peers in groups]), []
    counts = [0] * len(groups)
    for slot, g in enumerate(order):
        places.append((groups[g][0], counts[g], slot))
        counts[g] += 1
    # a local table has a known size, so the planner broadcasts it if it is small and moves no texts
    table = spark.createDataFrame(places, "w2 long, nth long, offset long")
    placed = ranked(rows, sources, per_share).withColumn("block", F.floor(F.col("before") / block))
    nth = F.col("block") * F.col("peers") + F.col("turn")
    period = F.col("w") * F.col("peers")
    met = placed.withColumn("round", F.floor(nth / period)).withColumn("in_round", nth - F.col("round") * period)
    met = met.join(table, (F.col("w") == F.col("w2")) & (F.col("in_round") == F.col("nth")))
    slot = (F.col("round") * len(order) + F.col("offset")).cast("long")
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("block", "slot", "place")]
    return met.select(*kept, "block", slot.alias("slot"), (F.col("before") - F.col("block") * block).alias("place"))


def in_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """``mixed`` by slot and place, cut into partitions of about equally many rows.

    The cuts come from counts of ranges of slots, a bounded number of them, so no range is sampled.
    """
    spark = mixed.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = mixed.agg(F.max("slot")).first()[0] or 0
    width = last // (64 * count) + 1
    before, cuts = 0, []
    ranges = mixed.groupBy(F.floor(F.col("slot") / width).alias("r")).count().orderBy("r").collect()
    total = sum(n for _, n in ranges)
    for at, n in ranges:
        cuts.append((at, before * count // total))
        before += n
    r, part = unused(mixed.columns, "__r"), unused(mixed.columns, "__part")
    known = F.broadcast(spark.createDataFrame(cuts, f"{r} long, {part} int"))  # 64 rows a partition at most
    dealt = mixed.join(known, F.floor(F.col("slot") / width) == F.col(r))
    return dealt.repartitionById(count, F.col(part)).sortWithinPartitions("slot", "place").select(*[f"`{c}`" for c in mixed.columns])
