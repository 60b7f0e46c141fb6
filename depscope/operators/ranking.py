"""Places of rows in one order over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depscope.functions.columns import unused
from depscope.scratch import materialise


def with_rank(rows: DataFrame, order: list[str | Column], name: str = "rank") -> tuple[DataFrame, int]:
    """``rows`` with ``name``, a row's place from 0 in ``order``, and the number of rows.

    Rows are cut into ranges of the order and numbered in each; the driver sees one count a
    range. Rows equal in ``order`` get different places, in no fixed order. A column called
    ``name`` gives way; any other column may have any name.
    """
    spark, kept = rows.sparkSession, [c for c in rows.columns if c != name]
    columns = [f"`{c}`" for c in kept]
    part, start, own = (unused(kept, c) for c in ("__part", "__start", "__own"))
    sort = [unused(kept, f"__o{k}") for k in range(len(order))]
    keys = [(F.col(c) if isinstance(c, str) else c).alias(s) for c, s in zip(order, sort, strict=True)]
    ranged = materialise(rows.select(*columns, *keys).repartitionByRange(*sort).withColumn(part, F.spark_partition_id()), "ranked")
    starts, total = [], 0
    for number, count in ranged.groupBy(part).count().orderBy(part).collect():
        starts.append((number, total))
        total += count
    known = F.broadcast(spark.createDataFrame(starts, f"`{part}` int, `{start}` long"))
    placed = ranged.withColumn(own, F.row_number().over(Window.partitionBy(part).orderBy(*sort)) - 1).join(known, part)
    return placed.select(*columns, (F.col(start) + F.col(own)).alias(name)), total
