"""Rows dealt to tasks by their number, so that a task's memory stays the same whatever the tables' size.

Spark merges small shuffle partitions until there is one for each core, so what a task sorts or aggregates grows with the table. A number
given to ``repartition`` is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task.
ROWS = 500_000


def spread(rows: DataFrame, total: int, *keys: str) -> DataFrame:
    """``rows``, about ``total`` of them, dealt by ``keys`` to one partition for each ROWS, and no fewer than there are cores."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // ROWS)), *keys)


def dealt(rows: DataFrame, total: int, *keys: str) -> DataFrame:
    """``rows`` spread if the merged partitions, one for each core, would have more than ROWS of the ``total``; else as they are, as
    loops over small tables lose more by another shuffle than they gain."""
    return spread(rows, total, *keys) if total > ROWS * rows.sparkSession.sparkContext.defaultParallelism else rows
