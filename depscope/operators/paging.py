"""Search, pages, samples and summaries of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def search(nodes: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """Nodes whose name holds ``query`` whatever the case; an empty query finds nothing."""
    found = nodes.where(F.contains(F.lower("name"), F.lit(query.lower())) & F.lit(bool(query)))
    return found if kind is None else found.where(F.col("kind") == kind)


def lookup(nodes: DataFrame, entity_id: str) -> DataFrame:
    return nodes.where(F.col("id") == entity_id)


def page(rows: DataFrame, order: list[str], number: int, size: int = 100) -> DataFrame:
    """Page ``number`` from 1, in a total order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(rows: DataFrame, key: str, last, size: int = 100) -> DataFrame:
    """The page behind key ``last``: nothing before it is sorted or skipped."""
    return rows.where(F.col(key) > last).orderBy(key).limit(size)


def page_info(rows: DataFrame, number: int, size: int = 100) -> DataFrame:
    """One row: total, pages, has_next, has_previous."""
    pages = F.ceil(F.col("total") / size)
    return rows.agg(F.count("*").alias("total")).select(
        "total",
        pages.alias("pages"),
        (pages > number).alias("has_next"),
        ((F.lit(number) > 1) & (F.col("total") > 0)).alias("has_previous"),
    )


def top(rows: DataFrame, order: list, n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def summary(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """(kind, n, mean): count, and mean of the values that aren't 0."""
    return rows.groupBy(kind).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col(value) != 0, F.col(value))).alias("mean_nonzero")
    )


def sample_summary(rows: DataFrame, order: list, kind: str, value: str, most: int = 1000) -> DataFrame:
    """(kind, n, total_results, sample_size, is_sampled, mean_nonzero) of the ``most`` first rows; total_results counts all,
    and the mean is over all kinds of the sample, 0 if nothing in it is other than 0."""
    sample = top(rows.select(kind, value, *[c for c in order if c not in (kind, value)]), order, most)
    nonzero = F.when(F.col(value) != 0, F.col(value))
    sums = sample.groupBy(kind).agg(F.count("*").alias("n"), F.sum(nonzero).alias("s"), F.count(nonzero).alias("c"))
    whole = Window.partitionBy()  # a row for each kind
    mean = F.coalesce(F.sum("s").over(whole) / F.nullif(F.sum("c").over(whole), F.lit(0)), F.lit(0.0))
    total = rows.agg(F.count("*")).scalar()
    return sums.select(
        kind,
        "n",
        total.alias("total_results"),
        F.least(total, F.lit(most)).cast("long").alias("sample_size"),
        (total > most).alias("is_sampled"),
        mean.alias("mean_nonzero"),
    )


def evict(files: DataFrame, capacity: int) -> DataFrame:
    """Entries (id, size, used) that go, oldest first, until the rest fits ``capacity``.

    Sizes are summed by hour of use first, so only the hours are ordered in one place.
    """
    hours = files.withColumn("hour", F.date_trunc("hour", "used"))
    sums = hours.groupBy("hour").agg(F.sum("size").alias("s"))
    newer = Window.orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("hour", F.coalesce(F.sum("s").over(newer), F.lit(0)).alias("newer"))
    own = Window.partitionBy("hour").orderBy(F.desc("used"), "id")
    kept = F.col("newer") + F.sum("size").over(own)
    return hours.join(before, "hour").withColumn("running", kept).where(F.col("running") > capacity).select("id", "running")
