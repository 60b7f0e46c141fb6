"""An index of names by the runs of characters in them, written once, so that a search reads little of it.

``names`` has the rows in folders of consecutive keys, ``postings`` says which key's name holds which run of one to three
characters, and ``counts`` how many names hold each. The last two are sorted by run, so a filter on runs is pushed to the
files' statistics. A search looks up the rarest runs of its text, reads the folders that hold a name with all of them, and
compares names only there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depscope.functions.columns import unused
from depscope.operators.ranking import with_rank

#: Characters in a run; a shorter text is a run of its own.
LONGEST = 3
#: Runs that a search looks up, the rarest of its text.
CHOSEN = 3
#: Names in a folder.
FOLDER = 100_000


def _runs(text: Column) -> Column:
    """All different runs of 1 to LONGEST characters in a text that isn't empty."""
    length = F.length(text)

    def of(size: int) -> Column:
        starts = F.when(length >= size, F.sequence(F.lit(1), length - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.substr(text, at, F.lit(size)))

    return F.array_distinct(F.concat(*[of(size) for size in range(1, LONGEST + 1)]))


def build(nodes: DataFrame, path: str) -> None:
    """Writes the index of ``nodes`` (name, …) below ``path``. Rows with a null or empty name can't be found, and stay out."""
    key, folder, low = (unused(nodes.columns, c) for c in ("key", "folder", "low"))
    named = nodes.where("name <> ''")
    ranked, _ = with_rank(named, ["name"], key)
    rows = ranked.withColumns({low: F.lower("name"), folder: F.floor(F.col(key) / FOLDER)})
    rows.repartitionByRange(folder, key).write.partitionBy(folder).parquet(f"{path}/names")
    rows.limit(0).write.parquet(f"{path}/shape")  # folders of no rows have no schema
    written = nodes.sparkSession.read.schema(rows.schema).parquet(f"{path}/names")
    postings = written.select(F.explode(_runs(F.col(low))).alias("run"), F.col(folder).alias("folder"), F.col(key).alias("key"))
    postings.repartitionByRange("run", "key").sortWithinPartitions("run", "key").write.parquet(f"{path}/postings")
    counted = nodes.sparkSession.read.parquet(f"{path}/postings").groupBy("run").agg(F.count("*").alias("n"))
    counted.repartitionByRange("run").sortWithinPartitions("run").write.parquet(f"{path}/counts")


def search(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The rows whose name holds ``query`` whatever the case, as a scan would find them; an empty query finds nothing.

    All that reaches the driver is a count for each run of the query."""
    shape, postings = spark.read.parquet(f"{path}/shape").schema, spark.read.parquet(f"{path}/postings")
    names = spark.read.schema(shape).parquet(f"{path}/names")
    key, low, folder = names.columns[-3:]  # as ``build`` adds them
    text = query.lower()
    runs = {text[at : at + LONGEST] for at in range(max(1, len(text) - LONGEST + 1))}
    counts = spark.read.parquet(f"{path}/counts").where(F.col("run").isin(sorted(runs)))
    rarest = [r["run"] for r in counts.orderBy("n", "run").collect()]
    chosen = rarest[:CHOSEN] if len(rarest) == len(runs) else []  # a run that no name has
    met = postings.where(F.col("run").isin(chosen)).groupBy("folder", "key").agg(F.count("*").alias("n")).where(F.col("n") == len(chosen))
    held = names.join(met, (names[folder] == met["folder"]) & (names[key] == met["key"]), "left_semi")
    return held.where(F.contains(F.col(low), F.lit(text))).drop(key, low, folder)
