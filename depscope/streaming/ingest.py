"""Source files as a stream: each micro-batch is parsed into a table of syntax nodes that has each file once.

What lies below a root is listed as the batch source does it, so names are relative to the root, and
excluded, hidden and empty files fare alike. What is new, changed or gone since the last listing becomes
entries of a feed, ``per_batch`` to a file; the stream takes one such file a micro-batch. An entry has
the number of its listing, and so have the rows made for it: a path's rows are those of its latest
listing, and a file that is gone has a row that says so. Rows of batches that run again, or in another
order, change nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from depscope.operators.ranking import with_rank
from depscope.scratch import materialise
from depscope.sources.files import listing, with_content
from depscope.sources.python_ast import parse_files

ENTRY = "path string, modified timestamp, length long, listing long, gone boolean"
#: The kind of the one row that a file has after it has gone.
GONE = "Gone"


def latest(rows: DataFrame) -> DataFrame:
    """(path, listing): the last listing that has anything of a path."""
    return rows.groupBy("path").agg(F.max("listing").alias("listing"))


def feed_files(spark: SparkSession, root: str, feed: str, exclude: list[str] | None = None, per_batch: int = 100) -> int:
    """Adds what is new, changed or gone below ``root`` to the feed, and returns how many files that are.

    A file is known by its path, time and length. Each start writes folders of its own, whole or not at all.
    """
    listed, number = listing(spark, root, exclude).select("path", "modified", "length"), 1
    path = spark._jvm.org.apache.hadoop.fs.Path(feed)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    gone = spark.createDataFrame([], ENTRY)
    if store.exists(path) and len(store.listStatus(path)):
        fed = spark.read.schema(ENTRY).option("recursiveFileLookup", True).parquet(feed)
        known = fed.join(latest(fed), ["path", "listing"], "left_semi").where("NOT gone").select("path", "modified", "length")
        number = 1 + (fed.agg(F.max("listing")).first()[0] or 0)
        listed = materialise(listed, "listed")
        gone = known.join(listed, "path", "left_anti").withColumns({"listing": F.lit(number).cast("long"), "gone": F.lit(True)})
        listed = listed.join(known, ["path", "modified", "length"], "left_anti")
    news = listed.withColumns({"listing": F.lit(number).cast("long"), "gone": F.lit(False)}).unionByName(gone)
    ranked, count = with_rank(news, ["path"])
    if count:
        batch = F.floor(F.col("rank") / per_batch).cast("int")
        batches = -(-count // per_batch)
        ranked.repartitionById(batches, batch).select(*news.columns).write.parquet(f"{feed}/{uuid.uuid4().hex}")
    return count


def current(spark: SparkSession, target: str) -> DataFrame:
    """The nodes of all files as the stream has last seen them; one that has gone has none."""
    rows = spark.read.parquet(target)
    kept = rows.join(latest(rows.where("n = 0")), ["path", "listing"], "left_semi")
    return kept.where(F.col("kind") != GONE).drop("batch", "listing")


def file_stream(spark: SparkSession, feed: str) -> DataFrame:
    return (
        spark.readStream.schema(ENTRY)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .parquet(feed)
    )


def start_ingest(
    spark: SparkSession,
    root: str,
    target: str,
    checkpoint: str,
    progress: Callable[[dict], None] | None = None,
    per_batch: int = 100,
    exclude: list[str] | None = None,
) -> StreamingQuery:
    """Parse what is new or changed, in batches, into Parquet at ``target``, to be read by ``current``; a batch's folder
    is replaced as a whole if the batch runs again."""
    feed = f"{checkpoint.rstrip('/')}/feed"
    feed_files(spark, root, feed, exclude, per_batch)

    def merge(batch: DataFrame, number: int) -> None:
        parsed = parse_files(with_content(batch.where("NOT gone").select("path", "modified", "length"), root))
        left = batch.where("gone").select("path", F.lit(0).alias("n"), F.lit(GONE).alias("kind"))
        rows = parsed.unionByName(left, allowMissingColumns=True).join(batch.select("path", "listing"), "path")
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if progress:
            progress({"stage": "parse", "batch": number})

    writer = file_stream(spark, feed).writeStream.foreachBatch(merge)
    return writer.option("checkpointLocation", f"{checkpoint.rstrip('/')}/state").trigger(availableNow=True).start()
