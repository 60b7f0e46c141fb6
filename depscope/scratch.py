"""Shared working storage: where operators cut lineage or reuse a costly step.

A cut is a table written to the folder that ``spark.checkpoint.dir`` names, so it
outlives any executor and every executor can read it back.
"""

from __future__ import annotations

import atexit
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Only used when a local session names no shared folder, as in tests.
LOCAL_ROOT = "/tmp/checkpoints/depscope"

_written: dict[str, SparkSession] = {}
_tables: weakref.WeakSet[DataFrame] = weakref.WeakSet()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session without one gets LOCAL_ROOT."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_ROOT


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return it as read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    _tables.add(table)
    return table


def once(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table, for what reads it several times; one that ``materialise`` returned is not written again."""
    return df if df in _tables else materialise(df, label)


def partitioned(df: DataFrame, columns: list[str], label: str) -> str:
    """Where ``df`` is written with a folder for each value of ``columns``."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*columns).parquet(path)
    _written[path] = df.sparkSession
    return path


def place(spark: SparkSession, label: str) -> str:
    """A new folder's path, for tables that an operator lays out itself; released like the others."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def written() -> list[str]:
    """The folders of all tables that are written and not released, oldest first."""
    return list(_written)


def release(paths: list[str] | None = None) -> None:
    """Delete the tables at ``paths``, or every table written by this process; call when the results that read them
    are consumed, as a frame over a deleted table can't be read any more."""
    for path in list(_written) if paths is None else paths:
        spark = _written.pop(path, None)
        if spark is not None:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jvm_path, True)


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # the session may already be gone; nothing is left to report to
        _written.clear()
