"""What to analyse again: file manifests, plans, merges, expiry."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): new, deleted, modified or same, by fingerprint. Manifests: (path, fingerprint)."""
    met = old.select("path", F.col("fingerprint").alias("a")).join(
        new.select("path", F.col("fingerprint").alias("b")), "path", "full"
    )
    status = (
        F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    )
    return met.select("path", status.otherwise("same").alias("status"))


def confirmed(status: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """``status`` of a quick comparison, where a modified path whose content is what it was is the same after all.

    ``old``: (path, fingerprint) of contents; ``new`` needs to hold the modified paths only."""
    equal = compare(old, new).where("status = 'same'").select("path", F.lit(True).alias("equal"))
    calm = (F.col("status") == "modified") & F.coalesce("equal", F.lit(False))
    return status.join(equal, "path", "left").select("path", F.when(calm, "same").otherwise(F.col("status")).alias("status"))


def plan(status: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, action): analyse, drop or reuse; files that import a changed one are analysed too.

    ``edges``: (src, dst) from importer to imported.
    """
    touched = status.where("status <> 'same'").select(F.col("path").alias("dst"))
    importers = edges.join(touched, "dst", "left_semi").select(F.col("src").alias("path")).distinct()
    met = status.join(importers.withColumn("dependent", F.lit(True)), "path", "left")
    action = (
        F.when(F.col("status") == "deleted", "drop")
        .when((F.col("status") != "same") | F.coalesce("dependent", F.lit(False)), "analyse")
        .otherwise("reuse")
    )
    return met.select("path", action.alias("action"))


def too_many(actions: DataFrame, most: float = 0.7) -> bool:
    """Whether over ``most`` of the files that aren't dropped are to be analysed."""
    n, again = actions.where("action <> 'drop'").agg(F.count("*"), F.count_if(F.col("action") == "analyse")).first()
    return n > 0 and again / n > most


def merge(old: DataFrame, fresh: DataFrame, actions: DataFrame) -> DataFrame:
    """Old rows of reused files, and the fresh rows; both have path."""
    kept = old.join(actions.where("action = 'reuse'").select("path"), "path", "left_semi")
    return kept.unionByName(fresh)


def _key_text(path: str, options: dict) -> str:
    return json.dumps({"path": path, "options": options}, sort_keys=True, ensure_ascii=False, default=str)


def cache_key(path: str, options: dict) -> str:
    return hashlib.sha256(_key_text(path, options).encode()).hexdigest()[:16]


def cache_keys(path: Column, options: dict) -> Column:
    """``cache_key`` of a column of paths; a null path has none."""
    head, tail = _key_text("\0", options).rsplit('"\\u0000"', 1)
    quoted = F.regexp_extract(F.to_json(F.struct(path.alias("p"))), r'(?s)^\{"p":(.*)\}$', 1)
    return F.when(path.isNotNull(), F.substring(F.sha2(F.concat(F.lit(head), quoted, F.lit(tail)), 256), 1, 16))


def expired(entries: DataFrame, created: str, now, days: int = 7) -> DataFrame:
    """Entries older than ``days`` at ``now``."""
    return entries.where(F.col(created) + F.make_dt_interval(F.lit(days)) < now)
