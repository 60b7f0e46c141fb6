"""Results as JSON or flat edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON document for each row; columns that start with an underscore stay out."""
    public = [c for c in rows.columns if not c.startswith("_")]
    return rows.select(F.to_json(F.struct(*public)).alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    as_json(rows).withColumnRenamed("json", "value").write.mode("overwrite").text(path)


def flat_edges(edges: DataFrame) -> DataFrame:
    """(from, to, type) of relationships."""
    return edges.select(
        F.col("from_entity").alias("from"), F.col("to_entity").alias("to"), F.col("relationship_type").alias("type")
    )
