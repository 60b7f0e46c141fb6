"""Quality of classes and modules: rollups, cohesion, grades."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depscope.functions import metrics
from depscope.scratch import materialise


def class_quality(methods: DataFrame, coupling: DataFrame) -> DataFrame:
    """(class_id, mean_complexity, complexity, lines, …, grade) from methods (class_id, complexity,
    lines) and coupling (entity, afferent, efferent, instability)."""
    own = methods.groupBy("class_id").agg(F.avg("complexity").alias("mean_complexity"), F.sum("lines").alias("lines"))
    met = own.join(coupling, F.col("class_id") == F.col("entity"), "left").drop("entity")
    met = met.fillna({"afferent": 0, "efferent": 0, "instability": 0.0})
    return graded(met)


def graded(rows: DataFrame) -> DataFrame:
    """Rows with mean_complexity, lines, efferent and instability, with the figures from them."""
    mean = F.col("mean_complexity")
    rows = rows.withColumns(
        {
            "complexity": mean.cast("int"),
            "maintainability": metrics.maintainability(mean, F.col("lines")),
            "debt": metrics.technical_debt(mean, F.col("efferent")),
        }
    )
    marks = metrics.grade(F.col("complexity"), F.col("maintainability"), F.col("instability"), F.col("debt"))
    return rows.withColumn("grade", marks)


def module_rollup(classes: DataFrame) -> DataFrame:
    """(module_id, afferent, efferent, instability, complexity, lines, maintainability, debt, grade).

    ``classes``: module_id, complexity (null for a module without classes), lines, afferent, efferent.
    """
    rolled = classes.groupBy("module_id").agg(
        F.coalesce(F.sum("afferent"), F.lit(0)).alias("afferent"),
        F.coalesce(F.sum("efferent"), F.lit(0)).alias("efferent"),
        F.coalesce(F.avg("complexity"), F.lit(1.0)).alias("mean_complexity"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"),
    )
    rolled = rolled.withColumn("instability", metrics.instability(F.col("afferent"), F.col("efferent")))
    return graded(rolled).withColumn("debt", F.lit(0.0)).withColumn(
        "grade", metrics.grade(F.col("complexity"), F.col("maintainability"), F.col("instability"), F.lit(0.0))
    )


def complexity_map(methods: DataFrame) -> DataFrame:
    """(id, complexity) of the methods whose complexity isn't 0."""
    return methods.where("complexity <> 0").select("id", "complexity")


#: What a class without figures counts as.
DEFAULTS = {"complexity": 2, "lines": 15, "maintainability": 75.0, "debt": 0.1}


def with_defaults(rows: DataFrame) -> DataFrame:
    return rows.fillna(DEFAULTS)


def grade_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("grade").agg(F.count("*").alias("n"))


def overall(rows: DataFrame) -> DataFrame:
    """One row of means; 0 for no rows."""
    return rows.agg(
        F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("mean_complexity"),
        F.coalesce(F.avg("maintainability"), F.lit(0.0)).alias("mean_maintainability"),
        F.count("*").alias("n"),
    )


def field_usage(methods: DataFrame, fields: DataFrame) -> DataFrame:
    """(class_id, method_id, field): which fields of its class each method's text names.

    ``methods``: (class_id, id, body_text); ``fields``: (class_id, name). A method that names none has a
    row with a null field, so that it counts among its class's methods.
    """
    own = fields.where("class_id IS NOT NULL AND name <> ''").groupBy("class_id").agg(F.collect_set("name").alias("names"))
    met = methods.where("class_id IS NOT NULL").join(own, "class_id", "left")
    used = F.filter("names", lambda n: F.contains(F.col("body_text"), n))
    return met.select("class_id", F.col("id").alias("method_id"), F.explode_outer(used).alias("field"))


#: So many fields of a class, each used by more than LIGHT different sets, are counted by bits.
HEAVY, LIGHT = 20, 64


def _sharing_bits(masks: DataFrame) -> DataFrame:
    """(class_id, n): pairs of methods with a bit in common, from (class_id, mask, c) of masks with a bit. A class has 2^HEAVY
    rows at most, and one without a mask, as most small ones are, costs no call.

    Two methods have none in common if one's bits lie in the other's complement, and the counts of all masks inside
    each complement are subset sums, made bit by bit."""
    schema = T.StructType([masks.schema["class_id"], T.StructField("n", T.LongType())])

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        mask, c = rows["mask"].to_numpy(np.int64), rows["c"].to_numpy(np.int64)
        width = int(mask.max()).bit_length()
        inside = np.bincount(mask, weights=c, minlength=1 << width).astype(np.int64)
        for bit in range(width):
            halves = inside.reshape(-1, 2, 1 << bit)
            halves[:, 1] += halves[:, 0]
        apart = inside[((1 << width) - 1) ^ mask]
        both = int((c * (c.sum() - apart)).sum()) - int(c[mask > 0].sum())
        return pd.DataFrame({"class_id": rows["class_id"].iloc[:1], "n": [both // 2]})

    return masks.groupBy("class_id").applyInPandas(count, schema)


def cohesion(usage: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(class_id, n_methods, sharing, lcom, tcc) from (class_id, method_id, field).

    Methods that use the same fields are taken together as a set. The fields that most sets of a class have, ``HEAVY`` at most,
    become bits of a set's mask, and pairs that share one of them are counted from the counts of masks. Pairs that share only
    others are made by a join on these, each of which few sets have. So a field that all methods use costs a row for each set. Methods
    without a field must come with a null one. A class has no lcom if it has no field: none in ``usage``, or
    if ``fields`` (class_id) is given, none there.
    """
    used = usage.where("field IS NOT NULL")
    sets = (
        used.groupBy("class_id", "method_id")
        .agg(F.sort_array(F.collect_set("field")).alias("fields"))
        .groupBy("class_id", "fields")
        .agg(F.count("*").alias("c"))
        .withColumn("s", F.monotonically_increasing_id())
    )
    sets = materialise(sets, "cohesion")
    spread = sets.select("class_id", "s", "c", F.explode("fields").alias("field"))
    often = spread.groupBy("class_id", "field").agg(F.count("*").alias("n")).where(F.col("n") > LIGHT)
    place = F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("n"), "field"))
    heavy = materialise(often.withColumn("bit", place).where(F.col("bit") <= HEAVY).select("class_id", "field", "bit"), "cohesion-heavy")
    marked = spread.join(heavy, ["class_id", "field"], "left").select("*", F.coalesce(F.expr("shiftleft(1L, bit - 1)"), F.lit(0)).alias("own"))
    masks = materialise(marked.groupBy("class_id", "s").agg(F.first("c").alias("c"), F.bit_or("own").alias("mask")), "cohesion-masks")
    by_bits = _sharing_bits(masks.where("mask <> 0").groupBy("class_id", "mask").agg(F.sum("c").alias("c")))
    inside = masks.where("mask = 0").select("class_id", (F.col("c") * (F.col("c") - 1) / 2).cast("long").alias("n"))
    light = spread.join(heavy, ["class_id", "field"], "left_anti").join(masks.select("class_id", "s", "mask"), ["class_id", "s"])
    other = light.select("class_id", "field", F.col("s").alias("s2"), F.col("c").alias("c2"), F.col("mask").alias("mask2"))
    across = (
        light.join(other, ["class_id", "field"])
        .where((F.col("s") < F.col("s2")) & (F.col("mask").bitwiseAND(F.col("mask2")) == 0))
        .groupBy("class_id", "s", "s2")
        .agg(F.min(F.col("c") * F.col("c2")).alias("n"))
        .select("class_id", "n")
    )
    sharing = by_bits.unionByName(inside).unionByName(across).groupBy("class_id").agg(F.sum("n").alias("sharing"))
    sizes = usage.groupBy("class_id").agg(
        F.count_distinct("method_id").alias("n_methods"), F.count_distinct("field").alias("n_fields")
    )
    if fields is not None:
        owned = fields.where("class_id IS NOT NULL").groupBy("class_id").agg(F.count("*").alias("n_fields"))
        sizes = sizes.drop("n_fields").join(owned, "class_id", "left").fillna({"n_fields": 0})
    pairs = F.col("n_methods") * (F.col("n_methods") - 1) / 2
    lcom = F.when(F.col("n_fields") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), pairs - 2 * F.col("sharing")))
    tcc = F.when(pairs > 0, F.greatest(F.lit(0.0), pairs - F.col("lcom")) / pairs).otherwise(0.0)
    return (
        sizes.join(sharing, "class_id", "left")
        .withColumn("sharing", F.coalesce("sharing", F.lit(0)))
        .withColumn("lcom", lcom)
        .withColumn("tcc", tcc)
        .select("class_id", "n_methods", "sharing", "lcom", "tcc")
    )


def abstractness(classes: DataFrame, group: str) -> DataFrame:
    """(group, abstractness, distance) from classes with is_abstract and instability."""
    return classes.groupBy(group).agg(
        F.avg(F.col("is_abstract").cast("double")).alias("abstractness"), F.avg("instability").alias("instability")
    ).withColumn("distance", metrics.distance_from_main(F.col("abstractness"), F.col("instability")))
