"""Where rows stand in their table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.functions.columns import unused


def with_order(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns that sort rows as they were written, and their names, which no column of ``docs`` has.

    Spark reads a table's files by size, so for a written table these are the file's name, which has
    the number of the task that wrote it, and the row's index; for any other frame, the partition and the row in it.
    """
    file, row, at = (unused(docs.columns, c) for c in ("__file", "__row", "__at"))
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() == "LogicalRelation":
        name = F.col("_metadata.file_name")
        number = F.lpad(F.regexp_extract(name, r"^part-(\d+)", 1), 19, "0")
        return docs.select("*", F.concat(number, name).alias(file), F.col("_metadata.row_index").alias(row)), file, row
    made = docs.withColumn(at, F.monotonically_increasing_id())
    number = F.lpad(F.shiftright(at, 33).cast("string"), 19, "0")
    return made.select("*", number.alias(file), F.col(at).bitwiseAND((1 << 33) - 1).alias(row)).drop(at), file, row
