"""Names and scratch tables."""

from pyspark.sql import functions as F

from depscope import scratch
from depscope.functions import names


def test_package_path(spark):
    rows = spark.createDataFrame([("a/b/c.py", "b"), ("a/b/b/x.py", "b"), ("x.py", "q"), (None, "a")], "path string, package string")
    got = [r[0] for r in rows.select(names.package_path(F.col("path"), F.col("package"))).collect()]
    assert got == ["a/b", "a/b", None, None]
    dots = spark.createDataFrame([("..a.b",), ("a",)], "n string").select(names.without_leading_dots(F.col("n"))).collect()
    assert [r[0] for r in dots] == ["a.b", "a"]


def test_scratch_tables_go_one_by_one(spark):
    first = scratch.materialise(spark.range(3), "test-a")
    path = scratch.written()[-1]
    second = scratch.materialise(spark.range(4), "test-b")
    scratch.release([path])
    assert path not in scratch.written() and second.count() == 4 and first.columns == ["id"]
