"""An index of names finds what a scan finds, and reads little."""

import pytest
from pyspark.sql import functions as F

from depscope.operators import name_index, paging

NAMES = ["alpha", "Alphabet", "al", "a", "ALP", "", None, "x", "beta", "eta", "\u00c9t\u00e9 au lait", "aaaa", "ab" * 500, "alpha", "\U0001f600y"]
TEXTS = ["alp", "ALPHA", "a", "ET", "\u00e9t\u00e9", "aaa", "abab", "zzz", "alx", "", "lpha", "\U0001f600", "a" * 50, "baba" * 20]


@pytest.mark.parametrize("folder", [2, 100_000])
def test_as_a_scan(spark, tmp_path, monkeypatch, folder):
    monkeypatch.setattr(name_index, "FOLDER", folder)
    nodes = spark.createDataFrame([(k, n, "c", k % 3) for k, n in enumerate(NAMES)], "id int, name string, key string, folder int")
    name_index.build(nodes, str(tmp_path / "index"))
    for text in TEXTS:
        found = name_index.search(spark, str(tmp_path / "index"), text)
        assert found.columns == nodes.columns
        assert sorted(found.collect()) == sorted(paging.search(nodes, text).collect()), text


def test_no_names(spark, tmp_path):
    name_index.build(spark.createDataFrame([(1, None)], "id int, name string"), str(tmp_path / "index"))
    assert name_index.search(spark, str(tmp_path / "index"), "abc").collect() == []


def test_runs_are_pushed_to_the_files(spark, tmp_path):
    nodes = spark.range(2000).select("id", F.concat(F.lit("n"), F.col("id")).alias("name"))
    name_index.build(nodes, str(tmp_path / "index"))
    found = name_index.search(spark, str(tmp_path / "index"), "N1999")
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(run" in plan and "dynamicpruning" in plan
    assert [r["id"] for r in found.collect()] == [1999]
