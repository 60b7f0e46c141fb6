"""Runs are stored, found again, expired and deleted."""

import os
from datetime import UTC, datetime, timedelta

import pytest

from depscope.plans.project import Options, analyze_project
from depscope.plans.runs import RunStore


def test_store(spark, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    (source / "a.py").write_text("import b\n")
    (source / "b.py").write_text("class B:\n    def run(self):\n        return 1\n")
    store = RunStore(spark, str(tmp_path / "runs"))
    assert store.keys() == []
    run = store.analyze(str(source), Options(exclude=[]))
    assert [tuple(r) for r in run.import_edges.collect()] == [("a", "b")]
    key = store.key(str(source), Options(exclude=[]))
    assert store.keys() == [key] and store.listing().first()["total_files"] == 2
    assert run.class_quality.first()["grade"] == "A"
    assert store.expire(datetime.now()) == [] and store.expire(datetime.now() + timedelta(days=9)) == [key]
    with pytest.raises(KeyError):
        store.load(key)


def rows_of(run):
    """The tables of a run that don't say when it was made."""
    plain = ("modules", "classes", "methods", "fields", "import_edges", "edges", "nodes", "cycles", "coupling", "class_quality", "hops", "manifest")
    return {n: sorted(map(str, run.tables[n].collect())) for n in plain}


def test_only_what_changed_is_parsed_again(spark, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    for name, text in {"a": "import b", "b": "import c", "c": "x = 1", "d": "", "e": "import d", "f": "", "g": ""}.items():
        (source / f"{name}.py").write_text(text)
    store, options = RunStore(spark, str(tmp_path / "runs")), Options(exclude=[])
    assert store.analyze(str(source), options).run.first()["parsed_files"] == 7
    first = store.load(store.key(str(source), options)).run.first()["analysis_id"]
    assert store.analyze(str(source), options).run.first()["analysis_id"] == first
    for name in "abf":  # touched only
        os.utime(source / f"{name}.py", (1, 1))
    assert store.analyze(str(source), options).run.first()["analysis_id"] == first
    (source / "c.py").write_text("import a\nclass New:\n    pass\n")
    (source / "d.py").unlink()
    run = store.analyze(str(source), options)
    assert run.run.first()["parsed_files"] == 3  # c, and b and e that import c and d
    assert rows_of(run) == rows_of(analyze_project(spark, str(source), options))
    assert sorted(r["node"] for r in run.tables["cycle_members"].collect()) == ["a", "b", "c"] and run.cycles.count() == 1
    for name in "abcef":
        (source / f"{name}.py").write_text(f"{name} = 22\n")
    assert store.analyze(str(source), options).run.first()["parsed_files"] == 6  # most has changed: a whole run
    late = datetime.now(UTC) + timedelta(days=8)
    again = store.analyze(str(source), options, now=late).run.first()
    assert again["parsed_files"] == 6 and again["analysis_id"] != first


def test_search_statistics_and_eviction(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    assert store.search("x").count() == 0 and store.statistics()["cache_count"] == 0
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "shared.py").write_text("class Shared:\n    pass\n")
        store.analyze(str(tmp_path / name))
    one, two = (store.key(str(tmp_path / n), Options()) for n in ("one", "two"))
    assert store.status(one) == "completed" and store.status("none") == "unknown"
    assert store.search("SHARED").count() == 4 and store.search("shared", two).count() == 2 and store.search("").count() == 0
    assert store.statistics()["cache_count"] == 2 and store.evict(500) == []
    size = store.sizes().where(f"id = '{two}'").first()["size"]
    assert store.evict((size + 10) / (1 << 20)) == [one] and store.keys() == [two]
    store.clear()
    assert store.keys() == []
