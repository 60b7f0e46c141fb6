"""Cases that once gave wrong rows: repeated keys, names with colons, links, folders that can't be read, encodings, hot fields."""

import os
import random
from itertools import combinations

from depscope.operators import quality, resolve
from depscope.sources import files, python_ast


def test_merge_with_repeated_keys(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 1, None)], "k int, n int, tag string")
    right = spark.createDataFrame([(1, 7, "x"), (1, 3, "y"), (3, 1, "z"), (2, None, "w")], "k int, n int, tag string")
    got = sorted(map(tuple, resolve.merge_modules(left, right, "k", ["n", "tag"], "n").collect()))
    assert got == [(1, 7, "x", "both"), (2, 1, "w", "both"), (3, 1, "z", "right")]


def test_names_with_colons(spark):
    nodes = spark.createDataFrame([("q", "x:a:b"), ("r", "aa:bc"), ("s", "plain")], "name string, id string")
    names = spark.createDataFrame([("a:b",), ("b",), ("bc",), ("ai",), ("none",), ("a:bc",)], "name string")
    got = {r["name"]: (r["id"], r["how"]) for r in resolve.resolve_targets(names, nodes).collect()}
    assert got["a:b"] == ("x:a:b", "suffix") and got["b"] == ("x:a:b", "suffix") and got["bc"] == ("aa:bc", "suffix")
    assert got["ai"] == ("plain", "contains") and got["a:bc"] == ("aa:bc", "contains") and got["none"] == ("mod:none", "new")


def test_links_and_closed_folders(spark, tmp_path):
    (tmp_path / "pkg" / "real").mkdir(parents=True)
    (tmp_path / "shut").mkdir()
    for at in ("pkg/a.py", "pkg/real/b.py", "shut/c.py"):
        (tmp_path / at).write_text("x = 1\n")
    os.symlink("..", tmp_path / "pkg" / "loop")
    os.symlink("real", tmp_path / "pkg" / "link")
    os.symlink("a.py", tmp_path / "pkg" / "also.py")
    os.chmod(tmp_path / "shut", 0)
    try:
        found = {r["path"] for r in files.listing(spark, f"file://{tmp_path}", []).collect()}
    finally:
        os.chmod(tmp_path / "shut", 0o755)
    assert found - {"shut/c.py"} == {"pkg/a.py", "pkg/real/b.py", "pkg/also.py"}  # whoever is root reads all folders


def test_encodings():
    latin = "# -*- coding: latin-1 -*-\nNAME = 'é'\n\nclass A:\n    x: str = 'ü'\n".encode("latin-1")
    rows = python_ast.parse_source("a.py", latin)
    assert rows[0]["parse_error"] is None and [r["value"] for r in rows if r["kind"] == "AnnAssign"] == ["'ü'"]
    marked = python_ast.parse_source("b.py", b"\xef\xbb\xbfdef f():\n    return 'x'\n")
    assert marked[1]["text"] == "def f():\n    return 'x'"
    assert "SyntaxError" in python_ast.parse_source("c.py", b"# coding: no-such\nx = 1\n")[0]["parse_error"]
    assert python_ast.parse_source("d.py", b"x = '\xff'\n")[0]["parse_error"]


def test_cohesion_of_many_sets(spark, monkeypatch):
    """One field that all sets have, many others: pairs counted by bits equal those counted one by one."""
    pick = random.Random(5)
    rows = [("one", m, f) for m in range(90) for f in {"all", f"own{m}", f"f{pick.randrange(60)}"}]
    rows += [("two", m, f"f{pick.randrange(40)}") for m in range(120) for _ in range(pick.randrange(4))] + [("two", 500, None), ("three", 1, None)]
    usage = spark.createDataFrame(rows, "class_id string, method_id int, field string")
    want = {}
    for c in ("one", "two", "three"):
        used = {}
        for cls, m, f in rows:
            if cls == c:
                used.setdefault(m, set()).update({f} - {None})
        want[c] = (len(used), sum(bool(a & b) for a, b in combinations(used.values(), 2)))
    for heavy, light in ((20, 64), (3, 2), (20, 0)):
        monkeypatch.setattr(quality, "HEAVY", heavy)
        monkeypatch.setattr(quality, "LIGHT", light)
        got = {r["class_id"]: (r["n_methods"], r["sharing"]) for r in quality.cohesion(usage).collect()}
        assert got == want


def test_a_field_of_many_sets_costs_few_rows(spark):
    usage = spark.sql("SELECT 'c' AS class_id, m AS method_id, f AS field FROM (SELECT explode(sequence(1, 20000)) AS m) LATERAL VIEW explode(array('all', concat('own', m))) AS f")
    assert quality.cohesion(usage).first()["sharing"] == 20000 * 19999 // 2
