"""Parsing, discovery, import edges and whole runs on small trees."""

import ast
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from depscope.functions import globs
from depscope.operators import entities
from depscope.plans.project import Options, analyze_project
from depscope.scratch import materialise
from depscope.sources import files
from depscope.sources import python_ast as pa
from depscope.streaming.ingest import current, start_ingest

SOURCE = '''"""Doc."""
import os
import sys as system
from typing import Dict, List


class Parent:
    pass


class Child(Parent):
    """A child."""

    count: int = 0
    flag = True

    def __init__(self, name):
        self.attribute = name.upper()

    @staticmethod
    def tool():
        return 1

    @property
    def size(self):
        if self.count:
            return "x"
        return [1]

    async def wait(self):
        def inner():
            return 2
        inner()
        return await self.tool()


def busy(x):
    if x and x > 1:
        for k in range(3):
            while k:
                k -= 1
    try:
        return [y for y in x if y]
    except ValueError:
        return None
'''


def tree(folder, **texts):
    for name, text in texts.items():
        path = folder / (name.replace("__slash__", "/") + ".py")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(folder)


def read(spark, texts):
    """The nodes of sources by path."""
    files_ = spark.createDataFrame([(p, t if isinstance(t, bytes) else t.encode()) for p, t in texts.items()], "path string, content binary")
    return materialise(pa.parse_files(files_), "nodes")


def rows(frame):
    return [r.asDict(True) for r in frame.collect()]


def test_entities(spark):
    nodes = read(spark, {"pkg/mod.py": SOURCE})
    row = rows(entities.modules(nodes))[0]
    assert row["module"] == "pkg.mod" and row["docstring"] == "Doc." and row["parse_error"] is None
    assert [(i["module"], i["name"], i["alias"]) for i in sorted(rows(entities.imports(nodes)), key=lambda r: (r["line"], r["name"] or ""))] == [
        ("os", None, None), ("sys", None, "system"), ("typing", "Dict", None), ("typing", "List", None),
    ]
    child = {c["name"]: c for c in rows(entities.classes(nodes))}["Child"]
    assert child["bases"] == ["Parent"] and child["docstring"] == "A child." and child["id"] == "cls:mod:pkg.mod:Child"
    by_name = {m["name"]: m for m in rows(entities.methods(nodes))}
    assert by_name["tool"]["is_static"] and by_name["size"]["is_property"] and by_name["wait"]["is_async"]
    assert by_name["size"]["return_annotation"] == "Union[List[int], str]"
    assert by_name["__init__"]["args"][1] == {"name": "name", "annotation": "str"}
    assert by_name["busy"]["complexity"] == 7  # if, and, for, while, except, comprehension
    assert by_name["busy"]["visitor_complexity"] == 1 + 1 + 1 + 1 + 1 + 1 + 2 and by_name["busy"]["nesting"] == 3
    found = {f["name"]: f for f in rows(entities.fields(nodes))}
    assert found["count"]["type_annotation"] == "int" and found["count"]["default_value"] == "0"
    assert found["flag"]["type_annotation"] == "bool" and found["count"]["is_class_variable"]
    assert not found["attribute"]["is_class_variable"]
    calls = {e["to_entity"] for e in rows(entities.edges(nodes)) if ":wait:" in e["from_entity"] and e["relationship_type"] == "call"}
    assert {"inner", "self.tool"} <= calls  # those after a nested function stay


NESTED = """
class A:
    def outer(self, a, /, b, *c, d: int = 1, **e):
        b.get(a.strip())
        if a and b or c:
            def inner(a):
                a.append(1)
                for i in a:
                    with i:
                        try:
                            pass
                        except (A, B):
                            return {}
                class Local:
                    def __init__(self):
                        self.held = [[], 1]
                return [[x for x in a if x if a]]
            while inner:
                pass
        return lambda u: u.upper()
    class Inner(A):
        kept = several = ()
        def __init__(self):
            def later():
                self.made = 'x'
        other: "B"
async def top(q, z=lambda q: q.keys()):
    async for j in q:
        return None
"""


def plain_figures(function):
    """Complexity, by depth too, of one function, by recursion."""
    met = {"complexity": 1, "visitor_complexity": 1, "cognitive": 0, "nesting": 0}

    def down(node, level):
        kind = type(node).__name__
        met["complexity"] += kind in entities.DECISIONS
        branch = kind in ("If", "For", "While")
        met["visitor_complexity"] += branch or kind == "With"
        met["cognitive"] += (1 + level) * branch
        if kind == "Try":
            met["visitor_complexity"] += len(node.handlers)
            met["cognitive"] += len(node.handlers)
        if kind == "BoolOp":
            met["visitor_complexity"] += len(node.values) - 1
        if kind == "comprehension":
            met["visitor_complexity"] += 1 + len(node.ifs)
        level += kind in entities.NESTING
        met["nesting"] = max(met["nesting"], level)
        for child in ast.iter_child_nodes(node):
            down(child, level)

    for child in ast.iter_child_nodes(function):
        down(child, 0)
    return met


def test_figures_by_range_are_those_by_recursion(spark):
    own = Path(entities.__file__).parent
    texts = {"nested.py": NESTED, "src.py": SOURCE} | {p.name: p.read_text() for p in own.glob("*.py")}
    nodes = read(spark, texts)
    got = {(m["path"], m["line"]): {k: m[k] for k in ("complexity", "visitor_complexity", "cognitive", "nesting")} for m in rows(entities.methods(nodes))}
    want = {
        (path, n.lineno): plain_figures(n)
        for path, text in texts.items() for n in ast.walk(ast.parse(text)) if isinstance(n, pa.FUNCTION)
    }
    assert got == want and len(got) > 100
    for path, text in texts.items():  # every node that isn't silent has a row, and a node's range holds what is below it
        count = sum(not isinstance(n, pa.SILENT) for n in ast.walk(ast.parse(text)))
        assert nodes.where(F.col("path") == path).agg(F.count("*"), F.max("n"), F.max(F.when(F.col("n") == 0, F.col("last")))).first() == (count, count - 1, count - 1)


def test_nested_scopes(spark):
    nodes = read(spark, {"m.py": NESTED})
    by_name = {(m["name"], m["class_id"]): m for m in rows(entities.methods(nodes))}
    outer, inner = by_name["outer", "cls:mod:m:A"], by_name["inner", "cls:mod:m:A"]
    assert [(a["name"], a["annotation"]) for a in outer["args"]] == [("self", None), ("a", "List"), ("b", "Dict"), ("c", None), ("d", "int"), ("e", None)]
    assert outer["return_annotation"] == inner["return_annotation"] == "Union[Dict, List]"
    assert [(a["name"], a["annotation"]) for a in by_name["top", None]["args"]] == [("q", "Dict"), ("z", None)]
    assert by_name["top", None]["return_annotation"] == "None" and by_name["top", None]["is_async"]
    assert {(f["id"], f["type_annotation"], f["default_value"], f["is_class_variable"]) for f in rows(entities.fields(nodes))} == {
        ("field:cls:mod:m:Local:held", "List[List]", "[[], 1]", False), ("field:cls:mod:m:Inner:kept", "Tuple", "()", True),
        ("field:cls:mod:m:Inner:several", "Tuple", "()", True), ("field:cls:mod:m:Inner:made", "str", "'x'", False),
        ("field:cls:mod:m:Inner:other", "'B'", None, True),
    }


def test_deep_sources_keep_their_rows(spark):
    """Chains that Python parses are read, however long; half a surrogate pair stands as its escape."""
    chain = "if x:\n    pass\n" + "elif x:\n    pass\n" * 600 + "class A:\n    y = " + "+".join("1" * 2000) + "\n"
    nodes = read(spark, {"a.py": f"def f(x):\n{textwrap.indent(chain, '    ')}", "b.py": "def f():\n    '\\udc80'.join(1)\n"})
    assert {r["parse_error"] for r in rows(entities.modules(nodes))} == {None}
    long = {m["path"]: m for m in rows(entities.methods(nodes))}["a.py"]
    assert (long["complexity"], long["nesting"], long["cognitive"]) == (602, 601, 601 * 602 // 2)
    assert {e["to_entity"] for e in rows(entities.edges(nodes))} == {"\\udc80.join"}


def test_pieces_are_the_source():
    text = "def f():\r\n    é = 1\r    return 'ü'\n\x0cclass A:\n  def g(self): return 2; x = 1\n"
    tree_ = ast.parse(text)
    lines = pa.Lines(text)
    for node in ast.walk(tree_):
        if isinstance(node, ast.FunctionDef):
            assert lines.piece(node) == ast.get_source_segment(text, node)


def test_broken_source_keeps_its_row(spark):
    nodes = read(spark, {"a.py": "def f(:\n", "b.py": "x = (1", "c.py": "a\0b", "d.py": "", "e.py": "x = 1"})
    assert {r["path"]: r["parse_error"] is None for r in rows(entities.modules(nodes))} == {"a.py": False, "b.py": False, "c.py": False, "d.py": True, "e.py": True}
    assert nodes.where("path < 'e.py'").count() == 4
    assert all(made(nodes).isEmpty() for made in entities.TABLES.values())


def edges_of(spark, folder, **options):
    run = analyze_project(spark, folder, Options(exclude=[], **options))
    return {f"{r['dst']} -> {r['src']}" for r in run.import_edges.collect()}


def test_relative_imports(spark, tmp_path):
    root = tree(tmp_path, r__slash____init__="", r__slash__a="from . import b", r__slash__b="from . import c", r__slash__c="")
    assert {"r.b -> r.a", "r.c -> r.b"} <= edges_of(spark, root)


def test_upward_import_and_cycle(spark, tmp_path):
    root = tree(
        tmp_path, r__slash____init__="", r__slash__a__slash____init__="", r__slash__a__slash__am="from ..b import bm",
        r__slash__b__slash____init__="", r__slash__b__slash__bm="from r.a import am",
    )
    run = analyze_project(spark, root, Options(exclude=[]))
    found = {f"{r['dst']} -> {r['src']}" for r in run.import_edges.collect()}
    assert {"r.b -> r.a.am", "r.b.bm -> r.a.am"} <= found
    assert sorted(r["node"] for r in run.tables["cycle_members"].collect()) == ["r.a.am", "r.b.bm"] and run.cycles.count() == 1
    assert {r["kind"]: r["n"] for r in run.get_entity_count().collect()}["module"] == 5


def test_stdlib_missing_and_filters(spark, tmp_path):
    root = tree(tmp_path, a="import collections\nimport nowhere\nimport b", b="")
    assert edges_of(spark, root) == {"b -> a"}
    assert edges_of(spark, root, include_stdlib=True) == {"b -> a", "collections -> a"}
    assert edges_of(spark, root, include_missing=True) == {"b -> a", "nowhere -> a"}
    assert edges_of(spark, root, exclude_exact=["b"]) == set()
    assert edges_of(spark, root, only=["c"]) == set()


def test_discovery_and_size(spark, tmp_path):
    root = tree(tmp_path, main="x = 1", tests__slash__t="", deep__slash____pycache____slash__c="", deep__slash__ok="", _hid="", deep__slash___slash__x="1")
    found = files.source_files(spark, root)
    assert sorted(r["path"] for r in found.collect()) == ["_hid.py", "deep/_slash__x.py", "deep/ok.py", "main.py"]
    assert files.project_size(files.listing(spark, root)).first()["tier"] == "low"
    assert files.manifest(found).count() == 4
    for least in (1, 2):  # folders handed on from round to round
        assert files.listing(spark, root, per_task=least).count() == 4
    assert files.without_parts(files.listing(spark, root), root, ["deep"]).count() == 2


def test_checks_before_a_run(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    (tmp_path / "file.py").write_text("")
    for bad in ("relative/path", str(tmp_path / "gone"), str(tmp_path / "file.py"), str(tmp_path / "empty")):
        with pytest.raises(ValueError):
            files.precheck(spark, bad)
        with pytest.raises(ValueError):
            analyze_project(spark, bad)
    assert files.precheck(spark, f" {tmp_path} ").count() == 1
    assert files.precheck(spark, str(tmp_path), ["empty"]).count() == 1


def test_package_roots(spark, tmp_path):
    root = tree(tmp_path, src__slash__p____slash____init__="", src__slash__p____slash__q__slash____init__="", src__slash__p____slash__q__slash__m="", src__slash__tool="")
    got = {r["path"]: (r["kind"], r["package_root"]) for r in files.package_roots(files.listing(spark, root)).collect()}
    assert got["src/p__/q/m.py"] == ("package", "src") and got["src/tool.py"] == ("directory", "src")
    tree(tmp_path, __init__="", src__slash____init__="")
    got = {r["path"]: r["package_root"] for r in files.package_roots(files.listing(spark, root)).collect()}
    assert set(got.values()) == {None}


def test_distribution_names(spark, tmp_path):
    for folder, text in (("a/Foo_Bar-1.2.dist-info", "foo\nfoo/sub\n"), ("a/Old.egg/EGG-INFO", "old"), ("b/Other-3.egg-info", "foo"), ("b/x", "no")):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "top_level.txt").write_text(text)
    got = dict(map(tuple, files.distribution_names(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()))
    assert got == {"yaml": "PyYAML", "Crypto": "pycrypto", "foo": "Foo-Bar", "foo.sub": "Foo-Bar", "old": "Old"}


def test_hops_from_a_root_that_imports_all(spark, tmp_path):
    root = tree(tmp_path, a="import b", b="import a\nimport json", migrations__slash__m="", c__slash__class="")
    run = analyze_project(spark, root, Options(exclude=[], max_depth=1))
    assert {(r["src"], r["dst"]) for r in run.import_edges.collect()} == {("a", "b"), ("b", "a")}
    depth = {r["node"]: r["depth"] for r in run.hops.collect()}
    assert depth == {"__main__": 0, "a": 1, "b": 1}
    found = {r["name"]: (r["in_cycle"], r["severity"]) for r in run.search("A").collect()}
    assert found["a"] == (True, "medium") and found["c.class"] == (False, None)
    assert {r["path"] for r in run.manifest.collect()} == {"a.py", "b.py", "migrations/m.py", "c/class.py"}


def test_globs(spark):
    paths = ["a/b/c.py", "x/test_a.py", "x/keep/test_b.py", "top.py", "lib/top.py"]
    rows_ = spark.createDataFrame([(p,) for p in paths], "p string")

    def kept(patterns):
        return [r["p"] for r in rows_.where(~globs.excluded(rows_["p"], patterns)).collect()]

    assert kept(["test_*", "!**/test_b.py"]) == ["a/b/c.py", "x/keep/test_b.py", "top.py", "lib/top.py"]
    assert kept(["/top.py"]) == [p for p in paths if p != "top.py"]
    assert kept(["keep/"]) == [p for p in paths if "keep" not in p]
    assert kept(["a/**"]) == paths[1:] and kept(["a/b/**"]) == paths[1:]  # a/b is in a, so it isn't entered
    assert kept(["/lib"]) == paths[:4] and kept(["**/keep"]) == [p for p in paths if "keep" not in p]
    assert kept(["# c", ""]) == paths
    for patterns in (["test_*", "!**/test_b.py"], ["/lib"], ["keep/"], ["a/**"], ["a/b/**"], ["**/keep"], ["*b*/", "!b"], ["**"], ["top.[!x]y"]):
        matcher = globs.Matcher(patterns)
        walked = [p for p in paths if not any(matcher.hits("/".join(p.split("/")[:n]), n < len(p.split("/"))) for n in range(1, 1 + len(p.split("/"))))]
        assert kept(patterns) == walked


def test_pattern_rules():
    bad = ["", " ", "# c", "a\x01", "a****", "a///b", "a[b", "a[]b", "a\\b", "a....b", "a" * 256, "**/**/**/**/x"]
    assert all(globs.invalid_reason(p) for p in bad) and len({globs.invalid_reason(p) for p in bad}) == 11
    assert not any(globs.invalid_reason(p) for p in ("*.py", "../x", "a<b", "a***", "!keep", "a//b", "**/x/**"))


def test_stream_ingest(spark, tmp_path):
    root = tree(tmp_path / "src", a="import b", b="class B: pass", bad="def (", p__slash____init__="", tests__slash__t="")
    seen = []

    def ingest():
        query = start_ingest(spark, root, str(tmp_path / "out"), str(tmp_path / "state"), seen.append, per_batch=2)
        query.awaitTermination(120)
        return current(spark, str(tmp_path / "out"))

    def batch():
        return sorted(map(str, pa.parse_files(files.source_files(spark, root)).collect()))

    found = ingest()
    assert found.where("n = 0").count() == 4 and found.where("parse_error IS NOT NULL").count() == 1
    assert len(seen) == 2 and sorted(map(str, found.collect())) == batch()
    tree(tmp_path / "src", late="x = 1", b="class Other:\n    y = 2\n")  # one more, and one edited
    (tmp_path / "src" / "a.py").unlink()
    assert sorted(map(str, ingest().collect())) == batch() and len(seen) == 4
    assert sorted(map(str, ingest().collect())) == batch() and len(seen) == 4  # nothing new
    tree(tmp_path / "src", a="import late")  # back again
    found = ingest()
    assert sorted(map(str, found.collect())) == batch() and len(seen) == 5
    assert [c["name"] for c in rows(entities.classes(found))] == ["Other"]


def test_tables_of_the_nodes_they_read(spark):
    """A table made of no other columns and nodes than it reads has the same rows, and columns that aren't wanted are never made."""
    texts = [("a.py", SOURCE.encode()), ("b.py", Path(pa.__file__).read_bytes()), ("c.py", b"def (:")]
    source = spark.createDataFrame(texts, "path string, content binary")
    every = materialise(pa.parse_files(source), "nodes")
    for name, (columns, rows) in entities.READS.items():
        few = materialise(pa.parse_files(source, columns.split()).where(rows), "nodes")
        assert few.columns == [c for c in every.columns if c in columns.split()] and few.count() < every.count()
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in every.schema if f.name not in few.columns]
        kept = [c for c in entities.TABLES[name](every).columns if c not in ("docstring", "body_text")]
        got, want = (entities.TABLES[name](x).select(kept).collect() for x in (few.select("*", *missing), every))
        assert sorted(map(str, got)) == sorted(map(str, want)) and want
    assert "text" not in pa.parse_source("a.py", SOURCE, frozenset({"name"}))[-1] and "content_md5" not in pa.parse_source("a.py", SOURCE, frozenset())[0]
