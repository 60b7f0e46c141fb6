"""Edge cases of the relational operators."""

import random
from itertools import combinations

from depscope.operators import hierarchy, incremental, paging, quality, resolve


def test_resolution_order(spark):
    nodes = spark.createDataFrame([("mod:a.b", "a.b"), ("cls:mod:x:Thing", "other"), ("mod:long.name", "long.name")], "id string, name string")
    names = spark.createDataFrame([("a.b",), ("Thing",), ("ong.na",), ("none",), (None,), ("",)], "name string")
    got = {r["name"]: (r["id"], r["how"]) for r in resolve.resolve_targets(names, nodes).collect()}
    assert got["a.b"] == ("mod:a.b", "exact") and got["Thing"] == ("cls:mod:x:Thing", "suffix")
    assert got["ong.na"] == ("mod:long.name", "contains") and got["none"] == ("mod:none", "new")


def test_prefix_parent(spark):
    long = "x" * 300
    children = spark.createDataFrame([("a.b.c",), ("a",), ("z",), (long + "y",), (None,), ("",)], "child string")
    parents = spark.createDataFrame([("a",), ("a.b",), ("a.b.c",), (long,), (None,), ("",)], "parent string")
    got = dict(map(tuple, resolve.longest_prefix_parent(children, parents).collect()))
    assert got == {"a.b.c": "a.b", "a": None, "z": None, long + "y": long, None: None, "": None}
    assert resolve.longest_prefix_parent(children, parents.limit(0)).where("parent IS NOT NULL").count() == 0


def test_cohesion(spark):
    usage = spark.createDataFrame([("c", "m1", "f"), ("c", "m2", "f"), ("c", "m3", None), ("d", "m", None)], "class_id string, method_id string, field string")
    got = {r["class_id"]: (r["sharing"], r["lcom"], r["tcc"]) for r in quality.cohesion(usage).collect()}
    assert got == {"c": (1, 1.0, 2 / 3), "d": (0, 0.0, 0.0)}
    unused = spark.createDataFrame([("e", "m1", None), ("e", "m2", None), ("f", "m", None)], "class_id string, method_id string, field string")
    fields = spark.createDataFrame([("e",), (None,)], "class_id string")
    got = {r["class_id"]: (r["lcom"], r["tcc"]) for r in quality.cohesion(unused, fields).collect()}
    assert got == {"e": (1.0, 0.0), "f": (0.0, 0.0)}


def test_cohesion_counts_pairs(spark):
    pick = random.Random(4)
    rows = [(f"c{k % 3}", f"m{k}", pick.choice(["f", "g", "h", None])) for k in range(40) for _ in range(3)]
    usage = spark.createDataFrame(rows, "class_id string, method_id string, field string")
    fields = {}
    for c, m, f in rows:
        fields.setdefault(c, {}).setdefault(m, set()).update({f} - {None})
    want = {c: sum(bool(a & b) for a, b in combinations(own.values(), 2)) for c, own in fields.items()}
    assert {r["class_id"]: r["sharing"] for r in quality.cohesion(usage).collect()} == want


def test_field_usage(spark):
    methods = spark.createDataFrame([("c", "m1", "self.size + 1"), ("c", "m2", "pass"), (None, "f", "size"), ("d", "m", None)], "class_id string, id string, body_text string")
    fields = spark.createDataFrame([("c", "size"), ("c", "name"), ("d", "x"), (None, "q")], "class_id string, name string")
    got = {tuple(r) for r in quality.field_usage(methods, fields).collect()}
    assert got == {("c", "m1", "size"), ("c", "m2", None), ("d", "m", None)}


def test_panel_matrix_and_circle(spark):
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("a", "b"), ("a", "d"), ("b", "a"), (None, "a")], "src string, dst string")
    got = {r["node"]: tuple(r)[1:] for r in hierarchy.in_out_panel(edges).collect()}
    assert got == {"a": (4, 1, "b,c", "b"), "b": (1, 2, "a", "a"), "c": (0, 1, "", "a"), "d": (0, 1, "", "a")}
    nodes = spark.createDataFrame([(k,) for k in range(50)], "id long")
    assert [(r["rank"], r["id"]) for r in hierarchy.circle(nodes, nodes["id"]).orderBy("id").collect()] == [(k, k) for k in range(50)]
    assert hierarchy.circle(nodes.limit(0), nodes["id"]).count() == 0


def test_tree_search_climbs(spark):
    rows = [("p", "Root", 0, "package", None), ("m", "mid", 1, "module", "p"), ("f", "Needle", 3, "method", "m"), ("x", "needle", 4, "field", "gone"), ("q", "other", 0, "package", None)]
    nodes = spark.createDataFrame(rows, "id string, name string, level int, kind string, parent_id string")
    got = {r["id"]: r["matched"] for r in hierarchy.tree_search(nodes, "NEEDLE").collect()}
    assert got == {"p": False, "m": False, "f": True, "x": True}


def test_incremental(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, fingerprint string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, fingerprint string")
    status = incremental.compare(old, new)
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    actions = dict(map(tuple, incremental.plan(status, edges).collect()))
    assert actions == {"a": "analyse", "b": "analyse", "c": "drop", "d": "analyse"}
    assert incremental.cache_key("p", {"b": 1, "a": 2}) == incremental.cache_key("p", {"a": 2, "b": 1})


def test_search_and_orphans(spark):
    nodes = spark.createDataFrame([("1", "Alpha", 0, "package", None), ("2", "beta", 1, "module", "9")], "id string, name string, level int, kind string, parent_id string")
    assert paging.search(nodes, "").count() == 0 and paging.search(nodes, "ALP").count() == 1
    assert hierarchy.orphans(nodes).count() == 2


def test_siblings_in_the_order_of_a_reader(spark):
    names = ["zeta", "\u00c9clair", "eclair", "Eclair", "\u00e9clair", "alpha", "Beta", "alp", "_x", "10", "9", "alpha", None, "\u00e6on", "Zeta"]
    nodes = spark.createDataFrame([(k, "top", 3, n) for k, n in enumerate(names)] + [(99, "top", 2, "zz")], "id int, parent_id string, level int, name string")
    placed = hierarchy.tree_order(nodes).orderBy("position").collect()
    assert [r["name"] for r in placed] == [
        "zz", None, "_x", "10", "9", "\u00e6on", "alp", "alpha", "alpha", "Beta", "eclair", "Eclair", "\u00e9clair", "\u00c9clair", "zeta", "Zeta",
    ]
    assert placed[7]["id"] < placed[8]["id"] and [r["position"] for r in placed] == list(range(1, 17))
