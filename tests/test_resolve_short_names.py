"""Names of any length resolve as comparing each with all ids would."""

import random

from depscope.operators import resolve


def by_force(names, nodes):
    out = {}
    for name in {n for n in names if n is not None}:
        kinds = [
            ("exact", [i for i, n in nodes if n == name]),
            ("suffix", [i for i, _ in nodes if i.split(":")[-1] == name]),
            ("contains", [i for i, _ in nodes if name and name in i]),
        ]
        how, ids = next(((h, i) for h, i in kinds if i), ("new", [f"mod:{name}"]))
        out[name] = (min(ids), how)
    return out


def test_names_of_any_length(spark):
    pick = random.Random(1)
    nodes = [("mod:b.xyz", "one"), ("mod:a.xyw", "two"), ("q", "three"), ("cls:é.t", "four"), ("cls:zabcd", "ab")]
    nodes += [("mod:" + "".join(pick.choices("abx.:", k=pick.randrange(1, 9))), f"n{k}") for k in range(80)]
    names = ["x", "xy", "m", "od", "q", "é", "yz", "zz", "k", "xyz", ".xyw", "", "mod:", "mod:b.x", "nothing like it", "ab", None]
    names += ["".join(pick.choices("abx.", k=pick.randrange(1, 7))) for _ in range(60)]
    asked = spark.createDataFrame([(n,) for n in names], "name string")
    found = resolve.resolve_targets(asked, spark.createDataFrame(nodes, "id string, name string"))
    assert {r["name"]: (r["id"], r["how"]) for r in found.collect()} == by_force(names, nodes)
