"""Entities, edges and figures of sources, as relations over the table of syntax nodes (``sources.python_ast``).

A node holds those numbered up to its ``last``, so which functions lie in which is a join by range. With it, a function's
figures are aggregates over all that is inside, nested functions included. The innermost scope is an equal join. ``nodes`` is
read several times and should be a written table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Methods that tell a parameter's type; the last call in the body decides.
TELLS = {
    "str": ("upper", "lower", "strip", "replace", "split", "join"),
    "List": ("append", "extend", "remove", "pop", "index", "count"),
    "Dict": ("get", "keys", "values", "items", "update"),
}
#: Nodes that are decision points, and those that nest what is inside them.
DECISIONS = ["If", "While", "For", "AsyncFor", "ExceptHandler", "BoolOp", "comprehension"]
NESTING = ["If", "For", "While", "Try", "With"]
FUNCTIONS = ["FunctionDef", "AsyncFunctionDef"]


def _module_id() -> Column:
    return F.concat(F.lit("mod:"), "module")


def modules(nodes: DataFrame) -> DataFrame:
    """(path, module_id, module, docstring, physical_lines, logical_lines, parse_error), a row for each file."""
    return nodes.where("n = 0").select(
        "path", _module_id().alias("module_id"), "module", "docstring", "physical_lines", "logical_lines", "parse_error"
    )


def imports(nodes: DataFrame) -> DataFrame:
    """(path, module_id, module, name, alias, line, import_type, is_relative, level), a row for each imported name."""
    level = F.coalesce("size", F.lit(0))
    return nodes.where("kind = 'alias'").select(
        "path", _module_id().alias("module_id"), F.coalesce("of", "name").alias("module"),
        F.when(F.col("of").isNotNull(), F.col("name")).alias("name"), "alias", "line",
        F.when(F.col("of").isNull(), "import").otherwise("from_import").alias("import_type"),
        (level > 0).alias("is_relative"), level.alias("level"),
    )


def _class_ids(nodes: DataFrame) -> DataFrame:
    """(path, in_class, class_id): each class by its number, as nodes inside name it."""
    made = F.concat(F.lit("cls:"), _module_id(), F.lit(":"), "name")
    return nodes.where("kind = 'ClassDef'").select("path", F.col("n").alias("in_class"), made.alias("class_id"))


def _names_in(nodes: DataFrame, role: str) -> DataFrame:
    """(path, n, <role>): the dotted names that a node has in a role, in order."""
    own = nodes.where((F.col("role") == role) & F.col("dotted").isNotNull())
    listed = F.transform(F.sort_array(F.collect_list(F.struct("n", "dotted"))), lambda x: x["dotted"])
    return own.groupBy("path", F.col("parent").alias("n")).agg(listed.alias(role))


def _listed(column: str) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def classes(nodes: DataFrame) -> DataFrame:
    """(path, module_id, id, name, line, bases, decorators, docstring, is_abstract)."""
    ids = _class_ids(nodes).select("path", F.col("in_class").alias("n"), F.col("class_id").alias("id"))
    own = nodes.where("kind = 'ClassDef'").select("path", "n", _module_id().alias("module_id"), "name", "line", "docstring")
    met = own.join(ids, ["path", "n"])
    for role in ("bases", "decorator_list"):
        met = met.join(_names_in(nodes, role), ["path", "n"], "left")
    abstract = F.exists(_listed("decorator_list"), lambda d: F.lower(d).contains("abc") | F.lower(d).contains("abstract"))
    return met.select(
        "path", "module_id", "id", "name", "line", _listed("bases").alias("bases"), _listed("decorator_list").alias("decorators"),
        "docstring", abstract.alias("is_abstract"),
    )


def _functions(nodes: DataFrame) -> DataFrame:
    """(path, n, last, id, class_id, …): functions with their ids and the class around them."""
    own = nodes.where(F.col("kind").isin(FUNCTIONS)).join(_class_ids(nodes), ["path", "in_class"], "left")
    tail = F.concat(F.lit(":"), "name", F.lit(":"), "line")
    made = F.when(F.col("class_id").isNotNull(), F.concat(F.lit("meth:"), "class_id", tail)).otherwise(
        F.concat(F.lit("func:"), _module_id(), tail)
    )
    return own.withColumn("id", made)


def _with_nesting(nodes: DataFrame) -> DataFrame:
    """Nodes that count in a function's figures, and functions, with ``nest``: how many nesting nodes are around each.

    A running sum: a nesting node adds one to what follows it, and takes it back behind its last number."""
    nests = F.col("kind").isin(NESTING)
    counted = nodes.where(F.col("kind").isin(sorted({*DECISIONS, *NESTING, *FUNCTIONS})))
    row = counted.select("path", F.col("n").alias("at"), nests.cast("int").alias("step"), F.lit(0).alias("close"), "n", "in_function", "kind", "size")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("n", "int"), ("in_function", "int"), ("kind", "string"), ("size", "int"))]
    close = counted.where(nests).select("path", F.col("last").alias("at"), F.lit(-1).alias("step"), F.lit(1).alias("close"), *nothing)
    before = Window.partitionBy("path").orderBy("at", "close").rowsBetween(Window.unboundedPreceding, -1)
    around = row.unionByName(close).withColumn("nest", F.coalesce(F.sum("step").over(before), F.lit(0)))
    return around.where("close = 0").select("path", "n", "in_function", "kind", "size", "nest")


def _around(nodes: DataFrame) -> DataFrame:
    """(path, in_function, f): each function with itself and every function around it.

    Only functions that hold others are compared by range, so a file with many of them costs no product."""
    own = nodes.where(F.col("kind").isin(FUNCTIONS)).select("path", "n", "last", "in_function")
    inner = own.select("path", F.col("n").alias("in_function"))
    holders = own.where("in_function IS NOT NULL").select("path", F.col("in_function").alias("n")).distinct()
    outer = own.join(holders, ["path", "n"], "left_semi").select("path", F.col("n").alias("f"), "last")
    nested = outer.join(inner, "path").where("in_function > f AND in_function <= last")
    return inner.withColumn("f", F.col("in_function")).unionByName(nested.select("path", "in_function", "f"))


def _inside(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` of ``nodes`` with the number ``f`` of each function around them, innermost or not."""
    return rows.join(_around(nodes), ["path", "in_function"])


def complexity(nodes: DataFrame) -> DataFrame:
    """(path, f, complexity, visitor_complexity, cognitive, nesting) of functions that have a decision point inside.

    complexity counts decision points. The others go by depth: each branch or loop adds to cognitive one more for each
    nesting node around it in the function, and nesting is the most there are."""
    counted = _with_nesting(nodes)
    is_function = F.col("kind").isin(FUNCTIONS)
    own = counted.where(is_function).select("path", F.col("n").alias("f"), F.col("nest").alias("outside"))
    branch, tries = F.col("kind").isin("If", "For", "While"), F.col("kind") == "Try"
    weight = (
        F.when(branch | (F.col("kind") == "With"), 1).when(tries, F.col("size")).when(F.col("kind") == "BoolOp", F.col("size") - 1)
        .when(F.col("kind") == "comprehension", F.col("size") + 1).otherwise(0)
    )
    summed = _inside(counted.where(~is_function), nodes).groupBy("path", "f").agg(
        (1 + F.count_if(F.col("kind").isin(DECISIONS))).alias("complexity"),
        (1 + F.sum(weight)).alias("visitor_complexity"),
        F.count_if(branch).alias("branches"),
        F.sum(F.when(branch, 1 + F.col("nest")).when(tries, F.col("size")).otherwise(0)).alias("mental"),
        F.max(F.when(F.col("kind").isin(NESTING), F.col("nest") + 1)).alias("deepest"),
    )
    figures = {
        "complexity": F.col("complexity"), "visitor_complexity": F.col("visitor_complexity"),
        "cognitive": F.col("mental") - F.col("branches") * F.col("outside"),
        "nesting": F.coalesce(F.col("deepest") - F.col("outside"), F.lit(0)),
    }
    return summed.join(own, ["path", "f"]).select("path", "f", *[c.cast("int").alias(n) for n, c in figures.items()])


def _told(nodes: DataFrame) -> DataFrame:
    """(path, f, name, told): the type that the last call on a name tells; a deeper call counts as later."""
    kind = F.lit(None).cast("string")
    for shown, methods in TELLS.items():
        kind = F.when(F.col("name").isin(*methods), shown).otherwise(kind)
    calls = nodes.where("role = 'func' AND of IS NOT NULL").select("path", "n", "depth", "in_function", F.col("of").alias("name"), kind.alias("told"))
    met = _inside(calls.where("told IS NOT NULL"), nodes)
    return met.groupBy("path", "f", "name").agg(F.max_by("told", F.struct("depth", "n")).alias("told"))


def _arguments(nodes: DataFrame) -> DataFrame:
    """(path, f, args): names with annotations, else with the types that calls tell. A function's list of arguments is the
    node behind it, so those of a lambda inside stay out."""
    own = nodes.where("kind = 'arg'").select("path", (F.col("parent") - 1).alias("f"), F.col("n").alias("place"), "name", "annotation")
    functions = nodes.where(F.col("kind").isin(FUNCTIONS)).select("path", F.col("n").alias("f"))
    met = own.join(functions, ["path", "f"], "left_semi").join(_told(nodes), ["path", "f", "name"], "left")
    shown = F.struct("place", "name", F.coalesce("annotation", "told").alias("annotation"))
    listed = F.transform(F.sort_array(F.collect_list(shown)), lambda x: F.struct(x["name"].alias("name"), x["annotation"].alias("annotation")))
    return met.groupBy("path", "f").agg(listed.alias("args"))


def _returned(nodes: DataFrame) -> DataFrame:
    """(path, f, returned): the one type of all returned values, or their union."""
    met = _inside(nodes.where("kind = 'Return' AND shows IS NOT NULL").select("path", "in_function", "shows"), nodes)
    kinds = F.sort_array(F.collect_set("shows"))
    union = F.when(F.size(kinds) > 1, F.concat(F.lit("Union["), F.array_join(kinds, ", "), F.lit("]"))).otherwise(kinds[0])
    return met.groupBy("path", "f").agg(union.alias("returned"))


def methods(nodes: DataFrame) -> DataFrame:
    """(path, module_id, id, name, class_id, line, args, return_annotation, decorators, is_async, is_static,
    is_class_method, is_property, complexity, visitor_complexity, cognitive, nesting, docstring, body_text)."""
    own = _functions(nodes)
    met = own.select(
        "path", F.col("n").alias("f"), _module_id().alias("module_id"), "id", "name", "class_id", "line", "annotation", "kind",
        "docstring", F.col("text").alias("body_text"),
    )
    marks = _names_in(nodes, "decorator_list").withColumnRenamed("n", "f")
    for more in (marks, complexity(nodes), _arguments(nodes), _returned(nodes)):
        met = met.join(more, ["path", "f"], "left")
    marked = _listed("decorator_list")
    none = F.array().cast("array<struct<name:string,annotation:string>>")
    figures = {"complexity": 1, "visitor_complexity": 1, "cognitive": 0, "nesting": 0}
    return met.select(
        "path", "module_id", "id", "name", "class_id", "line", F.coalesce("args", none).alias("args"),
        F.coalesce("annotation", "returned").alias("return_annotation"), marked.alias("decorators"),
        (F.col("kind") == "AsyncFunctionDef").alias("is_async"), F.array_contains(marked, "staticmethod").alias("is_static"),
        F.array_contains(marked, "classmethod").alias("is_class_method"), F.array_contains(marked, "property").alias("is_property"),
        *[F.coalesce(c, F.lit(least)).alias(c) for c, least in figures.items()], "docstring", "body_text",
    )


def fields(nodes: DataFrame) -> DataFrame:
    """(path, module_id, id, name, class_id, line, type_annotation, default_value, is_class_variable): names and attributes of
    self that are assigned inside a class, once for each assignment; what ``__init__`` holds belongs to the instance."""
    single = "role = 'target' AND kind = 'Name'"
    several = "role = 'targets' AND (kind = 'Name' OR (kind = 'Attribute' AND of = 'self'))"
    targets = nodes.where(f"in_class IS NOT NULL AND (({single}) OR ({several}))").select("path", "n", "parent", "in_function", "in_class", "name", _module_id().alias("module_id"))
    assigned = nodes.where("kind IN ('Assign', 'AnnAssign')").select("path", F.col("n").alias("parent"), "line", F.coalesce("annotation", "shows").alias("type_annotation"), F.col("value").alias("default_value"))
    met = targets.join(assigned, ["path", "parent"]).join(_class_ids(nodes), ["path", "in_class"])
    makers = nodes.where(F.col("kind").isin(FUNCTIONS) & (F.col("name") == "__init__")).select("path", F.col("n").alias("f"))
    held = _around(nodes).join(makers, ["path", "f"], "left_semi").select("path", "in_function", F.lit(False).alias("plain")).distinct()
    return met.join(held, ["path", "in_function"], "left").select(
        "path", "module_id", F.concat(F.lit("field:"), "class_id", F.lit(":"), "name").alias("id"), "name", "class_id", "line",
        "type_annotation", "default_value", F.coalesce("plain", F.lit(True)).alias("is_class_variable"),
    )


def edges(nodes: DataFrame) -> DataFrame:
    """(path, module_id, from_entity, to_entity, relationship_type, line, strength): classes to their bases, and functions
    to what is called and which attributes are read right inside them."""

    def made(rows: DataFrame, source: str, target: Column, kind: str, strength: float) -> DataFrame:
        return rows.select(
            "path", "module_id", F.col(source).alias("from_entity"), target.alias("to_entity"),
            F.lit(kind).alias("relationship_type"), "line", F.lit(strength).alias("strength"),
        )

    own = classes(nodes)
    bases = made(own.select("*", F.explode("bases").alias("base")), "id", F.col("base"), "inheritance", 1.0)
    around = _functions(nodes).select("path", F.col("n").alias("in_function"), "id")
    uses = nodes.where("in_function IS NOT NULL").withColumn("module_id", _module_id()).join(around, ["path", "in_function"])
    calls = made(uses.where("kind = 'Call' AND dotted IS NOT NULL"), "id", F.col("dotted"), "call", 1.0)
    read = uses.where("kind = 'Attribute' AND of IS NOT NULL AND loaded")
    return bases.unionByName(calls).unionByName(made(read, "id", F.concat("of", F.lit("."), "name"), "attribute", 0.5))


#: The tables that a run makes of its nodes.
TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "imports": imports, "classes": classes, "methods": methods, "fields": fields, "edges": edges,
}

#: Of each of these tables, for a run that makes no other: which columns of nodes it reads, and which nodes.
PLACE = "path module n parent kind role line in_function in_class name of"
HOLDERS = "kind IN ('ClassDef', 'FunctionDef', 'AsyncFunctionDef')"
READS: dict[str, tuple[str, str]] = {
    "methods": (
        f"{PLACE} last depth dotted annotation shows size",
        f"{HOLDERS} OR kind IN ('arg', 'Return', {', '.join(f"'{k}'" for k in sorted({*DECISIONS, *NESTING}))}) "
        "OR role = 'decorator_list' OR (role = 'func' AND of IS NOT NULL)",
    ),
    "fields": (f"{PLACE} last annotation value shows", f"{HOLDERS} OR kind IN ('Assign', 'AnnAssign') OR role IN ('target', 'targets')"),
    "edges": (f"{PLACE} dotted loaded", f"{HOLDERS} OR kind IN ('Call', 'Attribute') OR role IN ('bases', 'decorator_list')"),
}


def import_targets(nodes: DataFrame) -> DataFrame:
    """(src, dst) module names of imports: a relative one is resolved against its package, and
    ``from a import b`` names a and, if there is such a module, a.b."""
    package = F.when(F.col("path").endswith("__init__.py"), F.col("src")).otherwise(F.regexp_replace("src", r"(^|\.)[^.]*$", ""))
    up = F.split(package, r"\.")
    kept = F.array_join(F.slice(up, F.lit(1), F.greatest(F.size(up) - F.col("level") + 1, F.lit(0))), ".")
    base = F.when(F.col("level") == 0, F.col("module")).otherwise(
        F.regexp_replace(F.concat_ws(".", kept, F.nullif("module", F.lit(""))), r"^\.+", "")
    )
    rows = imports(nodes).withColumn("src", F.substr("module_id", F.lit(5)))
    based = rows.select("src", base.alias("base"), "name")
    known = nodes.where("n = 0").select(F.col("module").alias("dst")).distinct()
    deep = based.where("name IS NOT NULL").select("src", F.regexp_replace(F.concat_ws(".", "base", "name"), r"^\.+", "").alias("dst"))
    named = based.where("base <> ''").select("src", F.col("base").alias("dst"))
    return named.unionByName(deep.join(known, "dst", "left_semi").select("src", "dst")).where("src <> dst").distinct()
