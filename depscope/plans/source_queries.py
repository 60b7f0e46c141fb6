"""Queries over parsed sources. The test tables hold no Python, so each customer becomes a small module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depscope import scratch
from depscope.operators import entities, quality
from depscope.plans.registry import query
from depscope.sources import files
from depscope.sources import python_ast as pa
from depscope.sources.sinks import as_json, flat_edges
from depscope.sources.tables import read_table

HEAD = '''import os
{imported}


class Order(Base):
    """An order."""

    total: int = 0

    def __init__(self, key):
        self.key = key.strip()

    @property
    def state(self) -> str:
        if self.key and self.total:
            return "open"
        return go(self.key)


{mark}def deep(x):
'''
BROKEN = "def (:\n"
#: Files that a task parses.
FILES = 10_000


def modules(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): a module m<custkey> for each customer, which imports the next one.

    Nations vary the depth of a function and the kind of import, balances mark it as async, and the files
    of one market segment don't parse.
    """
    n = F.col("c_nationkey") % 4
    following = F.concat(F.lit("m"), (F.col("c_custkey") + 1).cast("string"))
    imported = F.when(F.col("c_nationkey") > 12, F.concat(F.lit("from . import "), following)).otherwise(
        F.concat(F.lit("from "), following, F.lit(" import run as go"))
    )
    steps = F.transform(F.sequence(F.lit(0), n), lambda k: F.concat(F.repeat(F.lit("    "), k + 1), F.when(k < n, "if x:\n").otherwise("pass\n")))
    text = F.replace(F.lit(HEAD), F.lit("{imported}"), imported)
    text = F.replace(text, F.lit("{mark}"), F.when(F.col("c_acctbal") < 0, "async ").otherwise(""))
    text = F.when(F.col("c_mktsegment") == "MACHINERY", BROKEN).otherwise(F.concat(text, F.array_join(steps, "")))
    customers = read_table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    cores = spark.sparkContext.defaultParallelism
    tasks = cores * max(1, -(-customers.count() // (FILES * cores)))  # so that no core is idle in a last round
    return customers.repartition(tasks, "c_custkey").select(  # parsing is far more work than the rows' bytes show
        F.concat(F.lit("shop/m"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("path"), F.encode(text, "utf-8").alias("content")
    )


def nodes(spark: SparkSession, d: str, columns: str = "", rows: str = "true") -> DataFrame:
    """The syntax nodes of all modules. Of these only ``columns``, if given, and ``rows`` are made and written, and other columns are
    null: a query names all that its rows depend on."""
    wanted = columns.split() or pa.COLUMNS
    table = scratch.materialise(pa.parse_files(modules(spark, d), wanted).where(rows), "nodes")
    kinds = T.StructType.fromDDL(pa.NODE)
    return table.select(*[F.col(f.name) if f.name in wanted else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds])


NAMES = """a AS (SELECT 'mod:shop.m' || c_custkey AS m, c_custkey AS k, c_nationkey % 4 AS n, c_nationkey > 12 AS rel, c_acctbal < 0 AS late,
  c_mktsegment = 'MACHINERY' AS broken FROM customer), c AS (SELECT * FROM a WHERE NOT broken)"""


@query(
    f"""WITH {NAMES} SELECT m AS module_id, CAST(CASE WHEN broken THEN 1 ELSE 14 + n END AS INT) AS physical_lines,
    CAST(CASE WHEN broken THEN 1 ELSE 14 + n END AS INT) AS logical_lines, broken FROM a"""
)
def ast_modules(spark: SparkSession, d: str) -> DataFrame:
    found = entities.modules(pa.parse_files(modules(spark, d)))
    return found.select("module_id", "physical_lines", "logical_lines", F.col("parse_error").isNotNull().alias("broken"))


@query(
    f"""WITH {NAMES} SELECT m AS module_id, 'os' AS module, NULL AS name, NULL AS alias, 1 AS line, 0 AS level FROM c
    UNION ALL SELECT m, 'm' || (k + 1), 'run', 'go', 2, 0 FROM c WHERE NOT rel UNION ALL SELECT m, '', 'm' || (k + 1), NULL, 2, 1 FROM c WHERE rel"""
)
def ast_imports(spark: SparkSession, d: str) -> DataFrame:
    return entities.imports(pa.parse_files(modules(spark, d))).select("module_id", "module", "name", "alias", "line", "level")


@query(
    f"""WITH {NAMES} SELECT 'shop.m' || c.k AS src, 'shop.m' || (c.k + 1) AS dst FROM c JOIN a b ON b.k = c.k + 1 WHERE c.rel
    UNION ALL SELECT 'shop.m' || k, 'm' || (k + 1) FROM c WHERE NOT rel UNION ALL SELECT 'shop.m' || k, 'os' FROM c
    UNION ALL SELECT 'shop.m' || k, 'shop' FROM c WHERE rel"""
)
def ast_import_targets(spark: SparkSession, d: str) -> DataFrame:
    return entities.import_targets(nodes(spark, d))


@query(f"WITH {NAMES} SELECT 'cls:' || m || ':Order' AS id, 'Order' AS name, 5 AS line, 'Base' AS bases, false AS is_abstract FROM c")
def ast_classes(spark: SparkSession, d: str) -> DataFrame:
    found = entities.classes(nodes(spark, d))
    return found.select("id", "name", "line", F.array_join("bases", ",").alias("bases"), "is_abstract")


@query(
    f"""WITH {NAMES} SELECT 'meth:cls:' || m || ':Order:__init__:10' AS id, 1 AS complexity, 1 AS visitor_complexity, 0 AS cognitive, 0 AS nesting,
    false AS is_property, false AS is_async, NULL AS return_annotation, 'self:;key:str' AS args FROM c
    UNION ALL SELECT 'meth:cls:' || m || ':Order:state:14', 3, 3, 1, 1, true, false, 'str', 'self:' FROM c
    UNION ALL SELECT 'func:' || m || ':deep:20', 1 + n, 1 + n, n * (n + 1) // 2, n, false, late, NULL, 'x:' FROM c"""
)
def ast_methods(spark: SparkSession, d: str) -> DataFrame:
    found = entities.methods(nodes(spark, d, *entities.READS["methods"]))
    args = F.array_join(F.transform("args", lambda a: F.concat(a["name"], F.lit(":"), F.coalesce(a["annotation"], F.lit("")))), ";")
    return found.select(
        "id", "complexity", "visitor_complexity", "cognitive", "nesting", "is_property", "is_async", "return_annotation", args.alias("args")
    )


@query(
    f"""WITH {NAMES} SELECT 'field:cls:' || m || ':Order:total' AS id, 'int' AS type_annotation, '0' AS default_value, true AS is_class_variable FROM c
    UNION ALL SELECT 'field:cls:' || m || ':Order:key', NULL, 'key.strip()', false FROM c"""
)
def ast_fields(spark: SparkSession, d: str) -> DataFrame:
    found = entities.fields(nodes(spark, d, *entities.READS["fields"]))
    return found.select("id", "type_annotation", "default_value", "is_class_variable")


@query(
    f"""WITH {NAMES}, t(target, kind, strength, n) AS (VALUES ('Base', 'inheritance', 1.0, 1), ('key.strip', 'call', 1.0, 1), ('go', 'call', 1.0, 1),
    ('key.strip', 'attribute', 0.5, 1), ('self.key', 'attribute', 0.5, 2), ('self.total', 'attribute', 0.5, 1))
    SELECT m AS module_id, target AS to_entity, kind AS relationship_type, CAST(strength AS DOUBLE) AS strength, CAST(t.n AS BIGINT) AS n FROM c, t"""
)
def ast_edges(spark: SparkSession, d: str) -> DataFrame:
    found = entities.edges(nodes(spark, d, *entities.READS["edges"]))
    return found.groupBy("module_id", "to_entity", "relationship_type", "strength").agg(F.count("*").alias("n"))


@query(f"WITH {NAMES} SELECT 'cls:' || m || ':Order' AS class_id, CAST(2 AS BIGINT) AS n_methods, CAST(1 AS BIGINT) AS sharing, 0.0 AS lcom, 1.0 AS tcc FROM c")
def ast_cohesion(spark: SparkSession, d: str) -> DataFrame:
    """Cohesion from sources: which fields the methods' texts name."""
    parsed = nodes(spark, d)
    fields = scratch.materialise(entities.fields(parsed), "fields")
    usage = scratch.materialise(quality.field_usage(entities.methods(parsed), fields), "field-usage")
    return quality.cohesion(usage, fields)


@query("SELECT 'n' || n_nationkey AS \"from\", 'r' || n_regionkey AS \"to\", 'in' AS type FROM nation")
def flat_sink(spark: SparkSession, d: str) -> DataFrame:
    nations = read_table(spark, d, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("from_entity"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("to_entity"),
        F.lit("in").alias("relationship_type"),
    )
    return flat_edges(nations)


@query(
    """SELECT DISTINCT 'status=' || o_orderstatus || '/year=' || year(o_orderdate) || '/priority=' || o_orderpriority AS folder FROM orders
    WHERE o_orderstatus <> 'O' AND o_orderpriority <> '5-LOW' AND NOT (o_orderstatus = 'F' AND year(o_orderdate) = 1994)"""
)
def source_listing(spark: SparkSession, d: str) -> DataFrame:
    """Folders of a tree of orders by status, year and priority: anchored, double-star and plain patterns, and one that brings back."""
    orders = read_table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("priority"))
    top = scratch.partitioned(orders, ["status", "year", "priority"], "listed")
    found = files.listing(spark, top, ["/status=O", "/status=F/year=1994", "priority=1-*", "**/priority=5-*", "!priority=1-URGENT"], "*.parquet")
    return found.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()


@query(
    """WITH f AS (SELECT octet_length(encode(text)) AS n FROM documents) SELECT count(*) AS files, CAST(coalesce(sum(n), 0) AS BIGINT) AS bytes,
    count(*) FILTER (n > 10485760) AS large_files, CASE WHEN count(*) > 10000 THEN 'very_high' WHEN count(*) > 5000 THEN 'high' WHEN count(*) > 1000 THEN 'medium' ELSE 'low' END AS tier FROM f"""
)
def project_tier(spark: SparkSession, d: str) -> DataFrame:
    """Documents stand for sources."""
    docs = read_table(spark, d, "documents").select(F.octet_length("text").cast("long").alias("length"))
    return files.project_size(docs).select("files", "bytes", "large_files", "tier")


@query("SELECT '{\"n_regionkey\":' || n_regionkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def json_sink(spark: SparkSession, d: str) -> DataFrame:
    return as_json(read_table(spark, d, "nation").select("n_regionkey", "n_name", F.lit(1).alias("_private")))
