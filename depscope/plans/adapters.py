"""Graphs and levels over the test tables, in DataFrames and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depscope.operators.hierarchy import graph_nodes
from depscope.operators.spread import spread
from depscope.sources.tables import read_table


def part_supplier(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (src, dst): each part, and each supplier that delivered it."""
    lines = read_table(spark, d, "lineitem")
    return spread(lines.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), lines.count(), "src", "dst").distinct()


def supplier_handoff(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (src, dst): the suppliers of an order's neighbouring lines."""
    lines = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    total = lines.count()
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    moved = spread(lines, total, "l_orderkey").select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(order).alias("dst"))
    return spread(moved.where("dst IS NOT NULL"), total, "src", "dst").distinct()


def event_steps(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_id") % 3 == 0, "import").when(F.col("event_id") % 3 == 1, "call").otherwise("inheritance")
    steps = read_table(spark, d, "events").select(
        "event_id", F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst"), kind.alias("relationship_type")
    )
    return steps.where("dst IS NOT NULL")


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (src, dst): a page's host, and the first path part of each of its links."""
    pages = read_table(spark, d, "pages")
    host = F.regexp_extract("url", "://([^/?#]+)", 1)
    href = F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)'), F.lit(1))
    return pages.select(host.alias("src"), F.explode(href).alias("dst")).distinct()


def levels(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations, customers, orders and order lines as packages down to fields."""
    t = {n: read_table(spark, d, n) for n in ("region", "nation", "customer", "orders", "lineitem")}

    def ident(prefix: str, *keys: str):
        return F.concat(F.lit(f"{prefix}:"), F.concat_ws(":", *[F.col(k).cast("string") for k in keys]))

    return graph_nodes(
        {
            "package": t["region"].select(ident("pkg", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id")),
            "module": t["nation"].select(ident("mod", "n_nationkey").alias("id"), F.col("n_name").alias("name"), ident("pkg", "n_regionkey").alias("parent_id")),
            "class": t["customer"].select(ident("cls", "c_custkey").alias("id"), F.col("c_name").alias("name"), ident("mod", "c_nationkey").alias("parent_id")),
            "method": t["orders"].select(ident("meth", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), ident("cls", "o_custkey").alias("parent_id")),
            "field": t["lineitem"].select(ident("field", "l_orderkey", "l_linenumber").alias("id"), F.col("l_linestatus").alias("name"), ident("meth", "l_orderkey").alias("parent_id")).distinct(),
        }
    )


PS = "e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem)"
SUP = """e AS (SELECT DISTINCT src, dst FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (
  PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst
  FROM lineitem) WHERE dst IS NOT NULL)"""
EVT = """e AS (SELECT * FROM (SELECT event_id, event_type AS src,
  lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst,
  CASE event_id % 3 WHEN 0 THEN 'import' WHEN 1 THEN 'call' ELSE 'inheritance' END AS relationship_type
  FROM events) WHERE dst IS NOT NULL)"""
LINK = """e AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]+)', 1) AS src,
  unnest(regexp_extract_all(html, 'href="/([A-Za-z]+)', 1)) AS dst FROM pages)"""
LEVELS = """n AS (
  SELECT 'pkg:' || r_regionkey AS id, r_name AS name, 0 AS level, 'package' AS kind, NULL AS parent_id FROM region
  UNION ALL SELECT 'mod:' || n_nationkey, n_name, 1, 'module', 'pkg:' || n_regionkey FROM nation
  UNION ALL SELECT 'cls:' || c_custkey, c_name, 2, 'class', 'mod:' || c_nationkey FROM customer
  UNION ALL SELECT 'meth:' || o_orderkey, o_orderpriority, 3, 'method', 'cls:' || o_custkey FROM orders
  UNION ALL SELECT DISTINCT 'field:' || l_orderkey || ':' || l_linenumber, l_linestatus, 4, 'field', 'meth:' || l_orderkey
  FROM lineitem)"""
#: Components of e: c(node, scc), and k(node, scc, size) of those on cycles, loops included.
SCC = """r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
v AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
c AS (SELECT node, least(node, coalesce(m, node)) AS scc FROM v LEFT JOIN (
  SELECT x.a, min(x.b) AS m FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) ON node = a),
k AS (SELECT c.node, c.scc, z.size FROM c JOIN (SELECT scc, count(*) AS size FROM c GROUP BY scc) z ON z.scc = c.scc
  WHERE z.size > 1 OR c.node IN (SELECT src FROM e WHERE src = dst))"""
IMPORT_SEVERITY = "CASE WHEN size > 3 THEN 'high' ELSE 'medium' END"
COUPLING = """u AS (SELECT src AS entity, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e),
cp AS (SELECT entity, CAST(sum(i) AS BIGINT) AS afferent, CAST(sum(o) AS BIGINT) AS efferent,
  CAST(sum(o) AS DOUBLE) / sum(i + o) AS instability FROM u GROUP BY entity)"""
