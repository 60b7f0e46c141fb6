"""Queries of quality figures: customers stand for classes, their orders for methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depscope.functions import metrics
from depscope.operators import quality as qu
from depscope.plans.registry import query
from depscope.sources.tables import read_table

METHODS = """ln AS (SELECT l_orderkey, count(*) AS complexity, CAST(sum(l_quantity) AS BIGINT) AS lines FROM lineitem GROUP BY l_orderkey),
m AS (SELECT o_custkey AS class_id, complexity, lines FROM orders JOIN ln ON l_orderkey = o_orderkey),
cpl AS (SELECT c_custkey AS entity, CAST(c_custkey % 5 AS BIGINT) AS afferent, CAST(c_nationkey % 7 AS BIGINT) AS efferent,
  CASE WHEN c_custkey % 5 + c_nationkey % 7 > 0 THEN CAST(c_nationkey % 7 AS DOUBLE) / (c_custkey % 5 + c_nationkey % 7) ELSE 0.0 END AS instability FROM customer),
g AS (SELECT class_id, avg(complexity) AS mean_complexity, CAST(sum(lines) AS BIGINT) AS lines FROM m GROUP BY class_id),
j AS (SELECT g.*, coalesce(afferent, 0) AS afferent, coalesce(efferent, 0) AS efferent, coalesce(instability, 0.0) AS instability FROM g LEFT JOIN cpl ON entity = class_id),
f AS (SELECT *, CAST(trunc(mean_complexity) AS INT) AS complexity,
  greatest(0.0, 171.0 - 0.23 * mean_complexity - 16.2 * ln(greatest(1, lines))) AS maintainability,
  least(1.0, mean_complexity / 10.0 + efferent / 20.0) AS debt FROM j)"""


def graded_sql(table: str, name: str, debt: str = "debt") -> str:
    """A common table ``name``: ``table`` with score and grade."""
    return f"""{name} AS (SELECT *, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C'
  WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM (SELECT *,
  CASE WHEN complexity <= 10 THEN 30 WHEN complexity <= 20 THEN 20 WHEN complexity <= 50 THEN 10 ELSE 0 END
  + CASE WHEN maintainability >= 85 THEN 30 WHEN maintainability >= 65 THEN 20 WHEN maintainability >= 40 THEN 10 ELSE 0 END
  + CASE WHEN instability <= 0.3 THEN 20 WHEN instability <= 0.7 THEN 15 ELSE 10 END
  + CASE WHEN {debt} <= 0.1 THEN 20 WHEN {debt} <= 0.3 THEN 10 WHEN {debt} <= 0.5 THEN 5 ELSE 0 END AS score FROM {table}))"""


GRADED = f"{METHODS}, {graded_sql('f', 'gr')}"


def _methods(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("complexity"), F.sum("l_quantity").cast("long").alias("lines")
    )
    orders = read_table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("class_id"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("class_id", "o_orderkey", "complexity", "lines")


def _classes(spark: SparkSession, d: str) -> DataFrame:
    afferent, efferent = F.col("c_custkey") % 5, (F.col("c_nationkey") % 7).cast("long")
    coupled = read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("entity"),
        afferent.alias("afferent"),
        efferent.alias("efferent"),
        metrics.instability(afferent, efferent).alias("instability"),
    )
    return qu.class_quality(_methods(spark, d), coupled)


@query(f"WITH {METHODS} SELECT class_id, complexity, lines, round(maintainability, 6) AS maintainability FROM f")
def maintainability(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).select("class_id", "complexity", "lines", F.round("maintainability", 6).alias("maintainability"))


@query(f"WITH {METHODS} SELECT class_id, round(debt, 6) AS debt FROM f")
def tech_debt(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).select("class_id", F.round("debt", 6).alias("debt"))


@query(f"WITH {GRADED} SELECT class_id, grade FROM gr")
def grade(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).select("class_id", "grade")


@query(f"WITH {GRADED} SELECT grade, count(*) AS n FROM gr GROUP BY grade")
def grade_distribution(spark: SparkSession, d: str) -> DataFrame:
    return qu.grade_distribution(_classes(spark, d))


@query(
    f"""WITH {METHODS} SELECT round(coalesce(avg(complexity), 0.0), 6) AS mean_complexity,
    round(coalesce(avg(maintainability), 0.0), 6) AS mean_maintainability, count(*) AS n FROM f"""
)
def quality_overall(spark: SparkSession, d: str) -> DataFrame:
    row = qu.overall(_classes(spark, d))
    return row.select(F.round("mean_complexity", 6).alias("mean_complexity"), F.round("mean_maintainability", 6).alias("mean_maintainability"), "n")


MODULES = f"""{METHODS}, md AS (SELECT n_nationkey AS module_id, CAST(coalesce(sum(afferent), 0) AS BIGINT) AS afferent,
  CAST(coalesce(sum(efferent), 0) AS BIGINT) AS efferent, coalesce(avg(complexity), 1.0) AS mean_complexity,
  CAST(coalesce(sum(lines), 0) AS BIGINT) AS lines FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN f ON class_id = c_custkey GROUP BY 1),
mf AS (SELECT *, CAST(trunc(mean_complexity) AS INT) AS complexity, CASE WHEN afferent + efferent > 0 THEN CAST(efferent AS DOUBLE) / (afferent + efferent) ELSE 0.0 END AS instability,
  greatest(0.0, 171.0 - 0.23 * mean_complexity - 16.2 * ln(greatest(1, lines))) AS maintainability FROM md),
{graded_sql('mf', 'mg', '0.0')}"""


@query(
    f"""WITH {MODULES} SELECT module_id, afferent, efferent, round(instability, 6) AS instability, complexity, lines,
    round(maintainability, 6) AS maintainability, grade FROM mg"""
)
def class_to_module_rollup(spark: SparkSession, d: str) -> DataFrame:
    nations = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("module_id"))
    customers = read_table(spark, d, "customer").select(F.col("c_custkey").alias("class_id"), F.col("c_nationkey").alias("module_id"))
    classes = nations.join(customers, "module_id", "left").join(_classes(spark, d), "class_id", "left")
    rolled = qu.module_rollup(classes)
    return rolled.select(
        "module_id", "afferent", "efferent", F.round("instability", 6).alias("instability"), "complexity", "lines",
        F.round("maintainability", 6).alias("maintainability"), "grade",
    )


@query(
    """WITH u AS (SELECT DISTINCT l_suppkey AS class_id, l_orderkey AS method_id, p_brand AS field
      FROM lineitem JOIN part ON p_partkey = l_partkey),
    z AS (SELECT class_id, count(DISTINCT method_id) AS n_methods, count(DISTINCT field) AS n_fields FROM u GROUP BY class_id),
    s AS (SELECT class_id, count(*) AS sharing FROM (SELECT DISTINCT a.class_id, a.method_id, b.method_id FROM u a JOIN u b
      ON a.class_id = b.class_id AND a.field = b.field AND a.method_id < b.method_id) GROUP BY class_id),
    l AS (SELECT z.class_id, n_methods, coalesce(sharing, 0) AS sharing, n_methods * (n_methods - 1) / 2 AS pairs,
      CASE WHEN n_fields = 0 THEN 0.0 ELSE greatest(0.0, n_methods * (n_methods - 1) / 2 - 2 * coalesce(sharing, 0)) END AS lcom
      FROM z LEFT JOIN s ON s.class_id = z.class_id)
    SELECT class_id, n_methods, sharing, CAST(lcom AS DOUBLE) AS lcom,
    round(CASE WHEN pairs > 0 THEN greatest(0.0, pairs - lcom) / pairs ELSE 0.0 END, 6) AS tcc FROM l"""
)
def lcom_tcc(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "lineitem")
    parts = read_table(spark, d, "part").select("p_partkey", "p_brand")
    usage = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("class_id"),
        F.col("l_orderkey").alias("method_id"),
        F.col("p_brand").alias("field"),
    )
    return qu.cohesion(usage).withColumn("tcc", F.round("tcc", 6))


@query(
    """SELECT p_brand, round(avg(CASE WHEN p_type LIKE 'P%' THEN 1.0 ELSE 0.0 END), 6) AS abstractness,
    round(avg(p_size / 50.0), 6) AS instability,
    round(abs(avg(CASE WHEN p_type LIKE 'P%' THEN 1.0 ELSE 0.0 END) + avg(p_size / 50.0) - 1), 6) AS distance FROM part GROUP BY p_brand"""
)
def abstractness_distance(spark: SparkSession, d: str) -> DataFrame:
    parts = read_table(spark, d, "part").select(
        "p_brand", F.col("p_type").startswith("P").alias("is_abstract"), (F.col("p_size") / 50.0).alias("instability")
    )
    found = qu.abstractness(parts, "p_brand")
    return found.select("p_brand", *[F.round(c, 6).alias(c) for c in ("abstractness", "instability", "distance")])


@query(
    """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents)
    SELECT doc_id, CAST(len(p) AS INT) AS physical, CAST(len(list_filter(p, lambda x: NOT starts_with(x, '#'))) AS INT) AS logical FROM l"""
)
def line_metrics(spark: SparkSession, d: str) -> DataFrame:
    physical, logical = metrics.code_lines(F.col("text"))
    return read_table(spark, d, "documents").select("doc_id", physical.alias("physical"), logical.alias("logical"))


@query("SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'R') AS complexity FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_returnflag = 'R') <> 0")
def method_complexity(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
    return qu.complexity_map(lines.agg(F.count_if(F.col("l_returnflag") == "R").alias("complexity")))


@query(
    f"""WITH {METHODS}, x AS (SELECT c_custkey AS class_id, CAST(coalesce(complexity, 2) AS INT) AS complexity, CAST(coalesce(lines, 15) AS BIGINT) AS lines,
    coalesce(maintainability, 75.0) AS maintainability, coalesce(debt, 0.1) AS debt FROM customer LEFT JOIN f ON class_id = c_custkey)
    SELECT class_id, complexity, lines, round(maintainability, 6) AS maintainability, round(debt, 6) AS debt FROM x"""
)
def default_metrics(spark: SparkSession, d: str) -> DataFrame:
    customers = read_table(spark, d, "customer").select(F.col("c_custkey").alias("class_id"))
    known = customers.join(_classes(spark, d), "class_id", "left")
    return qu.with_defaults(known).select("class_id", "complexity", "lines", F.round("maintainability", 6).alias("maintainability"), F.round("debt", 6).alias("debt"))


@query(
    f"""WITH {METHODS} SELECT class_id, CASE WHEN complexity <= 10 THEN 'good' WHEN complexity <= 20 THEN 'warning' ELSE 'critical' END AS complexity_band,
    CASE WHEN maintainability >= 80 THEN 'good' WHEN maintainability >= 60 THEN 'warning' ELSE 'critical' END AS maintainability_band,
    CASE WHEN debt <= 0.1 THEN 'good' WHEN debt <= 0.25 THEN 'warning' ELSE 'critical' END AS debt_band FROM f"""
)
def status_bands(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = metrics.status_bands(F.col("complexity"), F.col("maintainability"), F.col("debt"))
    return _classes(spark, d).select("class_id", a.alias("complexity_band"), b.alias("maintainability_band"), c.alias("debt_band"))


@query(
    """WITH t AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS k FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN len(k) > 1 THEN 'Union[' || array_to_string(k, ', ') || ']' ELSE k[1] END AS return_type FROM t"""
)
def return_union(spark: SparkSession, d: str) -> DataFrame:
    kinds = read_table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("k"))
    joined = F.concat(F.lit("Union["), F.array_join("k", ", "), F.lit("]"))
    return kinds.select("user_id", F.when(F.size("k") > 1, joined).otherwise(F.get("k", F.lit(0))).alias("return_type"))


@query(
    """WITH s AS (SELECT l_returnflag AS src, l_linestatus AS dst, count(*) AS n FROM lineitem GROUP BY 1, 2), w AS (SELECT *, max(n) OVER () AS most FROM s)
    SELECT src, dst, n, CASE WHEN n <= 0 THEN 0 WHEN n / most <= 0.2 THEN 1 WHEN n / most <= 0.4 THEN 2 WHEN n / most <= 0.6 THEN 3 WHEN n / most <= 0.8 THEN 4 ELSE 5 END AS band FROM w"""
)
def matrix_heat(spark: SparkSession, d: str) -> DataFrame:
    cells = read_table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("src"), F.col("l_linestatus").alias("dst")).agg(F.count("*").alias("n"))
    most = cells.agg(F.max("n").alias("most"))
    return cells.join(F.broadcast(most)).select("src", "dst", "n", metrics.heat_band(F.col("n"), F.col("most")).alias("band"))
