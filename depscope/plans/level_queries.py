"""Queries over the five levels, names, search, pages and manifests."""

from __future__ import annotations

import keyword

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depscope import scratch
from depscope.functions import globs, ids, metrics, names
from depscope.operators import cycles as cy
from depscope.operators import filters as fl
from depscope.operators import hierarchy as hi
from depscope.operators import incremental as inc
from depscope.operators import name_index
from depscope.operators import paging as pg
from depscope.operators import resolve as rs
from depscope.plans import adapters as ad
from depscope.plans.registry import query
from depscope.sources import files
from depscope.scratch import materialise
from depscope.sources.tables import read_table


@query(f"WITH {ad.LEVELS} SELECT kind, count(*) AS n FROM n GROUP BY kind")
def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    return hi.entity_counts(ad.levels(spark, d))


@query(f"WITH {ad.LEVELS} SELECT * FROM n")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return ad.levels(spark, d)


@query(f"WITH {ad.LEVELS} SELECT n.id, n.kind FROM n LEFT JOIN (SELECT DISTINCT id FROM n) p ON p.id = n.parent_id WHERE p.id IS NULL")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    return hi.orphans(ad.levels(spark, d)).select("id", "kind")


@query("SELECT documents.doc_id AS id FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = documents.doc_id WHERE l.doc_id IS NULL")
def childless(spark: SparkSession, d: str) -> DataFrame:
    """Documents stand for containers, labels for what is in them."""
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return hi.childless(docs, read_table(spark, d, "labels").select(F.col("doc_id").alias("parent_id"))).select("id")


@query(f"WITH {ad.LEVELS} SELECT level, parent_id, count(*) AS n_children FROM n WHERE level > 1 GROUP BY level, parent_id HAVING count(*) > 1")
def supernodes(spark: SparkSession, d: str) -> DataFrame:
    return hi.super_nodes(ad.levels(spark, d), 1)


@query(
    f"""WITH {ad.LEVELS} SELECT parent_id AS container, count(*) AS n_members, min(id) AS first_member, max(id) AS last_member
    FROM n WHERE parent_id IS NOT NULL GROUP BY parent_id"""
)
def clusters(spark: SparkSession, d: str) -> DataFrame:
    return hi.clusters(ad.levels(spark, d))


OPENED = "('mod:3', 'cls:5', 'cls:20')"


def _visible(spark: SparkSession, d: str) -> DataFrame:
    nodes = ad.levels(spark, d)
    return fl.visible(1, nodes.where(f"id IN {OPENED}").select("id"), nodes)


@query(f"WITH {ad.LEVELS} SELECT id, level FROM n WHERE level <= 1 OR parent_id IN {OPENED}")
def visible_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _visible(spark, d).select("id", "level")


@query(
    f"""WITH {ad.LEVELS}, s AS (SELECT id FROM n WHERE level <= 1 OR parent_id IN {OPENED})
    SELECT n.id AS src, n.parent_id AS dst FROM n JOIN s a ON a.id = n.id JOIN s b ON b.id = n.parent_id"""
)
def visible_edges(spark: SparkSession, d: str) -> DataFrame:
    shown = materialise(_visible(spark, d).select("id", "parent_id"), "visible")
    return fl.visible_edges(shown.select(F.col("id").alias("src"), F.col("parent_id").alias("dst")), shown).select("src", "dst")


@query(f"WITH {ad.LEVELS} SELECT id, name FROM n WHERE kind = 'class'")
def level_filter(spark: SparkSession, d: str) -> DataFrame:
    return ad.levels(spark, d).where("kind = 'class'").select("id", "name")


@query(f"WITH {ad.LEVELS} SELECT kind, count(*) AS n FROM n GROUP BY ROLLUP (kind)")
def tree_counts(spark: SparkSession, d: str) -> DataFrame:
    return hi.tree_counts(ad.levels(spark, d))


@query(
    f"""WITH RECURSIVE {ad.LEVELS}, s AS (SELECT id, parent_id FROM n WHERE contains(lower(name), 'customer#00000001')
    UNION SELECT n.id, n.parent_id FROM n JOIN s ON n.id = s.parent_id)
    SELECT id, kind, contains(lower(name), 'customer#00000001') AS matched FROM n WHERE id IN (SELECT id FROM s)"""
)
def tree_search(spark: SparkSession, d: str) -> DataFrame:
    return hi.tree_search(ad.levels(spark, d), "Customer#00000001")


@query(
    f"""WITH {ad.LEVELS} SELECT id, row_number() OVER (PARTITION BY parent_id ORDER BY level, lower(name), name, id) AS position FROM n"""
)
def tree_sort(spark: SparkSession, d: str) -> DataFrame:
    return hi.tree_order(ad.levels(spark, d)).select("id", F.col("position").cast("long").alias("position"))


@query(
    """WITH r AS (SELECT n_nationkey AS id, row_number() OVER (ORDER BY n_nationkey) - 1 AS rank, count(*) OVER () AS total FROM nation)
    SELECT id, rank, round(cos(2 * pi() * rank / total) * 10.0 * (1 + rank % 3), 6) AS x, CAST(rank % 3 AS DOUBLE) AS y,
    round(sin(2 * pi() * rank / total) * 10.0 * (1 + rank % 3), 6) AS z FROM r"""
)
def circle_layout(spark: SparkSession, d: str) -> DataFrame:
    nodes = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    placed = hi.circle(nodes, F.col("id"))
    return placed.select("id", F.col("rank").cast("long").alias("rank"), F.round("x", 6).alias("x"), "y", F.round("z", 6).alias("z"))


NAMED = """n AS (SELECT 'part:' || p_partkey AS id, p_name AS name, 'part' AS kind FROM part
  UNION ALL SELECT 'sup:' || s_suppkey, s_name, 'supplier' FROM supplier
  UNION ALL SELECT 'nat:' || n_nationkey, n_name, 'nation' FROM nation)"""


def _entities(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for table, key, name, kind, prefix in (
        ("part", "p_partkey", "p_name", "part", "part"),
        ("supplier", "s_suppkey", "s_name", "supplier", "sup"),
        ("nation", "n_nationkey", "n_name", "nation", "nat"),
    ):
        own = read_table(spark, d, table).select(
            F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("kind")
        )
        out = own if out is None else out.unionByName(own)
    return out


@query(f"WITH {NAMED} SELECT * FROM n WHERE contains(lower(name), 'ring')")
def search(spark: SparkSession, d: str) -> DataFrame:
    return pg.search(_entities(spark, d), "RING")


@query(f"WITH {NAMED} SELECT n.*, q AS query FROM n, (VALUES ('RING'), ('1'), ('er#00'), ('qqz')) t(q) WHERE contains(lower(name), lower(q))")
def search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """What an index of all names finds for texts of several lengths, one of them in no name."""
    path = scratch.place(spark, "names")
    name_index.build(_entities(spark, d), path)
    out = None
    for text in ("RING", "1", "er#00", "qqz"):
        found = name_index.search(spark, path, text).withColumn("query", F.lit(text))
        out = found if out is None else out.unionByName(found)
    return out


@query(f"WITH {NAMED} SELECT * FROM n WHERE contains(lower(name), '1') AND kind = 'supplier'")
def search_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return pg.search(_entities(spark, d), "1", "supplier")


@query(f"WITH {NAMED} SELECT * FROM n WHERE id = 'nat:7'")
def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    return pg.lookup(_entities(spark, d), "nat:7")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100 OFFSET 200")
def paginate(spark: SparkSession, d: str) -> DataFrame:
    return pg.page(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 3)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def paginate_by_key(spark: SparkSession, d: str) -> DataFrame:
    return pg.page_after(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500)


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 100) AS BIGINT) AS pages, ceil(count(*) / 100) > 3 AS has_next, count(*) > 0 AS has_previous FROM orders")
def page_info(spark: SparkSession, d: str) -> DataFrame:
    return pg.page_info(read_table(spark, d, "orders"), 3)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_n_sample(spark: SparkSession, d: str) -> DataFrame:
    return pg.top(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 50)


@query(
    """SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 10 THEN value END), 6) AS mean_nonzero FROM events GROUP BY event_type"""
)
def result_summary(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events").withColumn("v", F.when(F.col("value") > 10, F.col("value")).otherwise(0.0))
    return pg.summary(events, "event_type", "v").withColumn("mean_nonzero", F.round("mean_nonzero", 6))


@query(
    """WITH t AS (SELECT * FROM events ORDER BY event_id LIMIT 1000), a AS (SELECT count(*) AS n FROM events)
    SELECT event_type, count(*) AS n, any_value(a.n) AS total_results, any_value(least(a.n, 1000)) AS sample_size, any_value(a.n > 1000) AS is_sampled,
    round((SELECT avg(value) FROM t WHERE value <> 0), 6) AS mean_nonzero FROM t, a GROUP BY event_type"""
)
def sample_summary(spark: SparkSession, d: str) -> DataFrame:
    found = pg.sample_summary(read_table(spark, d, "events"), ["event_id"], "event_type", "value")
    return found.withColumn("mean_nonzero", F.round("mean_nonzero", 6))


@query(
    f"""WITH RECURSIVE {NAMED}, {ad.PS}, {ad.SCC} SELECT n.*, k.node IS NOT NULL AS in_cycle,
    CASE WHEN size > 3 THEN 'high' WHEN size IS NOT NULL THEN 'medium' END AS severity
    FROM n LEFT JOIN k ON 'part:' || k.node = n.id WHERE contains(lower(name), 'a')"""
)
def search_flagged(spark: SparkSession, d: str) -> DataFrame:
    """What a search finds, and whether it is on a cycle of parts."""
    members = cy.cycle_members(ad.part_supplier(spark, d))
    members = members.withColumn("node", F.concat(F.lit("part:"), F.col("node").cast("string")))
    return cy.flag_entities(pg.search(_entities(spark, d), "A"), members)


@query(
    """WITH h AS (SELECT o_orderkey AS id, CAST(o_custkey AS BIGINT) AS size, o_orderdate AS used, date_trunc('hour', o_orderdate) AS hour FROM orders),
    r AS (SELECT id, CAST(sum(size) OVER (ORDER BY hour DESC, used DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM h)
    SELECT id, running FROM r WHERE running > 5000000"""
)
def evict(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders")
    return pg.evict(orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("size"), F.col("o_orderdate").alias("used")), 5_000_000)


@query(
    """SELECT source, count(*) AS files, CASE WHEN count(*) > 10000 THEN 'very_high' WHEN count(*) > 5000 THEN 'high'
    WHEN count(*) > 1000 THEN 'medium' ELSE 'low' END AS tier, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY ROLLUP (source)"""
)
def size_tiers(spark: SparkSession, d: str) -> DataFrame:
    sums = read_table(spark, d, "documents").rollup("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))
    return sums.withColumn("tier", metrics.size_tier(F.col("files")))


@query("SELECT doc_id AS path, n_chars AS length FROM documents WHERE n_chars <= 5000")
def large_file_skip(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("length"))
    return files.small_enough(docs, 5000)


OLD_NEW = """o AS (SELECT doc_id AS path, md5(CAST(quality AS VARCHAR)) AS a FROM labels
  UNION ALL SELECT DISTINCT -1 - conv_id, md5('gone') FROM conversations),
nw AS (SELECT doc_id AS path, md5(CASE WHEN n_chars > 400 THEN '1' ELSE '0' END) AS b FROM documents),
s AS (SELECT coalesce(o.path, nw.path) AS path, CASE WHEN a IS NULL THEN 'new' WHEN b IS NULL THEN 'deleted'
  WHEN a <> b THEN 'modified' ELSE 'same' END AS status FROM o FULL JOIN nw ON o.path = nw.path)"""
PLAN = """dep AS (SELECT path - 1 AS path FROM s WHERE status <> 'same'),
p AS (SELECT path, CASE WHEN status = 'deleted' THEN 'drop' WHEN status <> 'same' OR path IN (SELECT path FROM dep) THEN 'analyse'
  ELSE 'reuse' END AS action FROM s)"""


def _status(spark: SparkSession, d: str) -> DataFrame:
    """Labels and conversations stand for the files of an older run, documents for those of today."""
    old = read_table(spark, d, "labels").select(F.col("doc_id").alias("path"), F.md5(F.col("quality").cast("string")).alias("fingerprint"))
    gone = read_table(spark, d, "conversations").select((-1 - F.col("conv_id")).alias("path")).distinct()
    now = F.when(F.col("n_chars") > 400, "1").otherwise("0")
    new = read_table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.md5(now).alias("fingerprint"))
    return inc.compare(old.unionByName(gone.withColumn("fingerprint", F.md5(F.lit("gone")))), new)


def _plan(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    edges = docs.select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst"))
    return inc.plan(_status(spark, d), edges)


@query(f"WITH {OLD_NEW} SELECT * FROM s")
def manifest_status(spark: SparkSession, d: str) -> DataFrame:
    return _status(spark, d)


@query(f"WITH {OLD_NEW}, {PLAN} SELECT * FROM p")
def incremental_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)


@query(
    f"""WITH {OLD_NEW}, {PLAN} SELECT doc_id AS path, n_chars AS value, 'old' AS origin FROM documents WHERE doc_id IN (SELECT path FROM p WHERE action = 'reuse')
    UNION ALL SELECT doc_id, n_chars, 'fresh' FROM documents WHERE doc_id IN (SELECT path FROM p WHERE action = 'analyse')"""
)
def incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("value"))
    actions = _plan(spark, d)
    fresh = docs.join(actions.where("action = 'analyse'").select("path"), "path", "left_semi").withColumn("origin", F.lit("fresh"))
    return inc.merge(docs.withColumn("origin", F.lit("old")), fresh, actions)


@query("SELECT doc_id AS path, md5(text) AS fingerprint FROM documents")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return files.manifest(read_table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "utf-8").alias("content")))


@query("SELECT source, sha256('{\"options\": {\"depth\": 0}, \"path\": \"' || source || '\"}')[1:16] AS cache_key FROM (SELECT DISTINCT source FROM documents)")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    sources = read_table(spark, d, "documents").select("source").distinct()
    return sources.select("source", inc.cache_keys(F.col("source"), {"depth": 0}).alias("cache_key"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 7 DAY < TIMESTAMP '1995-06-01 00:00:00'")
def expired(spark: SparkSession, d: str) -> DataFrame:
    return inc.expired(read_table(spark, d, "orders"), "o_orderdate", F.to_timestamp_ntz(F.lit("1995-06-01 00:00:00"))).select("o_orderkey")


@query(
    """SELECT p_partkey, 'pkg:' || translate(p_name, ' ', '.') AS package_id, 'mod:' || translate(p_name, ' ', '.') AS module_id,
    'cls:mod:' || p_type || ':' || p_brand AS class_id, 'meth:cls:' || p_type || ':' || p_brand || ':' || p_size AS method_id,
    'field:cls:' || p_type || ':' || p_brand AS field_id, 'rel:' || p_type || '->' || p_brand || ':import' AS relationship_id FROM part"""
)
def id_expressions(spark: SparkSession, d: str) -> DataFrame:
    path = F.translate("p_name", " ", "/")
    owner = F.concat(F.lit("cls:"), "p_type")
    return read_table(spark, d, "part").select(
        "p_partkey",
        ids.package_id(path).alias("package_id"),
        ids.module_id(F.concat(path, F.lit(".py"))).alias("module_id"),
        ids.class_id(F.concat(F.lit("mod:"), "p_type"), F.col("p_brand")).alias("class_id"),
        ids.method_id(owner, F.col("p_brand"), F.col("p_size"), F.lit("m")).alias("method_id"),
        ids.field_id(owner, F.col("p_brand")).alias("field_id"),
        ids.relationship_id(F.col("p_type"), F.col("p_brand"), F.lit("import")).alias("relationship_id"),
    )


@query(
    """WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages)
    SELECT page_id, CASE WHEN length(host) > 20 THEN replace(host, '.', '.' || chr(10)) ELSE host END AS label,
    len(string_split(host, '.')) - 1 AS depth, split_part(host, '.', 1) AS package,
    regexp_full_match(host, '[A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)*') AS legal FROM h"""
)
def name_projection(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]+)", 1)
    return read_table(spark, d, "pages").select("page_id", host.alias("host")).select(
        "page_id",
        names.label(F.col("host")).alias("label"),
        names.depth(F.col("host")).cast("long").alias("depth"),
        names.package_of(F.col("host")).alias("package"),
        names.is_legal(F.col("host")).alias("legal"),
    )


@query(
    """SELECT array_to_string(list_slice(string_split(regexp_extract(url, '://([^/?#]+)', 1), '.'), 1, 2), '.') AS name, count(*) AS n
    FROM pages GROUP BY 1"""
)
def truncate_depth(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]+)", 1)
    return read_table(spark, d, "pages").groupBy(names.truncated(host, 2).alias("name")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_type FROM part WHERE NOT (p_type LIKE '%O%' AND p_type NOT LIKE 'P%')")
def exclude_glob(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").where(~globs.excluded(F.col("p_type"), ["*O*", "# note", "!P*"])).select("p_partkey", "p_type")


@query("SELECT p_partkey, p_name FROM part WHERE NOT starts_with(p_name, split_part(p_name, ' ', 1) || ' w')")
def self_package_filter(spark: SparkSession, d: str) -> DataFrame:
    name = F.replace("p_name", F.lit(" w"), F.lit("."))
    parts = read_table(spark, d, "part").withColumn("first", F.split_part("p_name", F.lit(" "), F.lit(1)))
    return parts.where(fl.outside_own_package(name, F.col("first"))).select("p_partkey", "p_name")


@query(
    """WITH r AS (SELECT conv_id AS k, turn AS n, role AS tag FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) = 1),
    l AS (SELECT doc_id AS k, CAST(quality AS BIGINT) AS n, CASE WHEN toxic = 0 THEN 'clean' END AS tag FROM labels)
    SELECT coalesce(r.k, l.k) AS k, coalesce(r.n, l.n) AS n, coalesce(r.tag, l.tag) AS tag,
    CASE WHEN r.k IS NOT NULL AND l.k IS NOT NULL THEN 'both' WHEN r.k IS NOT NULL THEN 'right' ELSE 'left' END AS origin
    FROM l FULL JOIN r ON r.k = l.k"""
)
def merge_modules(spark: SparkSession, d: str) -> DataFrame:
    """Labels and conversations stand for two detectors' modules; the last turn of a conversation counts."""
    labels, turns = read_table(spark, d, "labels"), read_table(spark, d, "conversations")
    left = labels.select(F.col("doc_id").alias("k"), F.col("quality").cast("long").alias("n"), F.when(F.col("toxic") == 0, "clean").alias("tag"))
    right = turns.select(F.col("conv_id").alias("k"), F.col("turn").alias("n"), F.col("role").alias("tag"))
    return rs.merge_modules(left, right, "k", ["n", "tag"], "n")


@query(
    """WITH c AS (SELECT DISTINCT p_name AS child FROM part), w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS parent FROM part UNION
    SELECT DISTINCT substr(p_name, 1, 7) FROM part),
    r AS (SELECT child, parent, row_number() OVER (PARTITION BY child ORDER BY length(parent) DESC) AS k FROM c JOIN w
      ON starts_with(child, parent) AND length(parent) < length(child))
    SELECT c.child, parent FROM c LEFT JOIN (SELECT * FROM r WHERE k = 1) r ON r.child = c.child"""
)
def longest_prefix_parent(spark: SparkSession, d: str) -> DataFrame:
    parts = read_table(spark, d, "part")
    parents = parts.select(F.explode(F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), F.substring("p_name", 1, 7))).alias("parent"))
    return rs.longest_prefix_parent(parts.select(F.col("p_name").alias("child")), parents)


WORDS = ", ".join(f"'{w}'" for w in sorted(keyword.kwlist))


@query(f"SELECT DISTINCT word FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word IN ({WORDS})")
def reserved_names(spark: SparkSession, d: str) -> DataFrame:
    words = read_table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("word"))
    reserved = spark.createDataFrame([(w,) for w in keyword.kwlist], "word string")
    return words.join(F.broadcast(reserved), "word", "left_semi").distinct()


@query(
    """WITH s AS (SELECT l_suppkey AS k, list_sort(list_distinct(list(l_linenumber))) AS a FROM lineitem GROUP BY l_suppkey)
    SELECT x.k AS a, y.k AS b, CAST(len(list_intersect(x.a, y.a)) AS INT) AS shared FROM s x JOIN s y ON y.k = x.k + 1"""
)
def shared_sets(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "lineitem")
    sets = lines.groupBy(F.col("l_suppkey").alias("a")).agg(F.collect_set("l_linenumber").alias("x"))
    after = sets.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("x").alias("y"))
    return sets.join(after, "a").select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"))
