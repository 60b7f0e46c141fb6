"""A whole analysis: from a folder of sources to entity, edge, cycle and metric tables."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depscope.functions import ids, names
from depscope.operators import coupling, cycles, entities, filters, graph, hierarchy, paging, quality, resolve
from depscope.scratch import materialise
from depscope.sources import files, python_ast, sinks


@dataclass
class Options:
    """max_depth 0 is unlimited and counts hops from a root that imports all modules; exclude_parts leaves out
    paths that hold one of them; only keeps names with one of the prefixes; truncate_to cuts module names to
    so many parts."""

    max_depth: int = 0
    exclude_parts: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=lambda: list(files.EXCLUDE))
    exclude_exact: list[str] = field(default_factory=list)
    include_stdlib: bool = False
    include_missing: bool = False
    only: list[str] = field(default_factory=list)
    noise_level: int = 200
    truncate_to: int = 0
    max_file_bytes: int = 0


@dataclass
class AnalysisResult:
    """Lazy tables of one run."""

    tables: dict[str, DataFrame]
    options: Options

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def get_entity_count(self) -> DataFrame:
        return hierarchy.entity_counts(self.tables["nodes"])

    def get_relationships_by_type(self, kind: str) -> DataFrame:
        return self.tables["edges"].where(F.col("relationship_type") == kind)

    def get_entity_relationships(self, entity: str) -> DataFrame:
        return self.tables["edges"].where((F.col("from_entity") == entity) | (F.col("to_entity") == entity))

    def search(self, query: str, kind: str | None = None) -> DataFrame:
        """Modules, classes and methods whose name holds ``query``, with in_cycle and severity."""
        found = paging.search(self.tables["nodes"], query, kind).where("kind IN ('module', 'class', 'method')")
        members = self.tables["cycle_members"].withColumn("node", F.concat(F.lit("mod:"), "node"))
        return cycles.flag_entities(found, members)

    def to_json(self) -> dict[str, DataFrame]:
        return {name: sinks.as_json(frame) for name, frame in self.tables.items()}


def stdlib(spark: SparkSession) -> DataFrame:
    """(node) names of the standard library; a few hundred rows."""
    return spark.createDataFrame([(n,) for n in sorted(sys.stdlib_module_names)], "node string")


def import_edges(parsed: DataFrame, options: Options) -> DataFrame:
    """(src, dst) between modules, from importer to imported, after the run's filters."""
    spark = parsed.sparkSession
    found = entities.import_targets(parsed)
    own = parsed.where("n = 0").select(F.col("module").alias("node")).distinct()
    library = stdlib(spark)
    edges = resolve.known_edges(found, own).select("src", "dst")
    top = F.split_part("dst", F.lit("."), F.lit(1))
    foreign = found.join(own, found["dst"] == own["node"], "left_anti").withColumn("top", top)
    if options.include_stdlib:
        edges = edges.unionByName(foreign.join(F.broadcast(library), F.col("top") == F.col("node"), "left_semi").select("src", "dst"))
    if options.include_missing:
        edges = edges.unionByName(foreign.join(F.broadcast(library), F.col("top") == F.col("node"), "left_anti").select("src", "dst"))
    for side in ("src", "dst"):
        if options.exclude_exact:
            edges = edges.where(~F.col(side).isin(options.exclude_exact))
        edges = edges.where(filters.starts_with_any(F.col(side), options.only))
        if options.truncate_to:
            edges = edges.withColumn(side, names.truncated(F.col(side), options.truncate_to))
    edges = edges.where("src <> dst").distinct()
    degrees = coupling.coupling(edges)
    loud = degrees.where(~filters.not_noise(options.noise_level)).select(F.col("entity").alias("node"))
    edges = filters.drop_edges(edges, loud)
    if options.max_depth:
        near = hops(parsed, edges, options.max_depth).where("depth IS NOT NULL")
        edges = filters.keep_edges(edges, near)
    return edges


#: Fixed value: the name of the root that imports all modules of a project.
ROOT = "__main__"


def root_edges(parsed: DataFrame) -> DataFrame:
    """(src, dst) from ROOT to each module with a legal name, but for those below a folder with a dot in front or
    named ``migrations``."""
    hidden = F.exists(F.split("path", "/"), lambda x: x.startswith(".") | (x == "migrations"))
    legal = parsed.where((F.col("n") == 0) & names.is_legal(F.col("module")) & ~hidden)
    return legal.select(F.lit(ROOT).alias("src"), F.col("module").alias("dst")).distinct()


def hops(parsed: DataFrame, edges: DataFrame, most: int = 0) -> DataFrame:
    """(node, depth) of the modules: hops from ROOT, so a project that is one cycle has a beginning too."""
    spark = parsed.sparkSession
    return graph.hop_distance(edges.unionByName(root_edges(parsed)), spark.createDataFrame([(ROOT,)], "node string"), most)


def discover(spark: SparkSession, root: str, options: Options) -> DataFrame:
    """(path, modified, length) of the sources of a run; ValueError if there are none."""
    root = files.checked_root(root)
    found = files.without_parts(files.listing(spark, root, options.exclude), root, options.exclude_parts)
    found = materialise(files.small_enough(found, options.max_file_bytes), "sources")
    if found.isEmpty():
        raise ValueError(f"no Python files found in project path: {root}")
    return found


def teller(progress: Callable[[dict], None] | None) -> Callable[[str, float], None]:
    def tell(stage: str, share: float) -> None:
        if progress:
            progress({"stage": stage, "progress": share})

    return tell


def analyze_project(
    spark: SparkSession, root: str, options: Options | None = None, progress: Callable[[dict], None] | None = None
) -> AnalysisResult:
    """All tables of a run; see ``analysis``. ``progress`` is called at each stage."""
    options, tell = options or Options(), teller(progress)
    tell("discover", 0.0)
    found = discover(spark, root, options)
    tell("parse", 0.1)
    parsed = materialise(python_ast.parse_files(files.with_content(found, root)), "parsed")
    return analysis(parsed, found, root, options, parsed.where("n = 0").count(), tell)


def analysis(
    parsed: DataFrame, found: DataFrame, root: str, options: Options, fresh: int, tell: Callable[[str, float], None]
) -> AnalysisResult:
    """Tables: modules, packages, classes, methods, fields, imports, edges, import_edges, nodes, cycles, cycle_members,
    coupling, class_quality, cohesion, module_quality, grades, overall, hops, parsed, manifest, run.

    ``parsed``, the nodes, and the listing ``found`` are written tables; ``fresh`` is how many of its files were parsed now.
    """
    spark = parsed.sparkSession
    tell("graph", 0.6)
    imports = materialise(import_edges(parsed, options), "imports")
    tables = {n: materialise(made(parsed), n) for n, made in entities.TABLES.items()}
    tables["modules"] = entities.modules(parsed).select(
        "module_id", "module", "path", "docstring", "physical_lines", "logical_lines", "parse_error",
        names.label(F.col("module")).alias("label"), names.depth(F.col("module")).alias("depth"),
        F.when(names.package_of(F.col("module")).isNotNull(), ids.package_id(names.package_of(F.col("module")))).alias("package_id"),
    )
    tables["packages"] = (
        tables["modules"].where("package_id IS NOT NULL").groupBy(F.col("package_id").alias("id"))
        .agg(F.count("*").alias("n_modules"))
    )
    linked = imports.select(
        F.concat(F.lit("mod:"), "src").alias("from_entity"),
        F.concat(F.lit("mod:"), "dst").alias("to_entity"),
        F.lit("import").alias("relationship_type"),
        F.lit(None).cast("int").alias("line"),
        F.lit(1.0).alias("strength"),
    )
    tables["edges"] = tables["edges"].select(*linked.columns).unionByName(linked)
    tables["import_edges"] = imports
    tables["nodes"] = hierarchy.graph_nodes(
        {
            "package": tables["packages"].select("id", F.substr("id", F.lit(5)).alias("name"), F.lit(None).cast("string").alias("parent_id")),
            "module": tables["modules"].select(F.col("module_id").alias("id"), F.col("module").alias("name"), F.col("package_id").alias("parent_id")),
            "class": tables["classes"].select("id", "name", F.col("module_id").alias("parent_id")),
            "method": tables["methods"].select("id", "name", F.coalesce("class_id", "module_id").alias("parent_id")),
            "field": tables["fields"].select("id", "name", F.col("class_id").alias("parent_id")).distinct(),
        }
    )
    tell("cycles", 0.8)
    tables["cycle_members"] = materialise(cycles.cycle_members(imports), "cycle-members")
    tables["cycles"] = cycles.cycles(tables["cycle_members"])
    tables["hops"] = hops(parsed, imports)
    tell("metrics", 0.9)
    ends = tables["edges"].select(F.col("from_entity").alias("src"), F.col("to_entity").alias("dst"))
    tables["coupling"] = coupling.coupling(ends)
    lines = F.size(F.filter(F.split("body_text", "\n"), lambda x: F.trim(x) != ""))
    per_class = tables["methods"].where("class_id IS NOT NULL").select("class_id", "complexity", lines.alias("lines"))
    tables["class_quality"] = quality.class_quality(per_class, tables["coupling"])
    usage = quality.field_usage(tables["methods"], tables["fields"])
    tables["cohesion"] = quality.cohesion(materialise(usage, "field-usage"), tables["fields"])
    owners = tables["classes"].select(F.col("id").alias("class_id"), "module_id").distinct()
    everywhere = tables["modules"].select("module_id").distinct().join(owners, "module_id", "left")
    tables["module_quality"] = quality.module_rollup(everywhere.join(tables["class_quality"], "class_id", "left"))
    tables["grades"] = quality.grade_distribution(tables["class_quality"])
    tables["overall"] = quality.overall(tables["class_quality"])
    tables["parsed"] = parsed
    tables["manifest"] = files.manifest(found, deep=False)
    tables["run"] = parsed.where("n = 0").agg(F.count("*").alias("total_files"), F.count("parse_error").alias("errors")).select(
        F.lit(uuid.uuid4().hex).alias("analysis_id"), F.lit(root).alias("path"), F.lit(datetime.now(UTC)).alias("analyzed_at"), "*",
        F.lit(fresh).cast("long").alias("parsed_files"),
    )
    tell("done", 1.0)
    return AnalysisResult(tables, options)
