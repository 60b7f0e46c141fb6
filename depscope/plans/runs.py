"""Stored runs: tables of an analysis by key, brought up to date, listed, searched, expired and deleted."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depscope.operators import incremental, paging
from depscope.operators.incremental import cache_key
from depscope.plans.project import AnalysisResult, Options, analysis, analyze_project, discover, teller
from depscope.scratch import materialise
from depscope.sources import files, python_ast


class RunStore:
    """Runs below ``root``: one folder a key, one Parquet table a name; the table ``run`` is removed first and
    written last, so a run that has it is whole."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def key(self, project: str, options: Options) -> str:
        return cache_key(project, vars(options))

    def save(self, key: str, result: AnalysisResult) -> None:
        self.fs.delete(self.path(f"{self.root}/{key}/run"), True)
        for name in sorted(result.tables, key=lambda n: n == "run"):
            result.tables[name].write.mode("overwrite").parquet(f"{self.root}/{key}/{name}")

    def has(self, key: str) -> bool:
        return self.fs.exists(self.path(f"{self.root}/{key}/run/_SUCCESS"))

    def status(self, key: str) -> str:
        """completed, incomplete (a run goes on, or broke off) or unknown."""
        if self.has(key):
            return "completed"
        return "incomplete" if self.fs.exists(self.path(f"{self.root}/{key}")) else "unknown"

    def load(self, key: str, options: Options | None = None) -> AnalysisResult:
        if not self.has(key):
            raise KeyError(key)
        found = [s.getPath().getName() for s in self.fs.listStatus(self.path(f"{self.root}/{key}"))]
        tables = {n: self.spark.read.parquet(f"{self.root}/{key}/{n}") for n in found}
        return AnalysisResult(tables, options or Options())

    def keys(self) -> list[str]:
        if not self.fs.exists(self.path(self.root)):
            return []
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(self.root)))
        return [n for n in names if self.has(n)]

    def listing(self) -> DataFrame:
        """(key, path, analyzed_at, total_files, errors) of all runs."""
        out = self.spark.createDataFrame([], "key string, path string, analyzed_at timestamp, total_files long, errors long")
        for key in self.keys():
            run = self.spark.read.parquet(f"{self.root}/{key}/run")
            out = out.unionByName(run.select(F.lit(key).alias("key"), "path", "analyzed_at", "total_files", "errors"))
        return out

    def search(self, query: str, key: str | None = None) -> DataFrame:
        """What ``query`` finds, with its run's key and the cycle flag; in all runs if there is no run ``key``."""
        out = None
        for own in [key] if key is not None and self.has(key) else self.keys():
            found = self.load(own).search(query).withColumn("key", F.lit(own))
            out = found if out is None else out.unionByName(found)
        empty = "id string, name string, level int, kind string, parent_id string, severity string, in_cycle boolean, key string"
        return self.spark.createDataFrame([], empty) if out is None else out

    def sizes(self) -> DataFrame:
        """(id, size, used): each run's bytes and the time of its last write."""
        rows = []
        for key in self.keys():
            folder = self.path(f"{self.root}/{key}")
            changed = self.fs.getFileStatus(self.path(f"{self.root}/{key}/run/_SUCCESS")).getModificationTime()
            rows.append((key, self.fs.getContentSummary(folder).getLength(), datetime.fromtimestamp(changed / 1000, UTC)))
        return self.spark.createDataFrame(rows, "id string, size long, used timestamp")

    def statistics(self, most_mb: float = 500) -> dict:
        total = self.sizes().agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()
        return {"cache_count": total["n"], "total_size_mb": total["s"] / (1 << 20), "max_size_mb": most_mb, "cache_dir": self.root}

    def evict(self, most_mb: float = 500) -> list[str]:
        """Deletes the runs that went unwritten longest until the rest fits, and returns their keys."""
        gone = sorted(r["id"] for r in paging.evict(self.sizes(), int(most_mb * (1 << 20))).collect())
        for key in gone:
            self.delete(key)
        return gone

    def delete(self, key: str) -> bool:
        return self.fs.delete(self.path(f"{self.root}/{key}"), True)

    def clear(self) -> None:
        self.fs.delete(self.path(self.root), True)

    def expire(self, now: datetime, days: int = 7) -> list[str]:
        """Deletes the runs older than ``days`` and returns their keys."""
        old = self.listing().where(F.col("analyzed_at") < F.lit(now - timedelta(days=days))).select("key").collect()
        for row in old:
            self.delete(row["key"])
        return [r["key"] for r in old]

    def fresh_enough(self, key: str, now: datetime, days: int = 7) -> bool:
        """Whether there is a run of ``key``, with what an update needs, that hasn't expired."""
        if not self.has(key):
            return False
        made = self.spark.read.parquet(f"{self.root}/{key}/run").where(F.col("analyzed_at") >= F.lit(now - timedelta(days=days)))
        return not made.isEmpty()

    def analyze(
        self,
        project: str,
        options: Options | None = None,
        progress: Callable[[dict], None] | None = None,
        now: datetime | None = None,
    ) -> AnalysisResult:
        """The stored run of a project with these options, brought up to date.

        Times and lengths show which files may have changed, and only the contents of these are compared; one that was
        merely touched isn't parsed. Nothing has changed: the stored run. Else only changed files and those that import them are parsed, and
        all that follows from parsing is made anew. A run that has expired, or of which over 70 % must be parsed
        again, is made whole.
        """
        options, tell = options or Options(), teller(progress)
        key = self.key(project, options)
        if not self.fresh_enough(key, now or datetime.now(UTC)):
            self.save(key, analyze_project(self.spark, project, options, progress))
            return self.load(key, options)
        stored = self.load(key, options)
        tell("discover", 0.0)
        found = discover(self.spark, project, options)
        quick = materialise(incremental.compare(stored.manifest, files.manifest(found, deep=False)), "status")
        doubtful = found.join(quick.where("status = 'modified'"), "path", "left_semi")
        contents = stored.parsed.where("n = 0").select("path", F.col("content_md5").alias("fingerprint"))
        now_held = files.manifest(files.with_content(doubtful, project))
        status = materialise(incremental.confirmed(quick, contents, now_held), "status")
        if status.where("status <> 'same'").isEmpty():
            return stored
        paths = stored.modules.select("module", "path")
        edges = (
            stored.import_edges.join(paths.withColumnsRenamed({"module": "src", "path": "from"}), "src")
            .join(paths.withColumnsRenamed({"module": "dst", "path": "to"}), "dst")
            .select(F.col("from").alias("src"), F.col("to").alias("dst"))
        )
        actions = materialise(incremental.plan(status, edges), "actions")
        again = actions.where("action = 'analyse'").select("path")
        if incremental.too_many(actions):
            result = analyze_project(self.spark, project, options, progress)
        else:
            tell("parse", 0.1)
            changed = files.with_content(found.join(again, "path", "left_semi"), project)
            fresh = materialise(python_ast.parse_files(changed), "parsed")
            merged = materialise(incremental.merge(stored.parsed, fresh, actions), "parsed")
            result = analysis(merged, found, project, options, fresh.where("n = 0").count(), tell)
        self.save(key, result)
        return self.load(key, options)
