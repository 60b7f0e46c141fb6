"""Source files of a project as a table, and its size.

Folders are walked by tasks: each lists its share of folders and what lies below them, a bounded
number of entries a round, and hands on the folders it didn't come to. An excluded folder isn't
entered. Only names, times and lengths are listed; contents are read by tasks where they are wanted.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depscope.functions.globs import Matcher
from depscope.functions.metrics import size_tier
from depscope.scratch import materialise

#: What is left out if nothing else is said.
EXCLUDE = ["__pycache__", ".git", ".venv", "venv", "env", "tests"]
#: Parts of paths that a check before a run leaves out.
NEVER = ["GoogleDrive", "Library", "__pycache__", ".git", "node_modules", ".venv"]
#: Where sources are looked for if the project is the file system's root.
ROOT_FOLDERS = ["/Users", "/home", "/opt", "/usr/local/src", "/tmp"]
LARGE = 10 << 20
LISTED = "path string, modified timestamp, length long, folder boolean"


def entries(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """What a folder holds; nothing if it has gone or may not be read."""
    try:
        return store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    except PermissionError:
        return []


def listing(
    spark: SparkSession, root: str, exclude: list[str] | None = None, pattern: str = "*.py", per_task: int = 10_000
) -> DataFrame:
    """(path, modified, length) of the files below ``root``, paths relative to it, that no exclude pattern hits.

    A task lists ``per_task`` entries a round, so a small tree takes one round and a large one is
    shared out from the second round on. A link to a folder isn't followed, so nothing is listed twice and no
    circle is entered; a folder that can't be read is passed over.
    """
    patterns = EXCLUDE if exclude is None else exclude

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        matcher, top, listed = Matcher(patterns), top.rstrip("/"), 0
        for batch in batches:
            waiting = batch.column("path").to_pylist()
            while waiting:
                rows, at = [], waiting.pop()
                if listed >= per_task:
                    rows.append((at, None, 0, True))
                else:
                    for info in entries(store, f"{top}/{at}" if at else top or "/"):
                        listed += 1
                        path = info.path[len(top) + 1 :]
                        folder = info.type == fs.FileType.Directory
                        if matcher.hits(path, folder) or not (folder or fnmatch(info.base_name, pattern)):
                            continue
                        if folder and not (store.type_name == "local" and os.path.islink(info.path)):
                            waiting.append(path)
                        elif info.is_file:
                            rows.append((path, info.mtime, info.size, False))
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                kinds = [pa.string(), pa.timestamp("us", tz="UTC"), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "modified", "length", "folder"]
                )

    todo, found = spark.createDataFrame([("",)], "path string"), None
    while True:
        seen = materialise(todo.mapInArrow(walk, LISTED), "listing")
        files = seen.where("NOT folder").select("path", "modified", "length")
        found = files if found is None else materialise(found.unionByName(files), "listing")
        left = seen.where("folder").select("path")
        if left.isEmpty():
            return found
        todo = left.repartition(spark.sparkContext.defaultParallelism, "path")


def with_content(files: DataFrame, root: str) -> DataFrame:
    """``files`` (path and more) with content. A file that has gone since it was listed has a null one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                piece, content = batch.slice(at, 100), []
                for path in piece.column("path").to_pylist():
                    try:
                        with store.open_input_stream(f"{top.rstrip('/')}/{path}") as stream:
                            content.append(stream.read())
                    except FileNotFoundError:
                        content.append(None)
                yield piece.append_column("content", pa.array(content, pa.binary()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(read, f"{fields}, content binary")


def small_enough(files: DataFrame, most_bytes: int = 0) -> DataFrame:
    """``files`` (length) of at most ``most_bytes``; 0 keeps all."""
    return files.where(F.col("length") <= most_bytes) if most_bytes else files


def without_parts(files: DataFrame, root: str, parts: list[str]) -> DataFrame:
    """``files`` whose full path holds none of ``parts``, wherever it stands."""
    full = F.concat(F.lit(root.rstrip("/") + "/"), "path")
    for part in parts:
        files = files.where(~F.contains(full, F.lit(part)))
    return files


def source_files(
    spark: SparkSession, root: str, exclude: list[str] | None = None, pattern: str = "*.py", most_bytes: int = 0
) -> DataFrame:
    """(path, modified, length, content) of the files below ``root`` that no exclude pattern hits; ``most_bytes``
    over 0 leaves out larger ones before they are read."""
    return with_content(small_enough(listing(spark, root, exclude, pattern), most_bytes), root)


def checked_root(root: str) -> str:
    """``root`` without blanks around it; ValueError if it isn't an absolute path of a folder."""
    root = root.strip()
    if "://" not in root and not root.startswith("/"):
        raise ValueError(f"a project's path must be absolute: {root}")
    store, path = fs.FileSystem.from_uri(root)
    kind = store.get_file_info(path).type
    if kind == fs.FileType.NotFound:
        raise ValueError(f"there is no such project path: {root}")
    if kind != fs.FileType.Directory:
        raise ValueError(f"a project's path must be a folder: {root}")
    return root


def precheck(spark: SparkSession, root: str, parts: list[str] | None = None) -> DataFrame:
    """The sources (path, modified, length) that a run of ``root`` would see before its own patterns; ValueError
    if the path isn't a folder's or there are none. Of ``/`` only the usual folders are looked through."""
    root, found = checked_root(root), None
    for top in ROOT_FOLDERS if root == "/" else [root]:
        below = without_parts(listing(spark, top, []), top, [*(parts or []), *NEVER])
        found = below if found is None else found.unionByName(below)
    if found.isEmpty():
        raise ValueError(f"no Python files found in project path: {root}")
    return found


def project_size(files: DataFrame) -> DataFrame:
    """One row: files, bytes, large_files, tier, estimated_mb. Content isn't read."""
    return files.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.count_if(F.col("length") > LARGE).alias("large_files"),
    ).select("*", size_tier(F.col("files")).alias("tier"), (2 * F.col("bytes") / (1 << 20)).alias("estimated_mb"))


def manifest(files: DataFrame, deep: bool = True) -> DataFrame:
    """(path, fingerprint): the content's md5, or the quick one of time and length."""
    quick = F.concat_ws(":", F.unix_micros("modified").cast("string"), F.col("length").cast("string")) if not deep else None
    return files.select("path", (F.md5("content") if deep else quick).alias("fingerprint"))


def package_roots(files: DataFrame) -> DataFrame:
    """(path, kind, package_root): of each file its folder's kind, package or directory, and the nearest folder above
    it without an ``__init__.py``, empty for the project's own; null if all have one."""
    steps = F.split("path", "/")
    own = F.array_join(F.slice(steps, F.lit(1), F.size(steps) - 1), "/")
    depth = F.explode(F.sequence(F.lit(0), F.size(steps) - 1))
    above = files.select("path", own.alias("folder"), depth.alias("n")).withColumn(
        "at", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("n")), "/")
    )
    marked = files.where(F.element_at(steps, -1) == "__init__.py").select(own.alias("at"), F.lit(True).alias("init")).distinct()
    met = above.join(marked, "at", "left")
    plain = F.col("init").isNull()
    return met.groupBy("path").agg(
        F.when(F.bool_or((F.col("at") == F.col("folder")) & ~plain), "package").otherwise("directory").alias("kind"),
        F.max_by(F.when(plain, F.col("at")), F.when(plain, F.col("n"))).alias("package_root"),
    )


#: Import names of distributions that don't list theirs.
KNOWN_DISTRIBUTIONS = {"yaml": "PyYAML", "Crypto": "pycrypto"}


def distribution_names(spark: SparkSession, site_folders: list[str]) -> DataFrame:
    """(module, distribution) from the ``top_level.txt`` files of installed packages; the first folder that has
    a module's name wins, then the least distribution name."""
    out = spark.createDataFrame([(m, d, len(site_folders)) for m, d in KNOWN_DISTRIBUTIONS.items()], "module string, distribution string, n int")
    for n, folder in enumerate(site_folders):
        listed = listing(spark, folder, [], "top_level.txt").where(
            F.col("path").rlike(r"^[^/]+\.(dist-info|egg-info)/top_level\.txt$|^[^/]+\.egg/EGG-INFO/top_level\.txt$")
        )
        title = F.regexp_replace(F.split_part("path", F.lit("/"), F.lit(1)), r"\.[^.]*$", "")
        words = F.filter(F.split(F.decode("content", "utf-8"), r"\s+"), lambda w: w != "")
        rows = with_content(listed, folder).select(
            F.explode(words).alias("m"), F.translate(F.split_part(title, F.lit("-"), F.lit(1)), "_", "-").alias("distribution")
        )
        name = F.when(F.col("m").startswith("win32\\lib"), F.split_part("m", F.lit("\\"), F.lit(2))).otherwise(F.translate("m", "/", "."))
        out = out.unionByName(rows.select(name.alias("module"), "distribution", F.lit(n).alias("n")))
    first = F.min(F.struct("n", "distribution"))["distribution"]
    return out.groupBy("module").agg(first.alias("distribution"))
