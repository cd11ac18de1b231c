"""A repository's source files as a table, straight from the distributed binary file source."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.parse.languages import SUFFIXES

# Folders that hold no sources.
SKIPPED = (".git", ".venv", "venv", "node_modules", "__pycache__", ".pytest_cache", ".ruff_cache", "dist", "build", "target", ".idea", ".vscode", "egg-info")
FILES = "path string, modificationTime timestamp, length long, content binary"


def language(path: Column) -> Column:
    """The language by suffix (case matters), or null."""
    name = F.substring_index(path, "/", -1)
    table = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))
    return F.try_element_at(table, F.concat(F.lit("."), F.substring_index(name, ".", -1)))


def ignore_patterns(text: str) -> list[str]:
    return [p for line in text.splitlines() if (p := line.strip()) and not p.startswith("#")]


def ignored(relative: Column, patterns: list[str]) -> Column:
    """Whether a relative path is ignored: shell patterns on the path or its last part, or a folder named with a slash."""
    name, out = F.substring_index(relative, "/", -1), F.lit(False)
    for p in (p.replace("\\", "/") for p in patterns):
        # Python writes atomic groups that Java reads alike; the end marker differs.
        regex = "^(?s:" + fnmatch.translate(p).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + ")$"
        out = out | relative.rlike(regex) | name.rlike(regex)
        if p.endswith("/"):
            out = out | relative.startswith(p.rstrip("/") + "/")
    return out


def source_files(spark: SparkSession, root: str, repo_id: str = "default", skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """path, relative, language, repo_id, checksum, content of every source file below root that is neither skipped nor ignored.

    Names are filtered before contents are hashed. The root's ignore file alone is read, on the driver: it is one small text.
    """
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return select_sources(files, _base(spark, root), _patterns(spark, root), repo_id, skipped)


def source_paths(spark: SparkSession, root: str) -> DataFrame:
    """The sorted paths that an ingestion of root would take."""
    return source_files(spark, root).select("path").orderBy("path")


def _base(spark: SparkSession, root: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _patterns(spark: SparkSession, root: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/.gitignore")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    stream = fs.open(p)  # Spark's readers pass over names that start with a dot
    try:
        return ignore_patterns(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def select_sources(files: DataFrame, base: str, patterns: list[str], repo_id: str, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """The same over any table, or stream, of binary files."""
    # Local paths come with one or three slashes after their scheme; others are spelt alike on both sides.
    local = F.regexp_replace("path", "^file:/*", "/")
    relative = F.substring(local, len(re.sub("^file:/*", "/", base)) + 2, 1 << 20)
    folders = F.slice(F.split(relative, "/"), F.lit(1), F.size(F.split(relative, "/")) - 1)
    kept = files.withColumn("language", language(F.col("path"))).where(F.col("language").isNotNull() & ~F.arrays_overlap(folders, F.array(*map(F.lit, skipped))) & ~ignored(relative, patterns))
    return kept.select(local.alias("path"), relative.alias("relative"), "language", F.lit(repo_id).alias("repo_id"), F.sha2("content", 256).alias("checksum"), "content")


def changed_files(files: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Files whose checksum isn't the stored one (path, repo_id, checksum)."""
    if stored is None:
        return files
    return files.join(stored.select("path", "repo_id", "checksum").distinct(), ["path", "repo_id", "checksum"], "left_anti")
