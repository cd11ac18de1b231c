"""Snapshot store: upserts, deletions and resets over versioned Parquet snapshots; one pointer file a batch makes it atomic."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Merge keys of the tables.
KEYS: dict[str, tuple[str, ...]] = {
    "file": ("path", "repo_id"), "class_": ("fqn", "repo_id"), "method": ("fqn", "repo_id"), "package": ("name", "repo_id"), "folder": ("path", "name", "repo_id"),
    "endpoint": ("path", "http_method", "repo_id"), "route_call": ("source_method_fqn", "path", "http_method", "repo_id"),
    "contains": ("src_label", "src", "dst_label", "dst", "repo_id"), "handles": ("src", "path", "http_method", "repo_id"), "makes_call": ("src", "path", "http_method", "repo_id"),
    "calls": ("src", "dst", "repo_id"), "imports": ("src", "dst", "symbols", "repo_id"), "routes_to": ("source_method_fqn", "rc_path", "http_method", "endpoint_path", "repo_id"),
}


def latest(rows: DataFrame, key: tuple[str, ...], seq: str = "ingest_seq") -> DataFrame:
    """The last written row of each key."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(seq)))
    return rows.withColumn("nth_", nth).where("nth_ = 1").drop("nth_")


def upsert(existing: DataFrame, new: DataFrame, key: tuple[str, ...], seq: str | None = None) -> DataFrame:
    """existing with new's rows in place of those of the same key; keys compare with nulls equal."""
    new = latest(new, key, seq) if seq else new.dropDuplicates(list(key))
    same = [existing[k].eqNullSafe(new[k]) for k in key]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return existing.join(new, cond, "left_anti").unionByName(new, allowMissingColumns=True)


def detach(nodes: DataFrame, edges: list[DataFrame], fqns: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Nodes without the given fqns, and edges (src, dst) without those that touch them."""
    gone = fqns.select("fqn").distinct()
    kept = nodes.join(gone, "fqn", "left_anti")
    cut = lambda e: e.join(gone.withColumnRenamed("fqn", "src"), "src", "left_anti").join(gone.withColumnRenamed("fqn", "dst"), "dst", "left_anti")
    return kept, [cut(e) for e in edges]


def sync_diff(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(fqn, change): added, removed or updated, by one full outer join."""
    a, b = existing.select("fqn").distinct().withColumn("old", F.lit(True)), new.select("fqn").distinct().withColumn("fresh", F.lit(True))
    change = F.when(F.col("old").isNull(), "added").when(F.col("fresh").isNull(), "removed").otherwise("updated")
    return a.join(b, "fqn", "full").select("fqn", change.alias("change"))


def repeated_keys(rows: DataFrame, table: str) -> DataFrame:
    """Merge keys that occur more than once, with their number of rows: empty for a table that keeps its constraint."""
    return rows.groupBy(*(k for k in KEYS[table] if k in rows.columns)).agg(F.count("*").alias("rows")).where("rows > 1")


class Snapshots:
    """Tables under root, each a folder of numbered snapshots, and batches: a batch names the version of every table that counts.

    Inside ``with store.batch():`` writes are seen by the writer alone; the batch's file, made under another name and renamed, shows
    all of them at once. A write outside a batch is a batch of its own. A batch that fails leaves the tables as they were.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._staged: dict[str, int] | None = None

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _numbers(self, folder: str, first: str) -> list[int]:
        fs, path = self._fs()
        at = path(f"{self.root}/{folder}")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[1:]) for n in names if n[:1] == first and n[1:].isdigit())

    def current(self) -> dict[str, int]:
        """The version of each table that counts now."""
        if self._staged is not None:
            return self._staged
        batches = self._numbers("_batches", "b")
        if not batches:
            return {}
        fs, path = self._fs()
        stream = fs.open(path(f"{self.root}/_batches/b{batches[-1]:08d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    @contextlib.contextmanager
    def batch(self) -> Iterator[None]:
        if self._staged is not None:  # part of an outer batch
            yield
            return
        before = self.current()
        self._staged = dict(before)
        try:
            yield
            if self._staged != before:
                self._publish(self._staged)
        finally:
            self._staged = None

    def _publish(self, versions: dict[str, int]) -> None:
        fs, path = self._fs()
        n = (self._numbers("_batches", "b") or [0])[-1] + 1
        fs.mkdirs(path(f"{self.root}/_batches"))
        made = path(f"{self.root}/_batches/_new-{uuid.uuid4().hex}")
        stream = fs.create(made, True)
        stream.write(json.dumps(versions).encode())
        stream.close()
        if not fs.rename(made, path(f"{self.root}/_batches/b{n:08d}")):
            fs.delete(made, False)
            raise RuntimeError(f"batch {n} was written by someone else meanwhile")

    def read(self, table: str) -> DataFrame | None:
        v = self.current().get(table)
        return self.spark.read.parquet(f"{self.root}/{table}/v{v:08d}") if v else None

    def write(self, table: str, df: DataFrame) -> None:
        v = max([*self._numbers(table, "v"), 0]) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/v{v:08d}")
        with self.batch():
            self._staged[table] = v

    def merge(self, table: str, new: DataFrame, seq: str | None = None) -> None:
        old = self.read(table)
        key = tuple(k for k in KEYS[table] if k in new.columns)
        self.write(table, latest(new, key, seq) if old is None and seq else new.dropDuplicates(list(key)) if old is None else upsert(old, new, key, seq))

    def retain(self, batches: int = 2) -> int:
        """Drops the versions that none of the last batches names; returns how many."""
        fs, path = self._fs()
        numbers, kept, gone = self._numbers("_batches", "b"), set(), 0
        for n in numbers[-batches:]:
            stream = fs.open(path(f"{self.root}/_batches/b{n:08d}"))
            kept |= set(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).items())
            stream.close()
        for n in numbers[:-batches]:
            fs.delete(path(f"{self.root}/_batches/b{n:08d}"), False)
        for table in {t for t, _ in kept}:
            for v in self._numbers(table, "v"):
                if (table, v) not in kept:
                    fs.delete(path(f"{self.root}/{table}/v{v:08d}"), True)
                    gone += 1
        return gone

    def reset(self, repo_id: str | None = None) -> None:
        with self.batch():
            for table in KEYS:
                old = self.read(table)
                if old is not None:
                    self.write(table, old.where(F.col("repo_id") != repo_id) if repo_id and "repo_id" in old.columns else old.limit(0))
