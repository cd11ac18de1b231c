"""What the operators of this subpackage share: tables, scratch folders, bounded Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to a Python worker. Texts may be long, so the batch is small; bytes are bounded as well.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keeps a Python worker's batch small whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Joins batches until they hold size bytes, so what is done once a batch is done less often."""
    held, held_size = [], 0
    for batch in batches:
        if held and held_size + batch.nbytes > size:
            yield pa.concat_batches(held)
            held, held_size = [], 0
        held.append(batch)
        held_size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and each text's number of words. Words are what is between ASCII white space,
    A-Z in lower case; nulls are empty. Arrow splits the texts and tells the words apart, so Python hashes each word of a batch once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    coded = pc.list_flatten(lists).dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    named = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
    at = coded.indices.to_numpy()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    # Splitting leaves an empty string before or after white space at a text's ends.
    empty = np.fromiter((not n for n in names), bool, len(names))
    if empty.any():
        real = ~empty[at]
        bounds = np.append(0, np.cumsum(real))[bounds]
        at = at[real]
    return named[at], np.diff(bounds)


_FORGET: dict[str, Callable[[], None]] = {}
_OWNER: list[str] = []


def worker_cache(owner: str, forget: Callable[[], None]) -> None:
    """Names what empties the caches that an operator keeps in a Python worker between tasks."""
    _FORGET[owner] = forget


def give_back() -> None:
    """Returns freed memory to the system: a worker that waits for its next task then holds little."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library can give memory back
        pass
    pa.default_memory_pool().release_unused()


def own_worker(owner: str) -> None:
    """Called as a task starts: workers are reused by later stages, so one holds the caches of one operator at a time."""
    if _OWNER != [owner]:
        for name, forget in _FORGET.items():
            if name != owner:
                forget()
        _OWNER[:] = [owner]
        gc.collect()
    give_back()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session does without it, in a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (root or "file:///tmp/checkpoints").rstrip("/")


class Scratch:
    """A folder of intermediate tables under the shared root. Tables there survive lost executors and cut lineage.

    Results are lazy and may read from it, so the folder goes when the application ends; what nobody reads again goes by drop().
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/weft-{what}-{uuid.uuid4().hex}"
        fs, at = self._at("")
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it again with the schema it was written with."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            fs, at = self._at(name)
            fs.delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nobody holds any more, so that a long job's disk does not add up."""
    gc.collect()
    spark._jvm.System.gc()


def checked_broadcast(small: DataFrame, rows: int, most: int) -> DataFrame:
    """Hints a broadcast only where the counted rows stay below the bound; beyond it Spark shuffles."""
    return F.broadcast(small) if rows <= most else small
