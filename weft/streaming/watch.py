"""Source files as a stream: every micro-batch of new or changed files goes through the same sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weft.operators.ingest import sync
from weft.operators.store import Snapshots
from weft.sources.repo import FILES, _base, _patterns, select_sources


def watch(spark: SparkSession, root: str, store: Snapshots, checkpoint: str, repo_id: str = "default", once: bool = False, files_a_batch: int = 10_000) -> StreamingQuery:
    """Follows root. Batches may repeat after a failure: sync skips files whose checksum is stored."""
    root = root.rstrip("/")
    raw = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(root)
    files = select_sources(raw, _base(spark, root), _patterns(spark, root), repo_id)

    def batch(df: DataFrame, _: int) -> None:
        sync(store, df)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
