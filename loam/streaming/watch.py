"""Continuous rescans: each micro-batch of changed files is merged into a keyed table of the last state, and diffed against it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loam.sources.keyed import KeyedTable

#: Batches after which data that no recent version needs is removed.
VACUUM_EVERY = 16


def apply_batch(table: KeyedTable, rows: DataFrame, source: str, k: int) -> DataFrame:
    """Merges one batch of (path, content, deleted, at, file) and returns (path, status, hash) of what it changed.

    Only the buckets of the batch's paths are read and written. Of a path's several rows the one of the newest file counts, then
    the last by file name, deletions last. The commit is tagged with the source and the batch's number: a batch that is run
    again is compared with the state before it, returns the same changes and commits nothing.
    """
    m = table.manifest()
    done = m.tags.get(source) if m else None
    before = done[1] - 1 if done and done[0] == k else m.version if m else 0
    row = F.struct("at", "file", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.sha2("content", 256).alias("hash"))
    now = rows.groupBy("path").agg(F.max(row).alias("row")).select("path", "row.deleted", "row.hash").persist()
    old = table.of_keys(now, before) if before else None
    old = old.select("path", F.col("hash").alias("was")) if old is not None else table.spark.createDataFrame([], "path string, was string")
    gone = F.col("deleted") & F.col("was").isNotNull()
    status = F.when(gone, "deleted").when(F.col("deleted"), None).when(F.col("was").isNull(), "new").when(F.col("was") != F.col("hash"), "modified")
    changes = now.join(old, "path", "left").select("path", status.alias("status"), "hash").where("status is not null").persist()
    table.commit(changes.where("status <> 'deleted'").select("path", "hash"), changes.where("status = 'deleted'").select("path"), (source, k))
    now.unpersist()
    return changes


def watch(
    spark: SparkSession, landing: str, state: str, checkpoint: str, on_change: Callable[[DataFrame, int], None], once: bool = True, interval: str = "10 seconds"
) -> StreamingQuery:
    """Reads Parquet files of (path, content, deleted) that land in a folder.

    Every batch updates the keyed table of (path, hash) at ``state`` and hands (path, status) of what changed to ``on_change``, which
    may be called again with the same changes after a failure.
    """
    rows = spark.readStream.schema("path string, content string, deleted boolean").parquet(landing)
    rows = rows.select("*", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"))
    table = KeyedTable(spark, state, ["path"])

    def batch(df: DataFrame, k: int) -> None:
        changes = apply_batch(table, df, checkpoint, k)
        on_change(changes.select("path", "status"), k)
        changes.unpersist()
        if k % VACUUM_EVERY == VACUUM_EVERY - 1:
            table.vacuum()

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def run_until_stopped(query: StreamingQuery) -> None:
    """Waits for the query; an interrupt or a termination signal stops it after its running batch."""
    import signal

    before = {s: signal.signal(s, lambda *_: query.stop()) for s in (signal.SIGINT, signal.SIGTERM)}
    try:
        query.awaitTermination()
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)


def event_rollup(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts by event type and time window of a stream with late rows (an extension)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
