"""Incremental sync: a stream of listing rows kept as the latest version of each path.

Keyed state holds each path's latest version, so a row that comes late or again changes nothing and no history is grouped
anew. What changed goes into a snapshot of shards (``snapshots``), of which a batch rewrites those it touches. A file that was deleted comes as a row with
``gone``; its tombstone keeps older rows from bringing it back, and is dropped ``tombstone_ms`` after it came.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.sources import snapshots

SCHEMA = "file_path string, file_mtime long, file_size long, gone boolean"
VERSION = "file_mtime long, file_size long, gone boolean"
TOMBSTONE_MS = 30 * 24 * 3600 * 1000
TABLE = "listing"


def _order(mtime, size) -> tuple[int, int]:
    return tuple(-1 if pd.isna(v) else int(v) for v in (mtime, size))


def _latest(tombstone_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """A row if the batch changes the path's version; nothing when a tombstone expires."""
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        best, gone = (None, False) if held is None else ((held[0], held[1]), held[2])
        for pdf in batches:
            for mtime, size, dead in zip(pdf["file_mtime"], pdf["file_size"], pdf["gone"], strict=True):
                own, dead = _order(mtime, size), dead is not None and not pd.isna(dead) and bool(dead)
                # of one version's rows a deletion is the later one
                if best is None or own > best or (own == best and dead and not gone):
                    best, gone = own, dead
        if gone:
            state.setTimeoutDuration(tombstone_ms)
        if best is None or held == (*best, gone):
            return
        state.update((*best, gone))
        yield pd.DataFrame({"file_path": [key[0]], "file_mtime": [best[0]], "file_size": [best[1]], "gone": [gone]})

    return step


def put(rows: DataFrame, folder: str) -> None:
    """Write listing rows for a stream to read, in files by size: one for each task that read some of a large source would make
    small batches, and a batch costs much besides its rows."""
    rows.hint("rebalance").write.parquet(folder)


class LostCheckpoint(RuntimeError):
    """The snapshot holds batches of a stream whose checkpoint is gone."""


def _begun(spark: SparkSession, checkpoint: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def start(stream: DataFrame, folder: str, checkpoint: str, tombstone_ms: int = TOMBSTONE_MS, shards: int = snapshots.SHARDS, repair: bool = False):
    """Keep the snapshot in ``folder`` at the latest version of each path of ``stream`` (``SCHEMA``, gone may be missing). Work per
    batch follows its changes; a batch that runs again is committed once. Returns the query.

    A stream whose checkpoint was lost is refused, as its state is lost too; with ``repair`` it starts anew, and what it
    reads again changes nothing, as rows older than the snapshot's are passed over, but tombstones are forgotten. Nulls count as the
    oldest version; rows without a path are left out."""
    spark = stream.sparkSession
    noted = snapshots.manifest(spark, folder).notes
    fresh = not _begun(spark, checkpoint)
    if fresh and "batch" in noted and not repair:
        raise LostCheckpoint(f"{folder} holds {noted['batch'] + 1} batches of a stream, but {checkpoint} holds none: start with repair=True")
    run = noted.get("run", 0) + (1 if fresh else 0)

    def write(batch: DataFrame, number: int) -> None:
        now = snapshots.manifest(spark, folder).notes
        if (now.get("run", 0), now.get("batch", -1)) >= (run, number):
            return
        batch = batch.persist()
        snapshots.upsert(spark, folder, TABLE, batch, "file_path", F.col("gone"), shards, F.struct("file_mtime", "file_size"), run=run, batch=number)
        batch.unpersist()

    rows = stream if "gone" in stream.columns else stream.withColumn("gone", F.lit(False))
    rows = rows.where("file_path is not null").select("file_path", "file_mtime", "file_size", "gone")
    # without new rows there is nothing to do: tombstones expire with the next batch
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle)
    spark.conf.set(idle, "false")
    changes = rows.groupBy("file_path").applyInPandasWithState(_latest(tombstone_ms), SCHEMA, VERSION, "update", GroupStateTimeout.ProcessingTimeTimeout)
    try:
        return changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(idle, before)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The listing that the batches so far add up to."""
    return snapshots.read(spark, folder, TABLE).drop("gone")
