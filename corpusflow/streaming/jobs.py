"""Structured Streaming jobs.

The reference polls and resumes in batches; here each poll is a micro-batch
of a file source with a checkpoint, and every ``foreachBatch`` write is keyed
by the batch id so a replayed batch rewrites the same snapshot instead of
appending twice. State lives in snapshot directories under a shared folder:
``snapshot=N`` is written from ``snapshot=N-1`` and never overwritten while
it may be read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import changes, chunking, ledger, pairs
from ..operators.index_store import IndexStore
from ..operators.ledger_store import LedgerStore
from ..session import checkpoint_dir

SNAPSHOT = "snapshot"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest ``snapshot=N`` partition (partition-pruned read)."""
    df = spark.read.parquet(path)
    top = df.agg(F.max(SNAPSHOT)).first()[0]
    return df.where(F.col(SNAPSHOT) == top).drop(SNAPSHOT)


def _snapshot_path(path: str, n: int) -> str:
    return f"{path}/{SNAPSHOT}={n}"


def write_snapshot(df: DataFrame, path: str, n: int) -> None:
    df.write.mode("overwrite").parquet(_snapshot_path(path, n))


def drop_snapshot(spark: SparkSession, path: str, n: int) -> None:
    """Delete a snapshot that no replay can need any more (a replay of batch b reads snapshot b)."""
    if n >= 0:
        target = spark._jvm.org.apache.hadoop.fs.Path(_snapshot_path(path, n))
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


# ---------------------------------------------------------------------------
# Ledger updates
# ---------------------------------------------------------------------------

def stream_ledger(spark: SparkSession, updates_dir: str, updates_schema: T.StructType, ledger_path: str,
                  checkpoint: str, files_per_batch: int = 1) -> None:
    """Apply checkpoint writes (J9) arriving as files, one snapshot per batch.

    ``ledger_path`` must hold ``snapshot=0`` (the starting ledger). Batch b
    reads snapshot b and writes snapshot b+1, so a restart neither loses nor
    repeats an update: the checkpoint skips committed batches, and a batch
    replayed after a crash rewrites the same snapshot from the same input.
    Snapshots that no replay can need are dropped.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        base = spark.read.parquet(_snapshot_path(ledger_path, batch_id))
        write_snapshot(ledger.ledger_upsert(base, batch), ledger_path, batch_id + 1)
        drop_snapshot(spark, ledger_path, batch_id - 1)

    q = (spark.readStream.format("parquet").schema(updates_schema)
         .option("maxFilesPerTrigger", files_per_batch).load(updates_dir)
         .writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_ledger_store(store: LedgerStore, updates_dir: str, updates_schema: T.StructType, checkpoint: str,
                        files_per_batch: int = 1) -> None:
    """T2 on a merge-on-read ledger: each micro-batch writes its own deltas instead of the ledger. A batch
    replayed after a crash replaces what it wrote; the checkpoint skips committed batches."""
    q = (store.spark.readStream.format("parquet").schema(updates_schema)
         .option("maxFilesPerTrigger", files_per_batch).load(updates_dir)
         .writeStream.foreachBatch(store.apply).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


# ---------------------------------------------------------------------------
# Re-index on change
# ---------------------------------------------------------------------------

POLL_SCHEMA = "poll long, path string"


def publish_poll(files: DataFrame, polls_dir: str, poll: int) -> None:
    """Publish a full snapshot of the source files as poll ``poll``: its rows go to any number of
    files under ``data/poll=N`` (a repeated write replaces them), and only then is it announced by
    one small file under ``ready``."""
    path = f"{polls_dir}/data/poll={poll}"
    files.write.mode("overwrite").parquet(path)
    (files.sparkSession.createDataFrame([(poll, path)], POLL_SCHEMA).coalesce(1)
     .write.mode("overwrite").json(f"{polls_dir}/ready/{poll:012d}"))


def stream_reindex(spark: SparkSession, polls_dir: str, files_schema: T.StructType, index_path: str,
                   dataset_path: str, checkpoint: str, project: str = "default") -> None:
    """Re-index per announced poll (``publish_poll``): diff the poll's whole snapshot with the index
    state (J1), chunk only new/modified files (U3), merge the chunk index (J3), and write the pairs of
    the new chunks as dataset version ``batch_id + 1`` (U4, S5). One announcement is one micro-batch,
    so a snapshot is read whole, however many files it has. ``index_path`` holds ``chunks`` and
    ``state`` snapshots; ``snapshot=0`` must exist (it may be empty)."""
    def apply(announced: DataFrame, batch_id: int) -> None:
        polls = announced.orderBy("poll").collect()  # one row by maxFilesPerTrigger
        if len(polls) != 1:
            raise ValueError(f"micro-batch {batch_id} announces {len(polls)} polls")
        files = spark.read.schema(files_schema).parquet(polls[0]["path"])
        stamp = F.current_timestamp()
        state = spark.read.parquet(_snapshot_path(f"{index_path}/state", batch_id))
        old_chunks = spark.read.parquet(_snapshot_path(f"{index_path}/chunks", batch_id))
        # the diff and the new chunks feed three writes each: keep them for this batch only
        diff = changes.diff_snapshots(files, state, carry=["path", "ext", "content"]).persist()
        new_chunks = chunking.extract_chunks(changes.changed_files(diff), stamp).persist()
        write_snapshot(changes.upsert_index(old_chunks, new_chunks, diff), f"{index_path}/chunks", batch_id + 1)
        write_snapshot(changes.next_state(state, diff, new_chunks, stamp), f"{index_path}/state", batch_id + 1)
        new_pairs = pairs.generate_pairs(new_chunks, stamp, version=batch_id + 1)
        (new_pairs.withColumn("project", F.lit(project)).write.mode("overwrite")
         .parquet(f"{dataset_path}/project={project}/version={batch_id + 1}"))
        new_chunks.unpersist()
        diff.unpersist()
        for kind in ("chunks", "state"):
            drop_snapshot(spark, f"{index_path}/{kind}", batch_id - 1)

    q = (spark.readStream.format("json").schema(POLL_SCHEMA).option("maxFilesPerTrigger", 1)
         .option("recursiveFileLookup", "true").load(f"{polls_dir}/ready")
         .writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def empty_index(spark: SparkSession, index_path: str) -> None:
    """Write an empty snapshot 0 for ``stream_reindex``."""
    chunks = spark.createDataFrame([], chunking.CHUNK_SCHEMA)
    state = spark.createDataFrame([], "rel_path string, file_sha string, last_indexed timestamp, chunks_count int")
    write_snapshot(chunks, f"{index_path}/chunks", 0)
    write_snapshot(state, f"{index_path}/state", 0)


def stream_reindex_store(store: IndexStore, polls_dir: str, files_schema: T.StructType, dataset_path: str,
                         checkpoint: str, project: str = "default") -> None:
    """T1 on a bucketed index: as ``stream_reindex``, but each poll rewrites only the buckets that hold
    a changed path. The pairs of the new chunks are dataset version ``batch_id + 1``."""
    spark = store.spark

    def apply(announced: DataFrame, batch_id: int) -> None:
        polls = announced.orderBy("poll").collect()  # one row by maxFilesPerTrigger
        if len(polls) != 1:
            raise ValueError(f"micro-batch {batch_id} announces {len(polls)} polls")
        stamp = F.current_timestamp()
        new_chunks = store.apply(spark.read.schema(files_schema).parquet(polls[0]["path"]), batch_id, stamp)
        (pairs.generate_pairs(new_chunks, stamp, version=batch_id + 1).withColumn("project", F.lit(project)).write.mode("overwrite")
         .parquet(f"{dataset_path}/project={project}/version={batch_id + 1}"))
        new_chunks.unpersist()

    q = (spark.readStream.format("json").schema(POLL_SCHEMA).option("maxFilesPerTrigger", 1)
         .option("recursiveFileLookup", "true").load(f"{polls_dir}/ready")
         .writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


# ---------------------------------------------------------------------------
# Event log
# ---------------------------------------------------------------------------

def stream_event_log(spark: SparkSession, events_dir: str, events_schema: T.StructType, log_path: str,
                     checkpoint: str) -> None:
    """Append phase events continuously (stamping ``logged_at``); the file
    sink's own log makes the append exactly-once across restarts."""
    q = (spark.readStream.format("parquet").schema(events_schema).load(events_dir)
         .withColumn("logged_at", F.current_timestamp())
         .writeStream.format("parquet").option("path", log_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
