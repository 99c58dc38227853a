"""Registered streaming queries: each stages its input files (derived from the
supplied tables) under the shared checkpoint folder, runs the stream to
completion with ``availableNow``, and returns the resulting table. The
oracles are those of the equivalent batch operators: batch = stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.index_store import IndexStore
from ..operators.ledger_store import LedgerStore
from ..sources import fixtures as fx
from ..streaming import jobs
from . import oracle_fixtures as ofx
from .catalog import ORACLE, query
from .queries_ledger import ledger_view

W = ofx.with_ctes


@query("stream_ledger")
def q_stream_ledger(spark, sf):
    root = jobs.scratch_dir(spark, "stream-ledger")
    writes = fx.checkpoint_writes(spark, sf)
    # three update files, applied as three micro-batches
    writes.repartition(3, F.col("seq") % 3).write.parquet(f"{root}/updates")
    store = LedgerStore(spark, f"{root}/ledger", range_size=1_000)
    store.create(fx.ledger(spark, sf))
    jobs.stream_ledger_store(store, f"{root}/updates", writes.schema, f"{root}/_checkpoint")
    return ledger_view(store.read())


@query("stream_reindex")
def q_stream_reindex(spark, sf):
    root = jobs.scratch_dir(spark, "stream-reindex")
    prev, cur = fx.snapshot_previous(spark, sf), fx.snapshot_files(spark, sf)
    # two polls of the tree: the previous snapshot, then the current one
    jobs.publish_poll(prev.repartition(5), f"{root}/polls", 1)
    jobs.publish_poll(cur.repartition(4), f"{root}/polls", 2)
    store = IndexStore(spark, f"{root}/index", buckets=16)
    jobs.stream_reindex_store(store, f"{root}/polls", cur.schema, f"{root}/dataset", f"{root}/_checkpoint")
    return store.read("chunks").select("chunk_id", "file_path", "checksum")


@query("stream_event_log", "SELECT event_id, event_type, props FROM events")
def q_stream_event_log(spark, sf):
    root = jobs.scratch_dir(spark, "stream-events")
    ev = fx.read_table(spark, sf, "events").select("event_id", "ts", "event_type", "value", "props")
    ev.repartition(4).write.parquet(f"{root}/incoming")
    jobs.stream_event_log(spark, f"{root}/incoming", ev.schema, f"{root}/log", f"{root}/_checkpoint")
    return spark.read.parquet(f"{root}/log").select("event_id", "event_type", "props")


def _share_oracles() -> None:
    # batch = stream: the streaming results are checked against the batch oracles
    from . import queries_changes, queries_ledger  # noqa: F401  (register the batch keys first)
    ORACLE["stream_ledger"] = ORACLE["ledger_upsert"]
    ORACLE["stream_reindex"] = ORACLE["index_upsert"]


_share_oracles()

