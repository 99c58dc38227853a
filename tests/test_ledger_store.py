"""Merge-on-read ledger: same rows as sequential upserts, small writes, replays, compaction, clean-up."""

import os

from pyspark.sql import functions as F

from corpusflow.operators import ledger as L
from corpusflow.operators.ledger_store import LedgerStore
from corpusflow.streaming import jobs
from tests.test_streaming import writes

LEDGER = ("svn_revision long, git_commit_sha string, svn_author string, svn_timestamp timestamp, svn_message string, "
          "batch_number int, created_at timestamp, updated_at timestamp, status string, error_message string, retry_count int")


def base(spark, n):
    return (spark.range(1, n + 1).select(F.col("id").alias("svn_revision"), F.sha2(F.col("id").cast("string"), 256).alias("git_commit_sha"),
            F.lit("a").alias("svn_author"), F.lit(None).cast("timestamp").alias("svn_timestamp"), F.lit("m").alias("svn_message"),
            F.lit(1).alias("batch_number"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
            F.lit("2024-01-01").cast("timestamp").alias("updated_at"), F.lit("completed").alias("status"),
            F.lit(None).cast("string").alias("error_message"), F.lit(0).alias("retry_count")))


def size(path):
    path = path.removeprefix("file:")
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows(df):
    return sorted(tuple(r) for r in df.select(*L.LEDGER_COLUMNS).collect())


def batches(spark):
    day = "2024-02-{:02d} 00:00:00".format
    return [writes(spark, [(3, 2, "b", None, "x", day(1), 1), (3, 2, "c", None, "y", day(1), 2), (150, 2, "b", None, "n", day(1), 3)]),
            writes(spark, [(3, 3, "late batch, same time", None, "z", day(1), 0), (4, 3, "old", None, "z", "2023-01-01 00:00:00", 9)]),
            writes(spark, []),
            writes(spark, [(k, 4, "many", None, "w", day(2), k) for k in range(1, 40)] + [(990, 4, "new range", None, "w", day(2), 1)]),
            writes(spark, [(2, 5, "after compaction", None, "v", day(3), 1), (-7, 5, "below zero", None, "v", day(3), 2)])]


def test_same_as_sequential_upserts_with_replays(spark):
    path = jobs.scratch_dir(spark, "t-store")
    store = LedgerStore(spark, path, range_size=100)
    want = base(spark, 100).unionByName(base(spark, 120).where("svn_revision > 100"))
    store.create(want)
    for b, batch in enumerate(batches(spark)):
        want = L.ledger_upsert(want, batch)
        store.apply(batch, b)
        assert rows(store.read()) == rows(want), b
        store.apply(batch, b)   # replayed
        assert rows(store.read()) == rows(want), b
    assert {os.path.basename(os.path.dirname(p)) for p in size(f"{path}/data/range=0/kind=base")} == {"gen=4"}   # gen 0 went with the next batch


def test_a_crashed_batch_is_not_seen(spark, monkeypatch):
    store = LedgerStore(spark, jobs.scratch_dir(spark, "t-store"), range_size=100)
    store.create(base(spark, 100))
    batch = batches(spark)[3]

    def stop(*a):
        raise RuntimeError("lost")
    monkeypatch.setattr(LedgerStore, "_write_heads", stop)
    try:
        store.apply(batch, 0)
        raise AssertionError
    except RuntimeError:
        pass
    assert rows(store.read()) == rows(base(spark, 100))
    monkeypatch.undo()
    store.apply(batch, 0)
    assert rows(store.read()) == rows(L.ledger_upsert(base(spark, 100), batch))


def test_bytes_written_follow_the_batch(spark):
    written = {}
    for n in (2_000, 40_000):
        path = jobs.scratch_dir(spark, "t-store")
        store = LedgerStore(spark, path, range_size=1_000)
        store.create(base(spark, n).repartition(4))
        before = size(path)
        store.apply(batches(spark)[0], 0)
        after = size(path)
        assert all(after.get(f) == s for f, s in before.items())   # untouched files keep their bytes
        written[n] = sum(s for f, s in after.items() if f not in before)
    assert written[40_000] <= written[2_000] * 1.1
    assert written[40_000] < sum(before.values()) / 20
