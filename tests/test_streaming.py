"""Streaming: a restart neither loses nor repeats updates; batch = stream."""

from pyspark.sql import functions as F

from corpusflow.operators import ledger as L
from corpusflow.streaming import jobs

DDL = ("svn_revision long, batch_number int, svn_author string, svn_timestamp timestamp, svn_message string, "
       "ts timestamp, seq long")


def writes(spark, rows):
    return spark.createDataFrame(rows, "svn_revision long, batch_number int, svn_author string, "
                                 "svn_timestamp timestamp, svn_message string, ts string, seq long"
                                 ).withColumn("ts", F.col("ts").cast("timestamp"))


def test_restart_and_replay(spark):
    root = jobs.scratch_dir(spark, "t-stream")
    base = spark.createDataFrame([(1, None, "a", None, "m", 1, None, None, "completed", None, 0)],
                                 "svn_revision long, git_commit_sha string, svn_author string, "
                                 "svn_timestamp timestamp, svn_message string, batch_number int, created_at timestamp, "
                                 "updated_at timestamp, status string, error_message string, retry_count int"
                                 ).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    jobs.write_snapshot(base, f"{root}/ledger", 0)
    w1 = writes(spark, [(2, 1, "b", None, "x", "2024-02-01 00:00:00", 1)])
    w1.coalesce(1).write.parquet(f"{root}/updates")
    schema = w1.schema
    jobs.stream_ledger(spark, f"{root}/updates", schema, f"{root}/ledger", f"{root}/ck")
    # restart with nothing new: no new snapshot, nothing re-applied
    jobs.stream_ledger(spark, f"{root}/updates", schema, f"{root}/ledger", f"{root}/ck")
    snaps = spark.read.parquet(f"{root}/ledger").select("snapshot").distinct().count()
    assert snaps == 2   # the start and the result of batch 0; older ones would be dropped
    # a new file after the restart is applied once
    writes(spark, [(1, 1, "c", None, "y", "2024-03-01 00:00:00", 2)]).coalesce(1).write.mode("append").parquet(
        f"{root}/updates")
    jobs.stream_ledger(spark, f"{root}/updates", schema, f"{root}/ledger", f"{root}/ck")
    final = {r.svn_revision: (r.svn_author, r.status) for r in jobs.latest_snapshot(spark, f"{root}/ledger").collect()}
    assert final == {1: ("c", "pending"), 2: ("b", "pending")}
    batch = L.ledger_upsert(base, writes(spark, [(2, 1, "b", None, "x", "2024-02-01 00:00:00", 1),
                                                 (1, 1, "c", None, "y", "2024-03-01 00:00:00", 2)]))
    assert {r.svn_revision: (r.svn_author, r.status) for r in batch.collect()} == final


def test_reindex_stream_polls_and_restart(spark):
    from corpusflow.sources.files import files_from_table
    root = jobs.scratch_dir(spark, "t-reindex")
    poll1 = files_from_table(spark.createDataFrame([("a.md", "one"), ("b.md", "two")], "p string, c string"), "p", "c")
    poll2 = files_from_table(spark.createDataFrame([("a.md", "one"), ("c.md", "three")], "p string, c string"), "p", "c")
    jobs.publish_poll(poll1.repartition(4), f"{root}/polls", 1)   # a snapshot of several files
    jobs.empty_index(spark, f"{root}/index")
    args = (f"{root}/polls", poll1.schema, f"{root}/index", f"{root}/ds", f"{root}/ck")
    jobs.stream_reindex(spark, *args)
    jobs.stream_reindex(spark, *args)   # restart, nothing new: nothing re-applied
    jobs.publish_poll(poll2.repartition(4), f"{root}/polls", 2)
    jobs.stream_reindex(spark, *args)
    chunks = {r.file_path for r in jobs.latest_snapshot(spark, f"{root}/index/chunks").collect()}
    assert chunks == {"a.md", "c.md"}                       # b.md deleted, c.md new
    ds = spark.read.parquet(f"{root}/ds")
    per_version = {r.version: r.n for r in ds.groupBy("version").agg(F.count("*").alias("n")).collect()}
    assert per_version == {1: 2, 2: 1}                      # version 2 holds only the new file's pair


def test_reindex_reads_a_snapshot_of_many_files_whole(spark):
    from corpusflow.sources.files import files_from_table
    root = jobs.scratch_dir(spark, "t-reindex-many")
    files = files_from_table(spark.createDataFrame([(f"f{k}.md", f"text {k}") for k in range(200)], "p string, c string"), "p", "c")
    jobs.empty_index(spark, f"{root}/index")
    args = (f"{root}/polls", files.schema, f"{root}/index", f"{root}/ds", f"{root}/ck")
    jobs.publish_poll(files.repartition(8), f"{root}/polls", 1)
    jobs.publish_poll(files.where("rel_path <> 'f7.md'").repartition(8), f"{root}/polls", 2)
    jobs.publish_poll(files.where("rel_path <> 'f8.md'").repartition(8), f"{root}/polls", 3)
    jobs.stream_reindex(spark, *args)
    got = {r.file_path for r in jobs.latest_snapshot(spark, f"{root}/index/chunks").collect()}
    assert got == {f"f{k}.md" for k in range(200) if k != 8}
    assert spark.read.parquet(f"{root}/index/chunks").select("snapshot").distinct().count() == 2
