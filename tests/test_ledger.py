"""Ledger operators, with the assertions of the reference's unit tests."""

from pyspark.sql import functions as F

from corpusflow.functions import describe
from corpusflow.operators import ledger as L

LEDGER_DDL = ("svn_revision long, git_commit_sha string, svn_author string, svn_timestamp timestamp, "
              "svn_message string, batch_number int, created_at timestamp, updated_at timestamp, status string, "
              "error_message string, retry_count int")


def ten_created(spark, completed=(1, 2)):
    rows = []
    for r in range(1, 11):
        done = r in completed
        rows.append((r, f"sha{r}" if done else None, "testuser", None, "msg", 1, None, None,
                     "completed" if done else "pending", None, 0))
    return spark.createDataFrame(rows, LEDGER_DDL).withColumn(
        "updated_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))


def test_defaults():
    assert L.DEFAULT_BATCH_SIZE == 50


def test_summary_ten_created_two_completed(spark):
    s = L.migration_summary(ten_created(spark)).first()
    assert (s.total_revisions, s.completed, s.pending) == (10, 2, 8)
    assert s.progress_percent == 20.0


def test_summary_empty_is_zero(spark):
    s = L.migration_summary(spark.createDataFrame([], LEDGER_DDL)).first()
    assert (s.total_revisions, s.progress_percent) == (0, 0.0)


def test_last_completed(spark):
    assert L.last_completed(ten_created(spark, completed=(1,))).first()[0] == 1
    assert L.last_completed(ten_created(spark, completed=())).first()[0] == 0


def test_pending_excludes_failed(spark):
    led = ten_created(spark, completed=())
    tr = spark.createDataFrame([(1, "failed", None, "Test error", "2024-01-02 00:00:00", 1)],
                               "svn_revision long, status string, git_commit_sha string, error_message string, "
                               "ts string, seq long").withColumn("ts", F.col("ts").cast("timestamp"))
    applied = L.apply_status(led, tr)
    pend = [r.svn_revision for r in L.pending_revisions(applied).collect()]
    assert 1 not in pend and len(pend) == 9
    assert applied.where("svn_revision = 1").first().error_message == "Test error"


def test_completion_resets_retries_and_keeps_error(spark):
    led = ten_created(spark, completed=()).withColumn("retry_count", F.lit(2))
    tr = spark.createDataFrame([
        (3, "failed", None, "boom", "2024-01-02 00:00:00", 1),
        (3, "completed", "abc", None, "2024-01-03 00:00:00", 2),
        (3, "in_progress", None, None, "2024-01-04 00:00:00", 3)],
        "svn_revision long, status string, git_commit_sha string, error_message string, ts string, seq long"
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    r = L.apply_status(led, tr).where("svn_revision = 3").first()
    assert (r.status, r.git_commit_sha, r.error_message, r.retry_count) == ("in_progress", "abc", "boom", 0)


def test_upsert_last_write_wins_and_idempotent(spark):
    led = ten_created(spark)
    writes = spark.createDataFrame([
        (1, 2, "x", None, "m1", "2024-02-01 00:00:00", 5),
        (1, 2, "y", None, "m2", "2024-02-01 00:00:00", 6),
        (11, 1, "z", None, "m3", "2024-02-02 00:00:00", 7)],
        "svn_revision long, batch_number int, svn_author string, svn_timestamp timestamp, svn_message string, "
        "ts string, seq long").withColumn("ts", F.col("ts").cast("timestamp"))
    once = L.ledger_upsert(led, writes)
    r1 = once.where("svn_revision = 1").first()
    assert (r1.svn_author, r1.status, r1.git_commit_sha) == ("y", "pending", None)   # replaced row loses sha
    assert once.count() == 11
    twice = L.ledger_upsert(once, writes)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_resume_gaps_include_failures(spark):
    led = ten_created(spark, completed=(1, 2, 4))
    gaps = [r.svn_revision for r in L.resume_gaps(spark, led, 12).collect()]
    assert sorted(gaps) == [3, 5, 6, 7, 8, 9, 10, 11, 12]


def test_classify_and_commit_message(spark):
    df = spark.createDataFrame([("TimeoutError",), ("GitPushError",), ("SVNFetchError",), ("KeyError",)], "e string")
    modes = [r[0] for r in df.select(describe.classify_error(F.col("e"))).collect()]
    assert modes == ["timeout", "transient", "permanent", "permanent"]
    m = spark.createDataFrame([("  ", 7, 0), ("fix", 8, 3)], "message string, revision long, files_changed int")
    msgs = [r[0] for r in m.select(describe.commit_message(F.col("message"), F.col("revision"),
                                                           F.col("files_changed"))).collect()]
    assert msgs == ["Empty commit\n\n[SVN r7]", "fix\n\n[SVN r8] | 3 files changed"]


def test_batches(spark):
    revs = spark.range(1, 121).withColumnRenamed("id", "revision")
    b = {r.batch_number: (r.first_revision, r.last_revision, r.n_revisions)
         for r in L.batch_bounds(L.assign_batches(revs, start=1, size=50)).collect()}
    assert b == {1: (1, 50, 50), 2: (51, 100, 50), 3: (101, 120, 20)}
    assert [r.revision for r in L.revisions_in_range(revs, 10, 100, limit=5).collect()] == [10, 11, 12, 13, 14]


def test_new_checkpoint_is_pending(spark):
    led = ten_created(spark, completed=tuple(range(1, 11)))
    assert L.pending_revisions(led).count() == 0
    w = spark.createDataFrame([(42, 1, "testuser", None, "msg", "2024-01-01 00:00:00", 1)],
                              "svn_revision long, batch_number int, svn_author string, svn_timestamp timestamp, "
                              "svn_message string, ts string, seq long").withColumn("ts", F.col("ts").cast("timestamp"))
    pend = L.pending_revisions(L.ledger_upsert(led, w)).collect()
    assert [(r.svn_revision, r.status, r.batch_number) for r in pend] == [(42, "pending", 1)]
