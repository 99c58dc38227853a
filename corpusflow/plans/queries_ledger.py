"""Registered ledger queries (and their oracles)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..sources import fixtures as fx
from . import oracle_fixtures as ofx
from .catalog import query

W = ofx.with_ctes


def wall_clock(c: str) -> F.Column:
    """A timestamp as its wall-clock text: the same in every session time zone
    (the supplied timestamps carry no zone)."""
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def ledger_view(df: DataFrame) -> DataFrame:
    return df.select("svn_revision", "git_commit_sha", "svn_author", "svn_message",
                     F.col("batch_number").cast("bigint").alias("batch_number"), "status", "error_message",
                     F.col("retry_count").cast("bigint").alias("retry_count"),
                     wall_clock("updated_at"))


LEDGER_VIEW_SQL = """SELECT svn_revision::BIGINT AS svn_revision, git_commit_sha, svn_author, svn_message,
       batch_number::BIGINT AS batch_number, status, error_message, retry_count::BIGINT AS retry_count,
       strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM {src}"""


# ---------------------------------------------------------------------------
# revision log
# ---------------------------------------------------------------------------

@query("revision_log", W(ofx.REVISIONS) + """
SELECT revision::BIGINT AS revision, coalesce(author, 'unknown') AS author,
       strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, message, files_changed::BIGINT AS files_changed
FROM revisions""")
def q_revision_log(spark, sf):
    revs = L.chronological(L.parse_log_xml(fx.revision_log_xml(spark, sf)))
    return revs.select("revision", "author", "timestamp", "message",
                       F.col("files_changed").cast("bigint").alias("files_changed"))


@query("head_revision", "SELECT count(*)::BIGINT AS head_revision FROM orders")
def q_head_revision(spark, sf):
    return L.head_revision(L.parse_log_xml(fx.revision_log_xml(spark, sf)))


@query("revision_range", W(ofx.REVISIONS) + """
SELECT revision::BIGINT AS revision, files_changed::BIGINT AS files_changed FROM revisions
WHERE revision BETWEEN 100 AND 149""")
def q_revision_range(spark, sf):
    r = L.revisions_in_range(fx.revisions(spark, sf), 100, 5000, limit=50)
    return r.select("revision", F.col("files_changed").cast("bigint").alias("files_changed"))


@query("assign_batches", W(ofx.REVISIONS) + """
SELECT (revision - 1) // 50 + 1 AS batch_number, min(revision)::BIGINT AS first_revision,
       max(revision)::BIGINT AS last_revision, count(*)::BIGINT AS n_revisions
FROM revisions GROUP BY 1""")
def q_assign_batches(spark, sf):
    b = L.batch_bounds(L.assign_batches(fx.revisions(spark, sf), start=1, size=50))
    return b.select(F.col("batch_number").cast("bigint").alias("batch_number"), "first_revision",
                    "last_revision", "n_revisions")


@query("commit_messages", W(ofx.REVISIONS) + """
SELECT revision::BIGINT AS revision, coalesce(nullif(author, ''), 'SVN Migration Bot') AS author,
       coalesce(nullif(trim(message), ''), 'Empty commit') || chr(10) || chr(10) || '[SVN r' || revision || ']' ||
       CASE WHEN files_changed <> 0 THEN ' | ' || files_changed || ' files changed' ELSE '' END AS message
FROM revisions""")
def q_commit_messages(spark, sf):
    return L.commit_rows(fx.revisions(spark, sf))


# ---------------------------------------------------------------------------
# listings
# ---------------------------------------------------------------------------

@query("pending_revisions", W(ofx.LEDGER) + """
SELECT svn_revision::BIGINT AS svn_revision, status FROM ledger WHERE status IN ('pending', 'in_progress')
ORDER BY svn_revision LIMIT 100""")
def q_pending_revisions(spark, sf):
    return L.pending_revisions(fx.ledger(spark, sf), limit=100).select("svn_revision", "status")


@query("open_revisions", W(ofx.LEDGER) + """
SELECT svn_revision::BIGINT AS svn_revision, status FROM ledger WHERE status <> 'completed'""")
def q_open_revisions(spark, sf):
    return L.open_revisions(fx.ledger(spark, sf)).select("svn_revision", "status")


@query("failed_revisions", W(ofx.LEDGER) + """
SELECT svn_revision::BIGINT AS svn_revision, error_message, retry_count::BIGINT AS retry_count
FROM ledger WHERE status = 'failed'""")
def q_failed_revisions(spark, sf):
    return L.failed_revisions(fx.ledger(spark, sf)).select(
        "svn_revision", "error_message", F.col("retry_count").cast("bigint").alias("retry_count"))


@query("batch_revisions", W(ofx.LEDGER) + """
SELECT svn_revision::BIGINT AS svn_revision, status, svn_author FROM ledger WHERE batch_number = 7""")
def q_batch_revisions(spark, sf):
    return L.batch_revisions(fx.ledger(spark, sf), 7).select("svn_revision", "status", "svn_author")


@query("ledger_head", W(ofx.LEDGER) + """
SELECT svn_revision::BIGINT AS svn_revision, status, git_commit_sha FROM ledger ORDER BY svn_revision LIMIT 10""")
def q_ledger_head(spark, sf):
    return L.ledger_head(fx.ledger(spark, sf), 10)


# ---------------------------------------------------------------------------
# applying changes
# ---------------------------------------------------------------------------

@query("ledger_upsert", W(ofx.LEDGER, ofx.CHECKPOINT_WRITES) + """,
upserted AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY svn_revision ORDER BY ts DESC, seq DESC) AS rn FROM (
      SELECT svn_revision, git_commit_sha, svn_author, svn_message, batch_number, updated_at, status,
             error_message, retry_count, updated_at AS ts, -1 AS seq FROM ledger
      UNION ALL
      SELECT svn_revision, NULL, svn_author, svn_message, batch_number, ts, 'pending', NULL, 0, ts, seq
      FROM checkpoint_writes))
  WHERE rn = 1)
""" + LEDGER_VIEW_SQL.format(src="upserted"))
def q_ledger_upsert(spark, sf):
    return ledger_view(L.ledger_upsert(fx.ledger(spark, sf), fx.checkpoint_writes(spark, sf)))


@query("ledger_apply", W(ofx.LEDGER, ofx.TRANSITIONS) + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY svn_revision ORDER BY ts DESC, seq DESC) AS rn_all,
         row_number() OVER (PARTITION BY svn_revision, status ORDER BY ts DESC, seq DESC) AS rn_status
  FROM transitions),
applied AS (
  SELECT l.svn_revision, coalesce(c.git_commit_sha, l.git_commit_sha) AS git_commit_sha, l.svn_author,
         l.svn_message, l.batch_number, coalesce(t.ts, l.updated_at) AS updated_at,
         coalesce(t.status, l.status) AS status, coalesce(f.error_message, l.error_message) AS error_message,
         CASE WHEN c.svn_revision IS NOT NULL THEN 0 ELSE l.retry_count END AS retry_count
  FROM ledger l
  LEFT JOIN (SELECT * FROM ranked WHERE rn_all = 1) t ON l.svn_revision = t.svn_revision
  LEFT JOIN (SELECT * FROM ranked WHERE rn_status = 1 AND status = 'completed') c
    ON l.svn_revision = c.svn_revision
  LEFT JOIN (SELECT * FROM ranked WHERE rn_status = 1 AND status = 'failed') f
    ON l.svn_revision = f.svn_revision)
""" + LEDGER_VIEW_SQL.format(src="applied"))
def q_ledger_apply(spark, sf):
    return ledger_view(L.apply_status(fx.ledger(spark, sf), fx.status_transitions(spark, sf)))


@query("retry_counts", W(ofx.LEDGER) + """
SELECT l.svn_revision::BIGINT AS svn_revision,
       (l.retry_count + coalesce(e.n, 0))::BIGINT AS retry_count,
       strftime(coalesce(e.ts, l.updated_at), '%Y-%m-%d %H:%M:%S.%f') AS updated_at
FROM ledger l LEFT JOIN (SELECT user_id + 1 AS svn_revision, count(*) AS n, max(ts) AS ts FROM events
                         WHERE event_type = 'error' GROUP BY 1) e ON l.svn_revision = e.svn_revision""")
def q_retry_counts(spark, sf):
    r = L.retry_counts(fx.ledger(spark, sf), fx.retry_events(spark, sf))
    return r.select("svn_revision", F.col("retry_count").cast("bigint").alias("retry_count"),
                    wall_clock("updated_at"))


@query("resume_gaps", W(ofx.LEDGER) + """
SELECT r.revision::BIGINT AS svn_revision FROM revisions r
WHERE r.revision <= (SELECT max(revision) FROM revisions)
  AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.svn_revision = r.revision AND l.status = 'completed')""")
def q_resume_gaps(spark, sf):
    led = fx.ledger(spark, sf)
    total = L.head_revision(fx.revisions(spark, sf)).first()["head_revision"]
    return L.resume_gaps(spark, led, int(total))


@query("errors_joined", W(ofx.LEDGER, ofx.ERRORS) + """
SELECT e.error_id, e.svn_revision::BIGINT AS svn_revision, e.error_type, l.svn_author,
       l.batch_number::BIGINT AS ledger_batch, l.status
FROM error_log e LEFT JOIN ledger l ON e.svn_revision = l.svn_revision""")
def q_errors_joined(spark, sf):
    j = L.errors_with_revision(fx.error_log(spark, sf), fx.ledger(spark, sf))
    return j.select("error_id", "svn_revision", "error_type", "svn_author",
                    F.col("ledger_batch").cast("bigint").alias("ledger_batch"), "status")


RUN_VIEW_SQL = """SELECT run_id, last_checkpoint_revision, current_batch_number, migration_status,
       total_svn_revisions, strftime(last_update_time, '%Y-%m-%d %H:%M:%S.%f') AS last_update_time FROM {src}"""


def run_view(df: DataFrame) -> DataFrame:
    return df.select("run_id", "last_checkpoint_revision", "current_batch_number", "migration_status",
                     "total_svn_revisions", wall_clock("last_update_time"))


@query("run_update", W(ofx.RUNS) + RUN_VIEW_SQL.format(src="runs_updated"))
def q_run_update(spark, sf):
    return run_view(L.update_run(fx.runs(spark, sf), fx.run_updates(spark, sf)))


@query("latest_run", W(ofx.RUNS) + RUN_VIEW_SQL.format(
    src="runs_updated ORDER BY last_update_time DESC, run_id DESC LIMIT 1"))
def q_latest_run(spark, sf):
    return run_view(L.latest_run(L.update_run(fx.runs(spark, sf), fx.run_updates(spark, sf))))


# ---------------------------------------------------------------------------
# summaries
# ---------------------------------------------------------------------------

@query("status_counts", W(ofx.LEDGER) + "SELECT status, count(*)::BIGINT AS n FROM ledger GROUP BY status")
def q_status_counts(spark, sf):
    return L.status_counts(fx.ledger(spark, sf))


# every ninth revision is skipped
SKIPPED_SQL = """,
skipping AS (SELECT * REPLACE (CASE WHEN svn_revision % 9 = 0 THEN 'skipped' ELSE status END AS status) FROM ledger)"""


@query("migration_summary", W(ofx.LEDGER, ofx.RUNS) + SKIPPED_SQL + """,
newest AS (SELECT run_id, migration_status FROM runs_updated ORDER BY last_update_time DESC, run_id DESC LIMIT 1)
SELECT count(*)::BIGINT AS total_revisions,
       count(*) FILTER (WHERE status = 'completed')::BIGINT AS completed,
       count(*) FILTER (WHERE status = 'failed')::BIGINT AS failed,
       count(*) FILTER (WHERE status = 'pending')::BIGINT AS pending,
       count(*) FILTER (WHERE status = 'in_progress')::BIGINT AS in_progress,
       count(*) FILTER (WHERE status = 'skipped')::BIGINT AS skipped,
       (SELECT string_agg(status || ':' || n, ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM skipping GROUP BY status)) AS status_counts,
       round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE status = 'completed') / count(*) * 100.0
                  ELSE 0.0 END, 6) AS progress_percent,
       (SELECT run_id FROM newest)::BIGINT AS run_id, (SELECT migration_status FROM newest) AS run_status
FROM skipping""")
def q_migration_summary(spark, sf):
    """A10 over the ledger, some of its revisions skipped, with the newest run."""
    ledger = fx.ledger(spark, sf).withColumn("status", F.when(F.col("svn_revision") % 9 == 0, L.SKIPPED).otherwise(F.col("status")))
    s = L.migration_summary(ledger, L.update_run(fx.runs(spark, sf), fx.run_updates(spark, sf)))
    counts = F.array_join(F.transform(F.map_entries("status_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return s.select("total_revisions", "completed", "failed", "pending", "in_progress", "skipped", counts.alias("status_counts"),
                    "progress_percent", F.col("metadata.run_id").alias("run_id"), F.col("metadata.migration_status").alias("run_status"))


@query("last_completed", W(ofx.LEDGER) + """
SELECT coalesce(max(svn_revision) FILTER (WHERE status = 'completed'), 0)::BIGINT AS last_completed_revision
FROM ledger""")
def q_last_completed(spark, sf):
    return L.last_completed(fx.ledger(spark, sf))


@query("errors_by_mode", W(ofx.ERRORS) + """
SELECT CASE WHEN error_type = 'TimeoutError' THEN 'timeout'
            WHEN error_type IN ('SVNConnectionError', 'GitPushError') THEN 'transient'
            ELSE 'permanent' END AS failure_mode,
       resolved, count(*)::BIGINT AS n_errors
FROM error_log GROUP BY ALL""")
def q_errors_by_mode(spark, sf):
    return L.errors_by_mode(fx.error_log(spark, sf))


@query("verify_counts", W(ofx.LEDGER) + """
SELECT batch_number::BIGINT AS batch_number, count(*)::BIGINT AS n_revisions,
       count(*) FILTER (WHERE status = 'completed')::BIGINT AS n_completed,
       count(*) = count(*) FILTER (WHERE status = 'completed') AS complete
FROM ledger GROUP BY batch_number""")
def q_verify_counts(spark, sf):
    v = L.verify_counts(fx.ledger(spark, sf))
    return v.select(F.col("batch_number").cast("bigint").alias("batch_number"), "n_revisions",
                    "n_completed", "complete")
