"""History-ledger analytics.

The ledger is a table with one row per revision. Updates arrive as tables of
events and are applied with aggregations keyed by revision (``max_by`` over
a (ts, seq) ordering), so a revision that receives a third of all updates is
combined map-side before the shuffle instead of sorted whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import describe
from ..session import materialize

# Fixed values of the reference: status names, batch size, metadata whitelist.
PENDING, IN_PROGRESS, COMPLETED, FAILED, SKIPPED = "pending", "in_progress", "completed", "failed", "skipped"
STATUSES = [PENDING, IN_PROGRESS, COMPLETED, FAILED, SKIPPED]
DEFAULT_BATCH_SIZE = 50
RUN_FIELDS = ["last_checkpoint_revision", "current_batch_number", "migration_status", "total_svn_revisions"]
RUN_FIELD_TYPES = {"last_checkpoint_revision": "bigint", "current_batch_number": "bigint",
                   "migration_status": "string", "total_svn_revisions": "bigint"}
UNKNOWN_AUTHOR = "unknown"

LEDGER_COLUMNS = ["svn_revision", "git_commit_sha", "svn_author", "svn_timestamp", "svn_message",
                  "batch_number", "created_at", "updated_at", "status", "error_message", "retry_count"]

LOG_ENTRY_SCHEMA = T.StructType([
    T.StructField("_revision", T.LongType()),
    T.StructField("author", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("msg", T.StringType()),
    T.StructField("paths", T.StructType([T.StructField("path", T.ArrayType(T.StringType()))])),
])


def _order(ts: str = "ts", seq: str = "seq") -> Column:
    return F.struct(F.col(ts), F.col(seq))


# ---------------------------------------------------------------------------
# The revision log
# ---------------------------------------------------------------------------

def normalize_log_entries(entries: DataFrame) -> DataFrame:
    """Log entries (``LOG_ENTRY_SCHEMA``) to revision rows, oldest first."""
    return entries.select(
        F.col("_revision").alias("revision"),
        F.coalesce(F.col("author"), F.lit(UNKNOWN_AUTHOR)).alias("author"),
        F.coalesce(F.col("date"), F.lit("")).alias("timestamp"),
        F.coalesce(F.col("msg"), F.lit("")).alias("message"),
        F.coalesce(F.size(F.col("paths.path")), F.lit(0)).cast("int").alias("files_changed"),
    )


def read_vcs_log(spark: SparkSession, path: str) -> DataFrame:
    """``svn log --xml --verbose`` files to revision rows."""
    entries = (spark.read.format("xml").option("rowTag", "logentry")
               .schema(LOG_ENTRY_SCHEMA).load(path))
    return chronological(normalize_log_entries(entries))


def parse_log_xml(xml_rows: DataFrame, column: str = "xml") -> DataFrame:
    """S8 on a column of ``<logentry>`` strings (same rules as the file reader)."""
    parsed = xml_rows.select(F.from_xml(F.col(column), LOG_ENTRY_SCHEMA).alias("e")).select("e.*")
    return normalize_log_entries(parsed)


def chronological(revs: DataFrame) -> DataFrame:
    """Oldest first (the reference comment's intent; decision 16)."""
    return revs.orderBy("revision")


def head_revision(revs: DataFrame) -> DataFrame:
    """Highest revision = total to migrate (0 for an empty log)."""
    return revs.agg(F.coalesce(F.max("revision"), F.lit(0)).cast("bigint").alias("head_revision"))


def revisions_in_range(revs: DataFrame, start: int, end: int, limit: int | None = None) -> DataFrame:
    """F8: inclusive range; a limit clamps the end."""
    stop = end if not limit else min(start + limit - 1, end)
    return revs.where(F.col("revision").between(start, stop))


# ---------------------------------------------------------------------------
# W5 batches, X20/X21 commit rows
# ---------------------------------------------------------------------------

def assign_batches(revs: DataFrame, start: int = 1, size: int = DEFAULT_BATCH_SIZE,
                   column: str = "revision") -> DataFrame:
    """Batch number = floor((rev - start) / size) + 1 for revisions >= start."""
    return revs.where(F.col(column) >= start).withColumn(
        "batch_number", (F.floor((F.col(column) - start) / size) + 1).cast("int"))


def batch_bounds(batched: DataFrame, column: str = "revision") -> DataFrame:
    """First and last revision and size of each batch."""
    return batched.groupBy("batch_number").agg(
        F.min(column).alias("first_revision"), F.max(column).alias("last_revision"),
        F.count(F.lit(1)).alias("n_revisions"))


def commit_rows(revs: DataFrame, default_author: str = describe.DEFAULT_AUTHOR) -> DataFrame:
    """X20 + X21: the commit each revision becomes."""
    return revs.select(
        "revision",
        describe.author_or_default(F.col("author"), default_author).alias("author"),
        describe.commit_message(F.col("message"), F.col("revision"), F.col("files_changed")).alias("message"))


# ---------------------------------------------------------------------------
# listings
# ---------------------------------------------------------------------------

def pending_revisions(ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """pending or in-progress rows by revision (optional limit: top-k)."""
    out = ledger.where(F.col("status").isin(PENDING, IN_PROGRESS)).orderBy("svn_revision")
    return out.limit(limit) if limit else out


def open_revisions(ledger: DataFrame) -> DataFrame:
    """everything not completed."""
    return ledger.where(F.col("status") != COMPLETED).orderBy("svn_revision")


def failed_revisions(ledger: DataFrame) -> DataFrame:
    """failed rows."""
    return ledger.where(F.col("status") == FAILED).orderBy("svn_revision")


def batch_revisions(ledger: DataFrame, batch_number: int) -> DataFrame:
    """F9."""
    return ledger.where(F.col("batch_number") == batch_number).orderBy("svn_revision")


def ledger_head(ledger: DataFrame, n: int = 10) -> DataFrame:
    """first rows by revision."""
    return ledger.select("svn_revision", "status", "git_commit_sha").orderBy("svn_revision").limit(n)


# ---------------------------------------------------------------------------
# Applying changes
# ---------------------------------------------------------------------------

def ledger_upsert(ledger: DataFrame, writes: DataFrame) -> DataFrame:
    """INSERT OR REPLACE by revision, last write wins.

    ``writes``: svn_revision, batch_number, svn_author, svn_timestamp,
    svn_message, ts, seq. A replaced row restarts as pending and loses its
    sha, error and retry count.
    """
    row = F.struct(
        F.lit(None).cast("string").alias("git_commit_sha"), "svn_author", "svn_timestamp", "svn_message", "batch_number",
        F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.lit(PENDING).alias("status"),
        F.lit(None).cast("string").alias("error_message"), F.lit(0).alias("retry_count"))
    # one row per written revision; written, so that its size is known to the planner: while it is
    # small it is broadcast, and the ledger is neither shuffled nor sorted
    last = materialize(writes.withColumn("seq", F.col("seq").cast("bigint")).groupBy("svn_revision")
                       .agg(F.max_by(row, _order()).alias("_new"), F.max(_order()).alias("_at")), "ledger-writes")
    wins = F.coalesce(F.col("_at") > F.struct(F.col("updated_at").alias("ts"), F.lit(-1).cast("bigint").alias("seq")), F.lit(False))
    fields = [c for c in LEDGER_COLUMNS if c != "svn_revision"]
    kept = ledger.select(*LEDGER_COLUMNS).join(last, "svn_revision", "left").select(
        "svn_revision", *[F.when(wins, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in fields])
    met = ledger.select("svn_revision").join(last.select("svn_revision"), "svn_revision", "left_semi")
    new = last.join(met, "svn_revision", "left_anti").select("svn_revision", "_new.*")
    return kept.unionByName(new.select(*kept.columns))


def apply_status(ledger: DataFrame, transitions: DataFrame) -> DataFrame:
    """Apply status transitions in (ts, seq) order.

    Completion sets the sha and resets retries; failure sets the message;
    in-progress changes the status only. Transitions for unknown revisions
    are no-ops (UPDATE ... WHERE).
    """
    o = _order()
    done = F.col("status") == COMPLETED
    fail = F.col("status") == FAILED
    per_rev = materialize(transitions.groupBy("svn_revision").agg(
        F.max_by("status", o).alias("t_status"),
        F.max("ts").alias("t_ts"),
        F.max_by("git_commit_sha", F.when(done, o)).alias("t_sha"),
        F.max(done).alias("t_done"),
        F.max_by("error_message", F.when(fail, o)).alias("t_error"),
    ), "ledger-transitions")  # its size is known: broadcast while small
    j = ledger.join(per_rev, "svn_revision", "left")
    return j.select(
        "svn_revision",
        F.when(F.col("t_done"), F.col("t_sha")).otherwise(F.col("git_commit_sha")).alias("git_commit_sha"),
        "svn_author", "svn_timestamp", "svn_message", "batch_number", "created_at",
        F.coalesce(F.col("t_ts"), F.col("updated_at")).alias("updated_at"),
        F.coalesce(F.col("t_status"), F.col("status")).alias("status"),
        F.coalesce(F.col("t_error"), F.col("error_message")).alias("error_message"),
        F.when(F.col("t_done"), F.lit(0)).otherwise(F.col("retry_count")).alias("retry_count"),
    )


def retry_counts(ledger: DataFrame, retries: DataFrame) -> DataFrame:
    """Add one per retry of a revision; each retry stamps the update time."""
    n = retries.groupBy("svn_revision").agg(F.count(F.lit(1)).alias("n_retries"), F.max("ts").alias("_ts"))
    return ledger.join(n, "svn_revision", "left").withColumns({
        "retry_count": (F.col("retry_count") + F.coalesce(F.col("n_retries"), F.lit(0))).cast("int"),
        "updated_at": F.coalesce(F.col("_ts"), F.col("updated_at")),
    }).drop("n_retries", "_ts")


def resume_gaps(spark: SparkSession, ledger: DataFrame, total: int) -> DataFrame:
    """Every revision in 1..total that is not completed (failures and
    holes included, unlike resuming from max(completed)+1)."""
    done = ledger.where(F.col("status") == COMPLETED).select(F.col("svn_revision").alias("id"))
    return spark.range(1, total + 1).join(done, "id", "left_anti").withColumnRenamed("id", "svn_revision")


def errors_with_revision(errors: DataFrame, ledger: DataFrame) -> DataFrame:
    """Error rows with author, batch and status of their revision."""
    led = ledger.select("svn_revision", "svn_author", F.col("batch_number").alias("ledger_batch"), "status")
    return errors.join(led, "svn_revision", "left")


def update_run(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """Set whitelisted fields, latest value per field, and the update time.

    ``updates`` is long form: run_id, field, value (string), ts, seq.
    Fields outside the whitelist are ignored and do not touch the time.
    """
    allowed = updates.where(F.col("field").isin(RUN_FIELDS))
    o = _order()
    aggs = [F.max_by("value", F.when(F.col("field") == f, o)).alias(f"u_{f}") for f in RUN_FIELDS]
    per_run = allowed.groupBy("run_id").agg(F.max("ts").alias("u_ts"), *aggs)
    j = runs.join(per_run, "run_id", "left")
    cols = []
    for c in runs.columns:
        if c in RUN_FIELDS:
            cols.append(F.coalesce(F.col(f"u_{c}").cast(RUN_FIELD_TYPES[c]), F.col(c)).alias(c))
        elif c == "last_update_time":
            cols.append(F.coalesce(F.col("u_ts"), F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def latest_run(runs: DataFrame, ts: str = "last_update_time") -> DataFrame:
    """Newest metadata row (ties: highest run id)."""
    return runs.orderBy(F.col(ts).desc(), F.col("run_id").desc()).limit(1)


# ---------------------------------------------------------------------------
# summaries
# ---------------------------------------------------------------------------

def status_counts(ledger: DataFrame) -> DataFrame:
    """A9."""
    return ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def migration_summary(ledger: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """A10: totals per status and percent complete (0 when empty), ``status_counts`` (every status
    that occurs, a map in the order of names) and, with ``runs``, ``metadata``: the newest run as a struct, null if
    there is none."""
    per = ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n"))  # a handful of statuses
    of = lambda status: F.coalesce(F.sum(F.when(F.col("status") == status, F.col("n"))), F.lit(0)).cast("bigint")
    agg = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_revisions"),
        of(COMPLETED).alias("completed"), of(FAILED).alias("failed"), of(PENDING).alias("pending"),
        of(IN_PROGRESS).alias("in_progress"), of(SKIPPED).alias("skipped"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("status", F.lit("")).alias("status"), "n")))).alias("status_counts"))
    pct = F.when(F.col("total_revisions") > 0,
                 F.col("completed") / F.col("total_revisions") * 100.0).otherwise(F.lit(0.0))
    out = agg.withColumn("progress_percent", F.round(pct, 6))
    if runs is None:
        return out
    newest = latest_run(runs).select(F.struct(*runs.columns).alias("metadata"))
    return out.join(newest, F.lit(True), "left")  # one row beside at most one


def last_completed(ledger: DataFrame) -> DataFrame:
    """Highest completed revision, 0 when none."""
    return ledger.agg(F.coalesce(F.max(F.when(F.col("status") == COMPLETED, F.col("svn_revision"))),
                                 F.lit(0)).cast("bigint").alias("last_completed_revision"))


def errors_by_mode(errors: DataFrame) -> DataFrame:
    """Errors classified into failure modes, counted with the resolved flag."""
    return (errors.withColumn("failure_mode", describe.classify_error(F.col("error_type")))
            .groupBy("failure_mode", "resolved").agg(F.count(F.lit(1)).alias("n_errors")))


def verify_counts(ledger: DataFrame) -> DataFrame:
    """Completed vs total revisions per batch, with a mismatch flag."""
    return ledger.groupBy("batch_number").agg(
        F.count(F.lit(1)).alias("n_revisions"),
        F.count_if(F.col("status") == COMPLETED).alias("n_completed"),
    ).withColumn("complete", F.col("n_completed") == F.col("n_revisions"))
