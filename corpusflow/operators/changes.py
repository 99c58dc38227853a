"""Change detection between snapshots and incremental index maintenance
(J1-J3, F3, A1).

The index state is a table (rel_path, file_sha, last_indexed, chunks_count);
a snapshot of files is compared with it by one full outer equi-join on the
path. Unchanged files are skipped before any extraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEW, MODIFIED, UNCHANGED, DELETED = "new", "modified", "unchanged", "deleted"


def diff_snapshots(current: DataFrame, state: DataFrame, force: bool = False,
                   carry: list[str] | None = None) -> DataFrame:
    """Classify each path as new / modified / unchanged / deleted.

    ``force`` treats every current file as new (a full re-index). ``carry``
    keeps columns of the current files (e.g. path, ext, content) so that the
    files to re-index come from the same join (``changed_files``).
    """
    carry = list(carry or [])
    cur = current.select(F.col("rel_path"), F.col("file_sha").alias("cur_sha"), *carry)
    old = state.select(F.col("rel_path"), F.col("file_sha").alias("old_sha"))
    j = cur.join(old, "rel_path", "full_outer")
    change = (F.when(F.col("cur_sha").isNull(), F.lit(DELETED))
              .when(F.lit(force) | F.col("old_sha").isNull(), F.lit(NEW))
              .when(F.col("cur_sha") != F.col("old_sha"), F.lit(MODIFIED))
              .otherwise(F.lit(UNCHANGED)))
    return j.select("rel_path", "cur_sha", "old_sha", change.alias("change"), *carry)


def changed_files(diff: DataFrame) -> DataFrame:
    """F3 from a diff that carried path, ext and content: the new or modified files."""
    return diff.where(F.col("change").isin(NEW, MODIFIED)).select(
        "path", "rel_path", "ext", "content", F.col("cur_sha").alias("file_sha"))


def deleted_files(state: DataFrame, current: DataFrame) -> DataFrame:
    """Indexed paths that no longer exist."""
    return state.select("rel_path").join(current.select("rel_path"), "rel_path", "left_anti")


def changed_only(current: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """the current files that are new or modified (all of them when forced)."""
    if force:
        return current
    old = state.select("rel_path", F.col("file_sha").alias("old_sha"))
    j = current.join(old, "rel_path", "left")
    return j.where(F.col("old_sha").isNull() | (F.col("old_sha") != F.col("file_sha"))).drop("old_sha")


def upsert_index(old_chunks: DataFrame, new_chunks: DataFrame, diff: DataFrame) -> DataFrame:
    """Merged chunk index. Chunks of unchanged files are kept, those of
    changed files replaced, those of deleted files removed (decision 7)."""
    gone = diff.where(F.col("change") != UNCHANGED).select(F.col("rel_path").alias("file_path"))
    kept = old_chunks.join(gone, "file_path", "left_anti")
    return kept.unionByName(new_chunks)


def next_state(state: DataFrame, diff: DataFrame, new_chunks: DataFrame,
               indexed_at: Column | None = None) -> DataFrame:
    """New index state: processed files get their sha, time and chunk count;
    unchanged rows stay; deleted rows go."""
    counts = new_chunks.groupBy(F.col("file_path").alias("rel_path")).agg(
        F.count(F.lit(1)).cast("int").alias("chunks_count"))
    processed = (diff.where(F.col("change").isin(NEW, MODIFIED))
                 .select("rel_path", F.col("cur_sha").alias("file_sha"))
                 .join(counts, "rel_path", "left")
                 .select("rel_path", "file_sha",
                         (indexed_at if indexed_at is not None else F.current_timestamp()).alias("last_indexed"),
                         F.coalesce(F.col("chunks_count"), F.lit(0)).alias("chunks_count")))
    unchanged = state.join(diff.where(F.col("change") == UNCHANGED).select("rel_path"), "rel_path", "left_semi")
    return unchanged.select("rel_path", "file_sha", "last_indexed", "chunks_count").unionByName(processed)


def index_stats(diff: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """A1: one row of file and chunk counts for an indexing run."""
    c = F.col("change")
    files = diff.agg(
        F.count_if(c != DELETED).alias("total_files"),
        F.count_if(c.isin(NEW, MODIFIED)).alias("processed_files"),
        F.count_if(c == NEW).alias("new_files"),
        F.count_if(c == MODIFIED).alias("modified_files"),
        F.count_if(c == DELETED).alias("deleted_files"),
    )
    chunks = new_chunks.agg(F.count(F.lit(1)).alias("total_chunks"))
    return files.crossJoin(chunks)  # two one-row aggregates
