"""Composed jobs (E5, E8): several operators as one lazy plan.

E6 (``retrieval.answer_questions``) and E7 (``metadata.analyze_structure``)
live with their operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, pairs, tokens, versions


def build_dataset(files: DataFrame, project: str, version: int, path: str | None = None,
                  created_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """E5: files -> chunks (U3) -> pairs (U4) -> optional versioned write
    -> pair counts by type (A3). Returns (pairs, stats)."""
    ch = chunking.extract_chunks(files, created_at)
    ps = pairs.generate_pairs(ch, created_at, version=version).withColumn("project", F.lit(project))
    if path is not None:
        versions.write_dataset_version(ps.drop("project", "version"), path, project, version)
    stats = pairs.pairs_by_type(ps, ["project", "version"])
    return ps, stats


def dataset_report(pairs_df: DataFrame) -> DataFrame:
    """One row per (project, version): total pairs and counts by type."""
    by_type = pairs.pairs_by_type(pairs_df, ["project", "version"])
    return by_type.groupBy("project", "version").agg(
        F.sum("n_pairs").alias("total_pairs"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pair_type", "n_pairs"))),
                                 lambda e: F.concat(e["pair_type"], F.lit(":"), e["n_pairs"].cast("string"))),
                     ",").alias("pairs_by_type"))


def corpus_report(files: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Index, dataset and token statistics of a corpus in one row, from
    one pass: every file yields exactly one ``explain_file`` pair and every
    chunk exactly one explain_* pair, so files, chunks, pairs and token
    counts are a single aggregate over the pairs.

    Token counts come from the token rule directly (one id per token, so the
    count equals the sum of K3's window counts without building ids); nothing is cut.
    """
    ch = chunking.extract_chunks(files, created_at)
    ps = pairs.generate_pairs(ch, created_at)
    t = F.size(tokens.tokens(tokens.combine(F.col("input_text"), F.col("output_text"))))
    kind = F.col("pair_type")
    return ps.select(kind, t.alias("token_count")).agg(
        F.count_if(kind == "explain_file").alias("total_files"),
        F.count_if(kind.isin("explain_file", "explain_class", "explain_method")).alias("total_chunks"),
        F.count(F.lit(1)).alias("total_pairs"),
        F.coalesce(F.sum("token_count"), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.coalesce(F.round(F.avg("token_count"), 6), F.lit(0.0)).alias("avg_tokens_per_pair"),
        F.coalesce(F.max("token_count"), F.lit(0)).cast("bigint").alias("max_tokens"),
        F.coalesce(F.min("token_count"), F.lit(0)).cast("bigint").alias("min_tokens"))
