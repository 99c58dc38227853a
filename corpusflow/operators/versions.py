"""Versioned training data sets.

Pairs are stored partitioned by (project, version); every build appends a
new version partition (decision 8), so reads of one version are partition
pruned and nothing is overwritten while it may be read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pairs import PAIR_COLUMNS, content_key


def write_dataset_version(pairs: DataFrame, path: str, project: str, version: int) -> None:
    """Write the pairs as partition (project, version). A repeated write replaces that one
    partition, so a retry leaves no row twice; other versions are not touched."""
    (pairs.withColumn("version", F.lit(version).cast("int")).withColumn("project", F.lit(project))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project", "version").parquet(path))


def write_dataset_versions(pairs: DataFrame, path: str) -> None:
    """All projects and versions of ``pairs`` (its ``project`` and ``version`` columns) in one
    write. Each partition that gets rows is replaced, so a retry leaves no row twice."""
    (pairs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("project", "version").parquet(path))


def next_version(spark: SparkSession, path: str, project: str) -> int:
    """Version number for the next build of ``project`` (1 when none). Only a missing data set
    counts as none; any other failure to read it is raised."""
    try:
        written = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return 1
        raise
    return int(written.where(F.col("project") == project).agg(F.max("version")).first()[0] or 0) + 1


def current_version(pairs: DataFrame) -> DataFrame:
    """Max version per project."""
    return pairs.groupBy("project").agg(F.max("version").alias("current_version"))


def read_dataset_version(pairs: DataFrame, project: str | None = None,
                         version: int | None = None) -> DataFrame:
    """Pairs of one version; without a version, each project's current
    one (a semi-join on (project, max version), which Spark turns into
    dynamic partition pruning on a partitioned table)."""
    if project is not None:
        pairs = pairs.where(F.col("project") == project)
    if version is not None:
        return pairs.where(F.col("version") == version)
    cur = current_version(pairs).withColumnRenamed("current_version", "version")
    return pairs.join(cur, ["project", "version"], "left_semi")


def pairs_since(pairs: DataFrame, since: int, project: str | None = None) -> DataFrame:
    """Pairs of versions in (since, current]."""
    if project is not None:
        pairs = pairs.where(F.col("project") == project)
    return pairs.where(F.col("version") > since)


def version_delta(pairs: DataFrame) -> DataFrame:
    """Pairs of each version whose (input, output) is absent from the
    previous version of the same project (train on the delta only)."""
    keyed = pairs.withColumn("_k", content_key(pairs))
    prev = keyed.select("project", (F.col("version") + 1).alias("version"), "_k").distinct()
    return keyed.join(prev, ["project", "version", "_k"], "left_anti").drop("_k")


def version_history(pairs: DataFrame) -> DataFrame:
    """Per project and version (numeric order): pairs, pairs by type
    (as a sorted map), and growth over the previous version."""
    by_type = pairs.groupBy("project", "version", "pair_type").agg(F.count(F.lit(1)).alias("n"))
    per_v = by_type.groupBy("project", "version").agg(
        F.sum("n").alias("total_pairs"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("pair_type", "n")))).alias("pairs_by_type"))
    w = Window.partitionBy("project").orderBy("version")
    return per_v.withColumn("growth", F.col("total_pairs") - F.coalesce(F.lag("total_pairs").over(w), F.lit(0)))


def _model_version(tag: str = "tag"):
    """The number of a model tag ``v12``; other tags have none."""
    return F.regexp_extract(tag, r"^v([0-9]+)$", 1).try_cast("int")


def latest_model_version(runs: DataFrame) -> DataFrame:
    """Per project the highest model version of ``runs`` (project, tag, ...), 0 if it has none."""
    return runs.groupBy("project").agg(F.coalesce(F.max(_model_version()), F.lit(0)).alias("latest_version"))


def model_history(runs: DataFrame) -> DataFrame:
    """Per project its models by number (v10 after v9): project, version, ``metrics`` (the last value of each
    metric, a map in the order of names), created_at and ``place`` (1, 2, ...). ``runs`` has a row
    per metric: project, tag, metric, value, created_at, seq."""
    numbered = runs.withColumn("version", _model_version()).where(F.col("version").isNotNull())
    last = numbered.groupBy("project", "version", "metric").agg(
        F.max_by("value", F.struct("created_at", "seq")).alias("value"), F.max("created_at").alias("created_at"))
    named = F.struct("metric", "value")
    models = last.groupBy("project", "version").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("metric").isNotNull(), named)))).alias("metrics"),  # a model's few metrics
        F.max("created_at").alias("created_at"))
    return models.withColumn("place", F.row_number().over(Window.partitionBy("project").orderBy("version")))


__all__ = ["latest_model_version", "model_history", "PAIR_COLUMNS", "write_dataset_version", "write_dataset_versions", "next_version", "current_version",
           "read_dataset_version", "pairs_since", "version_delta", "version_history"]
