"""Project registry and roll-ups.

Projects are rows of a ``projects`` table (name, root, type, file types,
description, model, training config); datasets are the versioned pair table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROJECT_SCHEMA = T.StructType([
    T.StructField("project_name", T.StringType()),
    T.StructField("project_root", T.StringType()),
    T.StructField("project_type", T.StringType()),
    T.StructField("file_types", T.ArrayType(T.StringType())),
    T.StructField("description", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("training_config", T.MapType(T.StringType(), T.StringType())),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("last_updated", T.TimestampType()),
])


def register_projects(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Add each new project unless its name is already registered."""
    fresh = new.join(existing.select("project_name"), "project_name", "left_anti")
    return existing.unionByName(fresh)


def project_info(projects: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each project's config with its dataset versions in numeric order
    (``{project}_v{n}`` names; decision 9)."""
    versions = pairs.select(F.col("project").alias("project_name"), "version").distinct()
    per = versions.groupBy("project_name").agg(F.sort_array(F.collect_list("version")).alias("_v"))
    named = per.select("project_name", F.transform(
        "_v", lambda v: F.concat(F.col("project_name"), F.lit("_v"), v.cast("string"))).alias("datasets"))
    return projects.join(named, "project_name", "left").withColumn(
        "datasets", F.coalesce(F.col("datasets"), F.array().cast("array<string>")))


def project_rollup(projects: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks per project and an indexed flag (projects without chunks
    show 0, not indexed)."""
    n = chunks.groupBy(F.col("project").alias("project_name")).agg(F.count(F.lit(1)).alias("total_chunks"))
    j = projects.select("project_name").join(n, "project_name", "left")
    return j.select("project_name", F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"),
                    (F.coalesce("total_chunks", F.lit(0)) > 0).alias("indexed"))
