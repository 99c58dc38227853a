"""Versions of training pairs stored by content.

A pair's texts are stored once, under a hash of them, however many versions hold the pair. A
version stores only what changed since the version before: which pairs came, went, or come in
another number of copies. From these changes every pair's intervals (first and last version) follow, and so do the
members of any version; reads of differences, ranges and history touch no text.

    <path>/contents/version=V/    ck, input_text, output_text: texts first seen in V
    <path>/changes/version=V/     project, pair_id, pair_type, ck, copies (0: gone since)
    <path>/builds/version=V/      project: built as V; written last

A version that is written again (a retry) replaces its own folders; versions are written in rising order.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .pairs import content_key

MEMBER = ["project", "pair_id", "pair_type", "ck"]
_DDL = {"contents": "ck string, input_text string, output_text string, version int",
        "changes": "project string, pair_id string, pair_type string, ck string, copies long, version int",
        "builds": "project string, version int"}


class VersionStore:
    """Versions of any number of projects under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, kind: str, upto: int | None = None) -> DataFrame:
        try:
            rows = self.spark.read.schema(_DDL[kind]).parquet(f"{self.path}/{kind}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], _DDL[kind])
        return rows if upto is None else rows.where(F.col("version") <= upto)

    def members(self, upto: int) -> DataFrame:
        """(project, pair_id, pair_type, ck, copies) of each project's newest build up to a version."""
        last = self._read("changes", upto).groupBy(*MEMBER).agg(F.max_by("copies", "version").alias("copies"))
        return last.where("copies > 0")

    def add(self, pairs: DataFrame, version: int) -> None:
        """``pairs`` (project, pair_id, pair_type, input_text, output_text) as ``version`` of the projects that
        it holds; other projects are not touched."""
        keyed = pairs.select("project", "pair_id", "pair_type", content_key(pairs).alias("ck"), "input_text", "output_text")
        now = materialize(keyed.groupBy(*MEMBER).agg(F.count(F.lit(1)).alias("copies")), "version-members")
        built = now.select("project").distinct()
        old = self.members(version - 1).join(built, "project", "left_semi").withColumnRenamed("copies", "was")
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in MEMBER]
        both = now.alias("n").join(old.alias("o"), same[0] & same[1] & same[2] & same[3], "full_outer")
        here = F.col("copies").isNotNull()
        changed = (both.where(~F.col("copies").eqNullSafe(F.col("was")))
                   .select(*[F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in MEMBER],
                           F.coalesce("copies", F.lit(0)).cast("long").alias("copies")))
        self._write(materialize(changed, "version-changes"), "changes", version)
        fresh = (now.select("ck").distinct().join(self._read("contents", version - 1).select("ck"), "ck", "left_anti"))
        # one row a text: rows of one key have the same texts
        texts = keyed.join(fresh, "ck", "left_semi").groupBy("ck").agg(F.first(F.struct("input_text", "output_text")).alias("t"))
        self._write(texts.select("ck", "t.*"), "contents", version)
        self._write(built, "builds", version)

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/version={version}")

    def intervals(self) -> DataFrame:
        """MEMBER, copies, first, until: the pair is in its project's builds from ``first`` to before
        ``until`` (null: still). A pair that comes back has several."""
        w = Window.partitionBy(*MEMBER).orderBy("version")
        return (self._read("changes").withColumn("until", F.lead("version").over(w)).where("copies > 0")
                .withColumnRenamed("version", "first"))

    def rows(self, since: int = 0) -> DataFrame:
        """(MEMBER, copies, version) of all builds after ``since``. No text is read."""
        builds = self._read("builds").where(F.col("version") > since).withColumnRenamed("project", "_p")
        at = (F.col("version") >= F.col("first")) & (F.col("until").isNull() | (F.col("version") < F.col("until")))
        return self.intervals().join(builds, F.col("project").eqNullSafe(F.col("_p")) & at).select(*MEMBER, "copies", "version")

    def read(self, version: int) -> DataFrame:
        """The rows of a version, with texts; repeated rows come as often as they were written."""
        mine = self.rows(version - 1).where(F.col("version") == version)
        return (mine.join(self._read("contents", version).drop("version"), "ck")
                .select("project", "pair_id", "pair_type", "input_text", "output_text", "version",
                        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).drop("_copy"))

    def delta(self) -> DataFrame:
        """(MEMBER, copies, version) whose texts the project's version before does not hold."""
        rows = self.rows()
        held = rows.select(F.col("project").alias("_p"), (F.col("version") + 1).alias("_v"), F.col("ck").alias("_k")).distinct()
        return rows.join(held, F.col("project").eqNullSafe(F.col("_p")) & (F.col("version") == F.col("_v")) & (F.col("ck") == F.col("_k")), "left_anti")

    def history(self) -> DataFrame:
        """Rows by project, version and type."""
        return self.rows().groupBy("project", "version", "pair_type").agg(F.sum("copies").alias("n_pairs"))
