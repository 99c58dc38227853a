"""A ledger stored for small writes (J9, T2): merge on read.

Rows live in ranges of ``range_size`` revisions. A range has one base (whole rows) and deltas (one
row per revision that a batch wrote); every batch writes only its own deltas and, last, a few head
rows (which generation is each touched range's base, how many rows base and deltas have). Reading
merges: the newest write of a revision wins over its base row. When the deltas of a range exceed ``share`` of its
base, the batch also writes the range's merged rows as its next base.

Everything that batch ``b`` writes lies under generation ``b + 1`` and is replaced when the batch is
replayed; a reader sees a generation once its head rows are there. What no replay can need any more is deleted by the
next batch.

    <path>/data/range=R/kind=base|delta/gen=G/    <path>/heads/gen=G/
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import ledger as L

FIELDS = [c for c in L.LEDGER_COLUMNS if c != "svn_revision"]
HEAD = "range long, base long, base_rows long, delta_rows long, gen long"


@dataclass(frozen=True)
class LedgerStore:
    """Where a ledger lies and how it is cut."""
    spark: SparkSession
    path: str
    range_size: int = 1_000_000
    share: float = 0.25

    def _range(self):
        return F.floor(F.col("svn_revision") / self.range_size).cast("long")

    def _write(self, rows: DataFrame, kind: str, gen: int) -> None:
        """``rows`` (with ``range``) as one generation of their ranges; a repeated write replaces it."""
        (rows.withColumns({"kind": F.lit(kind), "gen": F.lit(gen).cast("long")}).repartition("range")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("range", "kind", "gen").parquet(f"{self.path}/data"))

    def _write_heads(self, heads: DataFrame, gen: int) -> None:
        heads.select("range", "base", "base_rows", "delta_rows").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/heads/gen={gen}")

    def create(self, rows: DataFrame) -> None:
        """Generation 0: ``rows`` (LEDGER_COLUMNS) as the bases of their ranges."""
        ranged = rows.select(*L.LEDGER_COLUMNS).withColumn("range", self._range())
        at = {"ts": F.lit(None).cast("timestamp"), "seq": F.lit(None).cast("long")}
        self._write(ranged.withColumns(at), "base", 0)
        heads = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("base_rows")).withColumns({"base": F.lit(0).cast("long"), "delta_rows": F.lit(0).cast("long")})
        self._write_heads(heads, 0)

    def heads(self, upto: int) -> DataFrame:
        """The newest head of each range up to a generation."""
        all_ = self.spark.read.schema(HEAD).parquet(f"{self.path}/heads").where(F.col("gen") <= upto)
        return all_.groupBy("range").agg(F.max_by(F.struct("base", "base_rows", "delta_rows"), "gen").alias("h")).select("range", "h.*")

    def generation(self) -> int:
        """The newest generation that is complete."""
        return self.spark.read.schema(HEAD).parquet(f"{self.path}/heads").agg(F.max("gen")).first()[0] or 0

    def _live(self, heads: DataFrame, upto: int) -> tuple[DataFrame, DataFrame]:
        """(base rows, delta rows) that count, of the ranges in ``heads``."""
        data = self.spark.read.parquet(f"{self.path}/data").where(F.col("gen") <= upto)
        rows = data.join(heads.select("range", "base"), "range")
        return (rows.where((F.col("kind") == "base") & (F.col("gen") == F.col("base"))).drop("kind", "gen", "base", "ts", "seq"),
                rows.where((F.col("kind") == "delta") & (F.col("gen") > F.col("base"))).drop("kind", "base"))

    def read(self, upto: int | None = None) -> DataFrame:
        """The ledger (LEDGER_COLUMNS) as of a generation, the newest by default. Ranges without deltas
        are only scanned."""
        upto = self.generation() if upto is None else upto
        heads = materialize(self.heads(upto), "ledger-heads")
        still = self._live(heads.where("delta_rows = 0"), upto)[0]
        return still.select(*L.LEDGER_COLUMNS).unionByName(self._merged(heads.where("delta_rows > 0"), upto).drop("range"))

    def _merged(self, heads: DataFrame, upto: int) -> DataFrame:
        """Last-wins merge of bases and deltas: as if the batches had been applied one after the
        other, so of writes with one time that of the later batch wins."""
        base, delta = self._live(heads, upto)
        last = materialize(delta.groupBy("range", "svn_revision").agg(
            F.max_by(F.struct(*FIELDS), F.struct("ts", "gen", "seq")).alias("_new"),
            F.max(F.struct("ts", "gen", "seq")).alias("_at")), "ledger-deltas")
        wins = F.coalesce(F.struct("_at.ts", "_at.seq") > F.struct(F.col("updated_at").alias("ts"), F.lit(-1).cast("long").alias("seq")), F.lit(False))
        on = ["range", "svn_revision"]
        kept = base.join(last, on, "left").select(*on, *[F.when(wins, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in FIELDS])
        met = base.select(*on).join(last.select(*on), on, "left_semi")
        new = last.join(met, on, "left_anti").select(*on, "_new.*")
        return kept.unionByName(new.select(*kept.columns)).select("range", *L.LEDGER_COLUMNS)

    def apply(self, writes: DataFrame, batch_id: int) -> None:
        """J9 for one batch of checkpoint writes (see ``ledger.ledger_upsert``), on top of generation
        ``batch_id``; the result is generation ``batch_id + 1``."""
        gen = batch_id + 1
        self.drop_superseded(batch_id)
        row = F.struct(F.lit(None).cast("string").alias("git_commit_sha"), "svn_author", "svn_timestamp", "svn_message", "batch_number",
                       F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.lit(L.PENDING).alias("status"),
                       F.lit(None).cast("string").alias("error_message"), F.lit(0).alias("retry_count"))
        at = F.struct("ts", F.col("seq").cast("long").alias("seq"))
        delta = materialize(writes.groupBy("svn_revision").agg(F.max_by(row, at).alias("_new"), F.max(at).alias("_at"))
                            .select("svn_revision", "_new.*", "_at.*").withColumn("range", self._range()), "ledger-batch")
        if delta.isEmpty():
            return
        self._write(delta.select(*L.LEDGER_COLUMNS, "ts", "seq", "range"), "delta", gen)
        touched = delta.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
        none = F.lit(0).cast("long")
        now = materialize(touched.join(self.heads(batch_id), "range", "left").select(
            "range", F.coalesce("base", none).alias("base"), F.coalesce("base_rows", none).alias("base_rows"),
            (F.coalesce("delta_rows", none) + F.col("n")).alias("delta_rows")), "ledger-touched")
        full = now.where(F.col("delta_rows") > F.col("base_rows") * self.share)
        if not full.isEmpty():
            merged = materialize(self._merged(full, gen), "ledger-compacted")
            self._write(merged.withColumns({"ts": F.lit(None).cast("timestamp"), "seq": F.lit(None).cast("long")}), "base", gen)
            sizes = merged.groupBy("range").agg(F.count(F.lit(1)).alias("base_rows"))
            now = (now.join(full.select("range"), "range", "left_anti")
                   .unionByName(sizes.select("range", F.lit(gen).cast("long").alias("base"), "base_rows", none.alias("delta_rows"))))
        self._write_heads(now, gen)

    def drop_superseded(self, batch_id: int) -> None:
        """Delete what the compactions of earlier batches replaced: batch ``batch_id`` reads generation
        ``batch_id``, and no earlier batch can be replayed once it runs."""
        done = self.spark.read.schema(HEAD).parquet(f"{self.path}/heads").where((F.col("gen") == batch_id) & (F.col("base") == batch_id) & (F.col("gen") > 0))
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        system = hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for r in done.select("range").toLocalIterator():  # ranges that one batch compacted
            for kind in ("base", "delta"):
                for status in system.globStatus(hadoop(f"{self.path}/data/range={r['range']}/kind={kind}/gen=*")) or []:
                    g = int(status.getPath().getName().split("=")[1])
                    if g < batch_id or (kind == "delta" and g == batch_id):
                        system.delete(status.getPath(), True)
