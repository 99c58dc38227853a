"""The chunk index and its state stored in hash buckets of the path.

``chunks`` and ``state`` are Spark tables bucketed by the path, with the bucket as a partition folder
too: a join on the path reads the index where it lies (no exchange on its side), and a re-index
writes the buckets that hold a changed path and no other. What micro-batch ``b`` writes is generation
``b + 1`` of those buckets; head rows, written last, say which generation of a bucket counts. So
a replayed batch replaces what it wrote, and a reader never sees half a batch. The generation
before a bucket's newest is deleted by the next batch.

    <path>/chunks|state/bucket=B/gen=G/    <path>/heads/gen=G/
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import changes as C
from . import chunking

HEAD = "bucket int, gen long"
STATE_SCHEMA = T.StructType([T.StructField("rel_path", T.StringType()), T.StructField("file_sha", T.StringType()),
                             T.StructField("last_indexed", T.TimestampType()), T.StructField("chunks_count", T.IntegerType())])
KEYS = {"chunks": "file_path", "state": "rel_path"}


class IndexStore:
    """An index under ``path`` in ``buckets`` buckets (the same number for its whole life)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schemas = {"chunks": chunking.CHUNK_SCHEMA, "state": STATE_SCHEMA}
        for kind, schema in self.schemas.items():
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            spark.sql(f"""CREATE TABLE IF NOT EXISTS {self.table(kind)} ({columns}, bucket int, gen bigint)
                          USING parquet OPTIONS ('partitionOverwriteMode' = 'dynamic') PARTITIONED BY (bucket, gen)
                          CLUSTERED BY ({KEYS[kind]}) INTO {buckets} BUCKETS LOCATION '{self.path}/{kind}'""")
            if spark.conf.get("spark.sql.catalogImplementation") == "hive":
                spark.sql(f"ALTER TABLE {self.table(kind)} RECOVER PARTITIONS")

    def table(self, kind: str) -> str:
        return f"index_{kind}_{hashlib.md5(self.path.encode()).hexdigest()[:16]}"

    def bucket_of(self, path: Column) -> Column:
        """The bucket that Spark deals a path to."""
        return F.pmod(F.hash(path), F.lit(self.buckets)).cast("int")

    def _heads(self, upto: int | None) -> dict[int, int]:
        """Newest generation of each bucket (at most ``buckets`` rows)."""
        try:
            heads = self.spark.read.schema(HEAD).parquet(f"{self.path}/heads")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):  # nothing was written yet
                return {}
            raise
        heads = heads if upto is None else heads.where(F.col("gen") <= upto)
        return {r.bucket: r.g for r in heads.groupBy("bucket").agg(F.max("gen").alias("g")).collect()}

    def read(self, kind: str, upto: int | None = None, only: list[int] | None = None) -> DataFrame:
        """``chunks`` or ``state`` as of a generation (the newest by default), of all buckets or some."""
        live: dict[int, list[int]] = {}
        for bucket, gen in self._heads(upto).items():
            if only is None or bucket in only:
                live.setdefault(gen, []).append(bucket)
        counts = F.lit(False)
        for gen, buckets in live.items():
            counts |= (F.col("gen") == gen) & F.col("bucket").isin(buckets)
        return self.spark.table(self.table(kind)).where(counts).select(*self.schemas[kind].names)

    def diff(self, files: DataFrame, upto: int | None = None, carry: list[str] | None = None) -> DataFrame:
        """J1 against the stored state."""
        return C.diff_snapshots(files, self.read("state", upto), carry=carry)

    def _write(self, rows: DataFrame, kind: str, gen: int) -> None:
        key = KEYS[kind]
        (rows.select(*self.schemas[kind].names, self.bucket_of(F.col(key)).alias("bucket"), F.lit(gen).cast("long").alias("gen"))
         .repartition(self.buckets, key).write.insertInto(self.table(kind), overwrite=True))

    def apply(self, files: DataFrame, batch_id: int, stamp: Column | None = None) -> DataFrame:
        """J1, F3, U3, J3 for one whole snapshot of the files, on top of generation ``batch_id``. Returns
        the new chunks (persisted; the caller unpersists them)."""
        gen, stamp = batch_id + 1, F.current_timestamp() if stamp is None else stamp
        self.drop_superseded(batch_id)
        diff = self.diff(files, batch_id, carry=["path", "ext", "content"]).persist()
        new_chunks = chunking.extract_chunks(C.changed_files(diff), stamp).persist()
        gone = diff.where(F.col("change") != C.UNCHANGED).select("rel_path")
        touched = [r.b for r in gone.select(self.bucket_of(F.col("rel_path")).alias("b")).distinct().collect()]
        if touched:
            old = self.read("chunks", batch_id, touched)
            kept = old.join(gone.select(F.col("rel_path").alias("file_path")), "file_path", "left_anti")
            self._write(kept.unionByName(new_chunks.select(*kept.columns)), "chunks", gen)
            counts = new_chunks.groupBy(F.col("file_path").alias("rel_path")).agg(F.count(F.lit(1)).cast("int").alias("chunks_count"))
            done = (diff.where(F.col("change").isin(C.NEW, C.MODIFIED)).select("rel_path", F.col("cur_sha").alias("file_sha"))
                    .join(counts, "rel_path", "left")
                    .select("rel_path", "file_sha", stamp.alias("last_indexed"), F.coalesce("chunks_count", F.lit(0)).alias("chunks_count")))
            still = self.read("state", batch_id, touched).join(gone, "rel_path", "left_anti")
            self._write(still.unionByName(done), "state", gen)
            heads = self.spark.createDataFrame([(b,) for b in touched], "bucket int")
            heads.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/heads/gen={gen}")
        diff.unpersist()
        return new_chunks

    def drop_superseded(self, batch_id: int) -> None:
        """Delete the generations that earlier batches replaced: batch ``batch_id`` reads generation
        ``batch_id``, and no earlier batch can be replayed once it runs."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        system = hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        replaced = [b for b, g in self._heads(batch_id).items() if g == batch_id]
        for kind in KEYS if replaced else ():
            for b in replaced:
                for status in system.globStatus(hadoop(f"{self.path}/{kind}/bucket={b}/gen=*")) or []:
                    if int(status.getPath().getName().split("=")[1]) < batch_id:
                        system.delete(status.getPath(), True)
            self.spark.sql(f"REFRESH TABLE {self.table(kind)}")
