"""Session construction and lineage checkpoints.

Every job in the package takes an existing ``SparkSession``; this module only
supplies sane defaults for local runs (tests, bench) and the checkpoint
folder rule: use the cluster's ``spark.checkpoint.dir`` when it is set, and
create a scratch folder only for a local master where it is unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # whole files travel through Arrow in the chunker; keep batches small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: A single file beyond this has row groups enough to be split by the scan.
SMALL_FILE_BYTES = 1 << 28


def build_session(master: str | None = None, app: str = "corpusflow",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    Reads ``spark.checkpoint.dir`` from the session. Only a local master may
    fall back to a fresh scratch folder (tests); a cluster without the setting
    is a configuration error, since a machine-local folder would not survive
    the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="corpusflow-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read
    it back: the lineage is cut like a checkpoint, and later reads still get
    column pruning and predicate pushdown (an RDD checkpoint gets neither)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table scan. A table that is one single small file (the supplied test tables, of one row group
    each) would be read by one task, so its rows are dealt to all cores; any other is left as scanned. Only the path's
    own status is asked for: no file of a folder is listed here."""
    path, cores = table_path(sf_dir, name), spark.sparkContext.defaultParallelism
    df = spark.read.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    return df.repartition(cores) if cores > 1 and status.isFile() and status.getLen() <= SMALL_FILE_BYTES else df
