"""File sources and sinks.

``scan_source_tree`` lists and reads a directory tree on the executors; after that, work runs on a
compact ``files`` table (path, rel_path, ext, content, file_sha) that can live in Parquet.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids, paths
from ..session import materialize

FILES_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("rel_path", T.StringType()),
    T.StructField("ext", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("file_sha", T.StringType()),
])


def decode_text(raw: Column) -> Column:
    """Bytes to text as ``open(..., errors='ignore')`` in text mode does:
    invalid UTF-8 sequences are dropped and CRLF / CR become LF."""
    s = raw.cast("string")
    text = F.when(F.is_valid_utf8(s), s).otherwise(
        F.regexp_replace(F.make_valid_utf8(s), "�", ""))
    return F.regexp_replace(text, "\r\n?", "\n")


def select_indexable(files: DataFrame, exts: list[str] | None = None) -> DataFrame:
    """F1 + F2 on a files table."""
    return files.where(paths.not_in_skipped_dir(F.col("rel_path")) & paths.ext_in(F.col("ext"), exts))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system's scheme and made absolute, as Spark reports the files under it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


#: Bytes of file contents that one task reads, about, and that one Arrow batch holds at most (one file at least).
READ_BYTES = 128 << 20
BATCH_BYTES = 32 << 20


def open_arrow(uri: str):
    """(file system, path) of a root, opened in a task by its scheme. Another store is plugged in by a
    function like this one."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def _list_folders(uri: str, opener):
    """Folders (relative to ``uri``) -> their entries: rel_path, is_dir, size. A folder that has gone since is
    empty; links to folders are not followed."""
    def run(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs
        system, top = opener(uri)
        local = isinstance(system, fs.LocalFileSystem)
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                at = f"{top}/{rel}" if rel else top
                found = [(f"{rel}/{i.base_name}" if rel else i.base_name, i.type == fs.FileType.Directory, i.size or 0)
                         for i in system.get_file_info(fs.FileSelector(at, recursive=False, allow_not_found=True))
                         if i.type == fs.FileType.File or i.type == fs.FileType.Directory and not (local and os.path.islink(i.path))]
                for k in range(0, len(found), 10_000):
                    part = found[k:k + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.bool_()),
                         pa.array([x[2] for x in part], pa.int64())], names=["rel_path", "is_dir", "size"])
    return run


def list_tree(spark: SparkSession, root: str, keep_all: bool = False, opener=open_arrow) -> DataFrame:
    """All files under ``root``: rel_path, size. One round a level: the folders of a level are rows, dealt to the
    executors, which list them; skipped folders (F1) are dropped before the next round opens them."""
    uri = qualified(spark, root)
    level, files = spark.createDataFrame([("",)], "rel_path string"), None
    cores = spark.sparkContext.defaultParallelism
    while True:
        # written: a level is listed once, and a lost executor lists only its own folders again
        found = materialize(level.repartition(cores).mapInArrow(_list_folders(uri, opener), "rel_path string, is_dir boolean, size long"), "tree-level")
        here = found.where(~F.col("is_dir")).select("rel_path", "size")
        files = here if files is None else files.unionByName(here)
        level = found.where("is_dir").select("rel_path")
        if not keep_all:
            level = level.where(paths.not_in_skipped_dir(F.concat("rel_path", F.lit("/"))))
        if level.isEmpty():
            return files


def _read_files(uri: str, opener):
    """Files (rel_path) -> rel_path, content, in batches of bounded bytes. A file that has gone since is left out."""
    def run(batches):
        import pyarrow as pa
        system, top = opener(uri)
        made = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array([r for r, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.binary())], names=["rel_path", "content"])
        for batch in batches:
            rows, held = [], 0
            for rel in batch.column(0).to_pylist():
                try:
                    with system.open_input_stream(f"{top}/{rel}", compression=None) as f:
                        content = f.read()
                except FileNotFoundError:
                    continue
                if rows and held + len(content) > BATCH_BYTES:
                    yield made(rows)
                    rows, held = [], 0
                rows.append((rel, content))
                held += len(content)
            if rows:
                yield made(rows)
    return run


def scan_source_tree(spark: SparkSession, root: str, exts: list[str] | None = None,
                     keep_all: bool = False, opener=open_arrow) -> DataFrame:
    """Recursive walk of ``root`` (relative, absolute, or with a scheme) into a files table.

    The executors list the tree (``list_tree``) and read the files; the driver sees neither names nor
    contents. Folders and extensions are tested on the listing, so nothing of a skipped folder (F1) and no file
    of another extension (F2) is opened; ``keep_all`` turns both off. Names may start with an underscore; hidden files
    are left out. The file checksum is taken over the raw bytes (as the reference's change
    detector does); content is decoded text.
    """
    uri = qualified(spark, root)
    found = (list_tree(spark, root, keep_all, opener).withColumn("ext", paths.extension(F.col("rel_path")))
             .where(~paths.basename(F.col("rel_path")).startswith(".")))
    if not keep_all:
        found = select_indexable(found, exts)
    total = found.agg(F.sum("size")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // READ_BYTES))
    raw = (found.select("rel_path").repartition(int(tasks), "rel_path")
           .mapInArrow(_read_files(uri, opener), "rel_path string, content binary"))
    top = re.sub("^file:/+", "/", uri)
    return raw.select(F.concat(F.lit(top + "/"), "rel_path").alias("path"), "rel_path", paths.extension(F.col("rel_path")).alias("ext"),
                      decode_text(F.col("content")).alias("content"), F.sha2(F.col("content"), 256).alias("file_sha"))


def write_source_tree(files: DataFrame, root: str) -> int:
    """Write a files table (rel_path, content) as a tree of UTF-8 files under ``root``, each by the task
    that holds its row; returns the number of files. A repeated write replaces them. Null content
    gives an empty file."""
    base = qualified(files.sparkSession, root)

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        system, top = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", base))
        made = set()
        for batch in batches:
            for rel, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{top}/{rel}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(target, compression=None) as out:
                    out.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])
    return files.select("rel_path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, lenient: bool = True) -> DataFrame:
    """S3: JSON Lines; lenient drops malformed lines, strict fails on the first."""
    mode = "DROPMALFORMED" if lenient else "FAILFAST"
    return spark.read.schema(schema).option("mode", mode).json(path)


def write_chunks(chunks: DataFrame, path: str, partition_by: list[str] | None = None,
                 fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Chunk table sink (Parquet by default, JSON Lines on request)."""
    w = chunks.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


def append_event(events: DataFrame, path: str) -> None:
    """Append timestamped phase events (``ts`` stamped when missing)."""
    if "ts" not in events.columns:
        events = events.withColumn("ts", F.current_timestamp())
    events.write.mode("append").parquet(path)


def files_from_table(df: DataFrame, rel_path: str, content: str, carry: dict[str, str] | None = None) -> DataFrame:
    """Files table from any (path, text) relation; ``carry`` renames further columns into it."""
    return df.select(
        *[F.col(old).alias(new) for old, new in (carry or {}).items()],
        F.col(rel_path).alias("path"), F.col(rel_path).alias("rel_path"),
        paths.extension(F.col(rel_path)).alias("ext"), F.col(content).alias("content"),
        ids.checksum(F.col(content)).alias("file_sha"))
