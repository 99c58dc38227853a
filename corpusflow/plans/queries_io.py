"""Registered sources, sinks and extension points: each writes data derived from the supplied tables
under the shared folder, or registers a user's function, and reads the result back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, metadata
from ..operators import tokens as K
from ..operators import versions as V
from ..sources import files as src
from ..sources import fixtures as fx
from ..streaming.jobs import scratch_dir
from . import oracle_fixtures as ofx
from .catalog import query
from .queries_corpus import CHUNK_VIEW_SQL, chunk_view, fixed_ts, indexed_tree, project_pairs

W = ofx.with_ctes


@query("scan_source_tree", W(ofx.DOC_TREE) + """
SELECT rel_path, ext, sha256(content) AS file_sha, length(content)::BIGINT AS n_chars
FROM indexed_tree""")
def q_scan_source_tree(spark, sf):
    """The documents written as a source tree, then scanned."""
    root = f"{scratch_dir(spark, 'tree')}/build/project"  # the root itself lies under a skipped name
    src.write_source_tree(fx.doc_tree(spark, sf), root)
    return src.scan_source_tree(spark, root).select("rel_path", "ext", "file_sha", F.length("content").cast("bigint").alias("n_chars"))


@query("decode_source", """
SELECT doc_id, sha256(text || chr(10) || 'end') AS sha FROM documents""")
def q_decode_source(spark, sf):
    """Documents as bytes, with invalid bytes between and all kinds of line ends."""
    bad = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")), F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("0D0A"))).otherwise(F.unhex(F.lit("0D"))),
                   F.unhex(F.lit("C3")), F.encode(F.lit("end"), "UTF-8"))
    d = fx.read_table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(src.decode_text(bad), 256).alias("sha"))


@query("write_chunks", W(ofx.DOC_TREE, ofx.TREE_CHUNKS) + CHUNK_VIEW_SQL.format(src="tree_chunks WHERE file_type <> 'java'"))
def q_write_chunks(spark, sf):
    """Chunks written as JSON Lines by file type, and read back leniently."""
    path = scratch_dir(spark, "chunks")
    chunks = chunking.extract_generic_chunks(indexed_tree(spark, sf).where(F.col("ext") != ".java"), fixed_ts())
    src.write_chunks(chunks, path, fmt="json")
    return chunk_view(src.read_jsonl(spark, path, chunks.schema))


@query("append_event", "SELECT event_id, event_type, (ts IS NOT NULL) AS stamped FROM events")
def q_append_event(spark, sf):
    """Two appends, one of events that bring their time, one that is stamped."""
    path = scratch_dir(spark, "events")
    e = fx.read_table(spark, sf, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    src.append_event(e.where("event_id % 2 = 0"), path)
    src.append_event(e.where("event_id % 2 <> 0").drop("ts"), path)
    return spark.read.parquet(path).select("event_id", "event_type", F.col("ts").isNotNull().alias("stamped"))


@query("dataset_version_write", W(ofx.PROJECT_CHUNKS) + """
SELECT project, version::BIGINT AS version, pair_id FROM project_pairs""")
def q_dataset_version_write(spark, sf):
    """All versions of all projects written, twice (a retry), and read back."""
    path = scratch_dir(spark, "dataset")
    p = project_pairs(spark, sf)
    for _ in range(2):
        V.write_dataset_versions(p, path)
    # with the schema given, a project named by digits stays a string
    return spark.read.schema(p.schema).parquet(path).select("project", F.col("version").cast("bigint").alias("version"), "pair_id")


@query("read_jsonl_strict", W(ofx.DOC_TREE, ofx.TREE_CHUNKS) + CHUNK_VIEW_SQL.format(src="tree_chunks WHERE file_type <> 'java'"))
def q_read_jsonl_strict(spark, sf):
    """S3: chunks written as JSON Lines and read back strictly (a malformed line would fail the read)."""
    path = scratch_dir(spark, "chunks")
    chunks = chunking.extract_generic_chunks(indexed_tree(spark, sf).where(F.col("ext") != ".java"), fixed_ts())
    src.write_chunks(chunks, path, fmt="json")
    return chunk_view(src.read_jsonl(spark, path, chunks.schema, lenient=False))


@query("register_extractor", W(ofx.DOC_TREE, ofx.TREE_CHUNKS) + """
SELECT file_path, chunk_type, chunk_name, CASE WHEN file_type = 'py' THEN 'Python module' ELSE description END AS description
FROM tree_chunks""")
def q_register_extractor(spark, sf):
    """The whole tree, with files of one extension going to a user's extractor."""
    def python_files(files, extracted_at):
        return chunking.extract_generic_chunks(files, extracted_at).withColumn("description", F.lit("Python module"))

    saved = chunking.registered_extractors()
    chunking.register_extractor(".py", python_files)
    try:
        return chunking.extract_chunks(indexed_tree(spark, sf), fixed_ts()).select("file_path", "chunk_type", "chunk_name", "description")
    finally:
        chunking._EXTRACTORS.clear()
        chunking._EXTRACTORS.update(saved)


@query("register_handler", W(ofx.DOC_TREE) + """
SELECT rel_path, CASE WHEN ext = '.properties' THEN 'PropsHandler' WHEN ext = '.java' THEN 'JavaFileHandler' WHEN ext = '.md' THEN 'MarkdownFileHandler'
                      WHEN ext IN ('.yaml', '.yml') THEN 'YamlFileHandler' END AS handler,
       CASE WHEN ext = '.properties' THEN 'Properties: ' || length(content) END AS props
FROM indexed_tree""")
def q_register_handler(spark, sf):
    """The whole tree, with a user's handler for files of its suffix."""
    before = list(metadata._HANDLERS)
    metadata.register_handler("PropsHandler", [".properties"], lambda c: {
        "description": F.concat(F.lit("Properties: "), F.length(c).cast("string")), "lines": F.lit(1)})
    try:
        found = metadata.file_metadata(indexed_tree(spark, sf))
        return found.select("rel_path", "handler", F.when(F.col("handler") == "PropsHandler", F.col("description")).alias("props"))
    finally:
        metadata._HANDLERS[:] = before


class WordLengths:
    """A user's encoder: word lengths."""

    def encode_batch(self, texts):
        return [None if t is None else [len(w) for w in t.split(" ")] for t in texts]


@query("user_encoder", """
SELECT doc_id, len(string_split(text, ' '))::BIGINT AS n_ids, (length(text) - len(string_split(text, ' ')) + 1)::BIGINT AS id_sum FROM documents""")
def q_user_encoder(spark, sf):
    """A user's encoder over the documents."""
    d = K.encode_columns(fx.read_table(spark, sf, "documents").select("doc_id", "text"), {"text": "ids"}, WordLengths(), keep=["doc_id"])
    return d.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


@query("chunk_code", W(ofx.JAVA) + """
SELECT file_path AS path, chunk_type, chunk_name, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, parent_class, sha256(code_content) AS sha
FROM java_chunks WHERE chunk_type <> 'file'""")
def q_chunk_code(spark, sf):
    """The table function over the Java files in SQL, with a table argument."""
    chunking.register_chunk_udtf(spark)
    return spark.sql("""SELECT path, chunk_type, chunk_name, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line,
                               parent_class, sha2(code_content, 256) AS sha
                        FROM chunk_code(TABLE(SELECT rel_path AS path, content FROM {files}) PARTITION BY path)""", files=fx.java_files(spark, sf))
