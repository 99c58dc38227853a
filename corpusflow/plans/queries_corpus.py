"""Registered corpus queries: files, chunks, pairs (and their oracles)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import chunking, pairs
from ..sources import files as src_files
from ..sources import fixtures
from . import oracle_fixtures as ofx
from .catalog import query

def fixed_ts() -> F.Column:
    """Extraction/creation time stamped on derived rows (deterministic)."""
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


# ---------------------------------------------------------------------------
# shared inputs
# ---------------------------------------------------------------------------

def indexed_tree(spark: SparkSession, sf: str) -> DataFrame:
    return src_files.select_indexable(fixtures.doc_tree(spark, sf))


def corpus_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' tree (filtered) plus the Java files."""
    return indexed_tree(spark, sf).unionByName(fixtures.java_files(spark, sf))


def all_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.extract_chunks(corpus_files(spark, sf), fixed_ts())


def chunk_view(df: DataFrame) -> DataFrame:
    return df.select("chunk_id", "file_path", "file_type", "chunk_type", "chunk_name",
                     F.col("start_line").cast("bigint").alias("start_line"),
                     F.col("end_line").cast("bigint").alias("end_line"),
                     "description", "context", "parent_class", "checksum")


CHUNK_VIEW_SQL = """SELECT chunk_id, file_path, file_type, chunk_type, chunk_name,
       start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, description, context,
       parent_class, sha256(code_content) AS checksum FROM {src}"""


def pair_view(df: DataFrame) -> DataFrame:
    return df.select("pair_id", "chunk_id", "pair_type", F.sha2("input_text", 256).alias("input_sha"),
                     "output_text", F.array_join("tags", ",").alias("tags"))


PAIR_VIEW_SQL = """SELECT pair_id, chunk_id, pair_type, sha256(input_text) AS input_sha, output_text, tags
FROM pairs"""


# ---------------------------------------------------------------------------
# Scan and filter
# ---------------------------------------------------------------------------

@query("ext_filter", ofx.with_ctes(ofx.DOC_TREE) + """
SELECT rel_path, ext FROM doc_tree WHERE ext IN ('.java','.py','.xml','.yaml','.properties','.sql','.md','.yml')""")
def q_ext_filter(spark, sf):
    t = fixtures.doc_tree(spark, sf)
    return t.where(paths.ext_in(F.col("ext"))).select("rel_path", "ext")


# ---------------------------------------------------------------------------
# chunks
# ---------------------------------------------------------------------------

@query("generic_chunks", ofx.with_ctes(ofx.DOC_TREE, ofx.TREE_CHUNKS) +
       CHUNK_VIEW_SQL.format(src="tree_chunks WHERE file_type <> 'java'"))
def q_generic_chunks(spark, sf):
    t = indexed_tree(spark, sf).where(F.col("ext") != ".java")
    return chunk_view(chunking.extract_generic_chunks(t, fixed_ts()))


@query("java_chunks", ofx.with_ctes(ofx.JAVA) + CHUNK_VIEW_SQL.format(src="java_chunks"))
def q_java_chunks(spark, sf):
    return chunk_view(chunking.extract_java_chunks(fixtures.java_files(spark, sf), fixed_ts()))


@query("all_chunks", ofx.with_ctes(ofx.JAVA, ofx.DOC_TREE, ofx.TREE_CHUNKS, ofx.ALL_CHUNKS) +
       CHUNK_VIEW_SQL.format(src="all_chunks"))
def q_all_chunks(spark, sf):
    return chunk_view(all_chunks(spark, sf))


@query("chunks_of_type", ofx.with_ctes(ofx.JAVA) +
       "SELECT chunk_id, chunk_name, start_line::BIGINT AS start_line FROM java_chunks "
       "WHERE chunk_type IN ('class', 'method')")
def q_chunks_of_type(spark, sf):
    c = chunking.extract_java_chunks(fixtures.java_files(spark, sf), fixed_ts())
    return chunking.chunks_of_type(c, ["class", "method"]).select(
        "chunk_id", "chunk_name", F.col("start_line").cast("bigint").alias("start_line"))


@query("chunks_by_type", ofx.with_ctes(ofx.JAVA, ofx.DOC_TREE, ofx.TREE_CHUNKS, ofx.ALL_CHUNKS) +
       "SELECT chunk_type, count(*)::BIGINT AS n_chunks FROM all_chunks GROUP BY chunk_type")
def q_chunks_by_type(spark, sf):
    return chunking.chunks_by_type(all_chunks(spark, sf))


@query("chunks_per_file", ofx.with_ctes(ofx.JAVA, ofx.DOC_TREE, ofx.TREE_CHUNKS, ofx.ALL_CHUNKS) +
       "SELECT file_path, count(*)::BIGINT AS chunks_count FROM all_chunks GROUP BY file_path")
def q_chunks_per_file(spark, sf):
    return chunking.chunks_per_file(all_chunks(spark, sf)).select(
        "file_path", F.col("chunks_count").cast("bigint").alias("chunks_count"))


@query("instruction_pairs", ofx.with_ctes(ofx.JAVA) + """
SELECT sha256(content) AS input_sha, 'Explain this code' AS output FROM java_files""")
def q_instruction_pairs(spark, sf):
    p = pairs.export_instruction_pairs(fixtures.java_files(spark, sf), ".java")
    return p.select(F.sha2("input", 256).alias("input_sha"), "output")


# ---------------------------------------------------------------------------
# U4 / A3: pairs
# ---------------------------------------------------------------------------

@query("training_pairs", ofx.with_ctes(ofx.JAVA, ofx.DOC_TREE, ofx.TREE_CHUNKS, ofx.ALL_CHUNKS,
                                        ofx.pairs_of("all_chunks")) + PAIR_VIEW_SQL)
def q_training_pairs(spark, sf):
    return pair_view(pairs.generate_pairs(all_chunks(spark, sf), fixed_ts()))


def project_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Versioned pairs: documents as files of the project named by their source,
    version 1 + (doc_id div 20) % 4 (every project spans versions 1-4)."""
    d = fixtures.read_table(spark, sf, "documents").select("doc_id", "text", "source")
    files = d.select(
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("rel_path"),
        F.lit(".md").alias("ext"), F.col("text").alias("content"),
        F.col("source").alias("project"), (F.floor(F.col("doc_id") / 20) % 4 + 1).cast("int").alias("pversion"))
    ch = chunking.extract_generic_chunks(files, fixed_ts(), carry=["project", "pversion"])
    return (pairs.generate_pairs(ch, fixed_ts(), carry=["project", "pversion"])
            .drop("version").withColumnRenamed("pversion", "version"))


@query("pairs_by_type", ofx.with_ctes(ofx.PROJECT_CHUNKS) + """
SELECT project, version::BIGINT AS version, pair_type, count(*)::BIGINT AS n_pairs
FROM project_pairs GROUP BY ALL""")
def q_pairs_by_type(spark, sf):
    p = pairs.pairs_by_type(project_pairs(spark, sf), ["project", "version"])
    return p.select("project", F.col("version").cast("bigint").alias("version"), "pair_type", "n_pairs")
