"""Registered metadata, project and composed-report queries (and their oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking
from ..operators import metadata as M
from ..operators import projects as PR
from ..sources import files as src_files
from ..sources import fixtures as fx
from ..functions import paths
from . import composed
from . import oracle_fixtures as ofx
from .catalog import query
from .queries_corpus import fixed_ts, corpus_files, project_pairs

W = ofx.with_ctes


def _j(c: str, sep: str = ",") -> F.Column:
    return F.array_join(F.col(c), sep).alias(c)


@query("java_metadata", W(ofx.JAVA, ofx.META_FILES) + """
SELECT rel_path, package, array_to_string(classes, ',') AS classes, array_to_string(imports, ',') AS imports,
       lines::BIGINT AS lines FROM java_meta""")
def q_java_metadata(spark, sf):
    f = M.with_java_code(fx.java_files(spark, sf))
    m = M.java_metadata(F.col("content"), F.col("code"))
    return f.select("rel_path", m["package"].alias("package"), F.array_join(m["classes"], ",").alias("classes"),
                    F.array_join(m["imports"], ",").alias("imports"), m["lines"].cast("bigint").alias("lines"))


@query("md_metadata", W(ofx.JAVA, ofx.META_FILES) + """
SELECT rel_path, array_to_string(headings, '|') AS headings, lines::BIGINT AS lines, has_code_blocks FROM md_meta""")
def q_md_metadata(spark, sf):
    f = fx.markdown_files(spark, sf)
    m = M.markdown_metadata(F.col("content"))
    return f.select("rel_path", F.array_join(m["headings"], "|").alias("headings"),
                    m["lines"].cast("bigint").alias("lines"), m["has_code_blocks"].alias("has_code_blocks"))


@query("yaml_metadata", W(ofx.JAVA, ofx.META_FILES) + """
SELECT rel_path, array_to_string(keys, ',') AS top_level_keys, lines::BIGINT AS lines FROM yaml_meta""")
def q_yaml_metadata(spark, sf):
    f = fx.yaml_files(spark, sf)
    m = M.yaml_metadata(F.col("content"))
    return f.select("rel_path", F.array_join(m["top_level_keys"], ",").alias("top_level_keys"),
                    m["lines"].cast("bigint").alias("lines"))


@query("file_metadata", W(ofx.JAVA, ofx.META_FILES) + """
SELECT rel_path, handler, file_type, description, lines::BIGINT AS lines FROM all_meta""")
def q_file_metadata(spark, sf):
    files = fx.java_files(spark, sf).unionByName(fx.markdown_files(spark, sf)).unionByName(fx.yaml_files(spark, sf))
    m = M.file_metadata(files)
    return m.select("rel_path", "handler", "file_type", "description", F.col("lines").cast("bigint").alias("lines"))


def walked_tree(spark, sf):
    return fx.doc_tree(spark, sf).where(paths.not_in_skipped_dir(F.col("rel_path")))


@query("files_by_ext", W(ofx.DOC_TREE, ofx.WALKED_TREE) + " SELECT ext, n_files FROM by_ext")
def q_files_by_ext(spark, sf):
    return M.files_by_extension(walked_tree(spark, sf))


@query("files_by_handler", W(ofx.DOC_TREE, ofx.WALKED_TREE) + """
SELECT handler, n_files, extension, examples FROM by_handler""")
def q_files_by_handler(spark, sf):
    h = M.files_by_handler(walked_tree(spark, sf))
    return h.select("handler", "n_files", "extension", _j("examples"))


@query("structure", W(ofx.DOC_TREE, ofx.WALKED_TREE) + """
SELECT 'extension' AS kind, ext AS key, n_files, CAST(NULL AS VARCHAR) AS extension, CAST(NULL AS VARCHAR) AS examples
FROM by_ext
UNION ALL
SELECT 'handler', handler, n_files, extension, examples FROM by_handler""")
def q_structure(spark, sf):
    s = M.analyze_structure(walked_tree(spark, sf))
    return s.select("kind", "key", "n_files", "extension", _j("examples"))


# ---------------------------------------------------------------------------
# projects
# ---------------------------------------------------------------------------

@query("project_register", W(ofx.PROJECTS) + """
SELECT project_name, description FROM projects WHERE s_suppkey % 3 = 0
UNION ALL
SELECT project_name, 'New ' || substr(description, 12) FROM projects WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0""")
def q_project_register(spark, sf):
    existing = fx.projects(spark, sf, keep_mod=3)
    new = fx.projects(spark, sf, keep_mod=2, label="New ")
    return PR.register_projects(existing, new).select("project_name", "description")


@query("project_info", W(ofx.PROJECTS, ofx.PROJECT_CHUNKS) + """,
v AS (SELECT DISTINCT project, version FROM project_pairs)
SELECT p.project_name, p.project_type,
       coalesce((SELECT string_agg(v.project || '_v' || v.version, ',' ORDER BY v.version) FROM v
                 WHERE v.project = p.project_name), '') AS datasets
FROM projects p""")
def q_project_info(spark, sf):
    i = PR.project_info(fx.projects(spark, sf), project_pairs(spark, sf))
    return i.select("project_name", "project_type", _j("datasets"))


@query("project_rollup", W(ofx.PROJECTS) + """
SELECT p.project_name, coalesce(c.n, 0)::BIGINT AS total_chunks, coalesce(c.n, 0) > 0 AS indexed
FROM projects p LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) c
  ON p.project_name = c.source""")
def q_project_rollup(spark, sf):
    d = fx.read_table(spark, sf, "documents").select("doc_id", "text", "source")
    named = d.withColumn("rel_path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    files = src_files.files_from_table(named, "rel_path", "text", carry={"source": "project"})
    ch = chunking.extract_generic_chunks(files, fixed_ts(), carry=["project"])
    return PR.project_rollup(fx.projects(spark, sf), ch)


# ---------------------------------------------------------------------------
# composed reports
# ---------------------------------------------------------------------------

@query("dataset_report", W(ofx.PROJECT_CHUNKS) + """,
t AS (SELECT project, version, pair_type, count(*) AS n FROM project_pairs GROUP BY ALL)
SELECT project, version::BIGINT AS version, sum(n)::BIGINT AS total_pairs,
       string_agg(pair_type || ':' || n, ',' ORDER BY pair_type) AS pairs_by_type
FROM t GROUP BY ALL""")
def q_dataset_report(spark, sf):
    r = composed.dataset_report(project_pairs(spark, sf))
    return r.select("project", F.col("version").cast("bigint").alias("version"),
                    F.col("total_pairs").cast("bigint").alias("total_pairs"), "pairs_by_type")


@query("corpus_report", W(ofx.JAVA, ofx.DOC_TREE, ofx.TREE_CHUNKS, ofx.ALL_CHUNKS, ofx.pairs_of("all_chunks")) + f""",
counted AS (
  SELECT len(regexp_extract_all(input_text || chr(10) || chr(10) || 'EXPLANATION:' || chr(10) || output_text,
                                '{ofx.TOKEN_PAT}')) AS token_count FROM pairs)
SELECT (SELECT count(*) FROM indexed_tree) + (SELECT count(*) FROM java_files) AS total_files,
       (SELECT count(*) FROM all_chunks) AS total_chunks,
       count(*) AS total_pairs, coalesce(sum(token_count), 0)::BIGINT AS total_tokens,
       coalesce(round(avg(token_count), 6), 0.0) AS avg_tokens_per_pair,
       coalesce(max(token_count), 0)::BIGINT AS max_tokens, coalesce(min(token_count), 0)::BIGINT AS min_tokens
FROM counted""")
def q_corpus_report(spark, sf):
    return composed.corpus_report(corpus_files(spark, sf), created_at=fixed_ts())


@query("build_dataset", W(ofx.JAVA, ofx.DOC_TREE, ofx.TREE_CHUNKS, ofx.ALL_CHUNKS, ofx.pairs_of("all_chunks")) + """
SELECT 'shop' AS project, 1::BIGINT AS version, pair_type, count(*)::BIGINT AS n_pairs FROM pairs GROUP BY pair_type""")
def q_build_dataset(spark, sf):
    _, stats = composed.build_dataset(corpus_files(spark, sf), "shop", 1, created_at=fixed_ts())
    return stats.select("project", F.col("version").cast("bigint").alias("version"), "pair_type", "n_pairs")
