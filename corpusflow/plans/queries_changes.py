"""Registered change-detection and dataset-version queries (and their oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import chunking
from ..operators import pairs as PR
from ..operators import versions as V
from ..operators.version_store import VersionStore
from ..session import materialize
from ..sources import fixtures as fx
from ..streaming.jobs import scratch_dir
from . import oracle_fixtures as ofx
from .catalog import query
from .queries_corpus import fixed_ts, project_pairs

W = ofx.with_ctes


def _diff(spark, sf):
    return C.diff_snapshots(fx.snapshot_files(spark, sf), fx.snapshot_state(spark, sf))


@query("snapshot_diff", W(ofx.SNAPSHOTS) + "SELECT rel_path, change FROM snap_diff")
def q_snapshot_diff(spark, sf):
    return _diff(spark, sf).select("rel_path", "change")


@query("deleted_files", W(ofx.SNAPSHOTS) + """
SELECT rel_path FROM snap_state WHERE rel_path NOT IN (SELECT rel_path FROM snap_cur)""")
def q_deleted_files(spark, sf):
    return C.deleted_files(fx.snapshot_state(spark, sf), fx.snapshot_files(spark, sf))


@query("changed_files", W(ofx.SNAPSHOTS) + """
SELECT c.rel_path, c.file_sha FROM snap_cur c LEFT JOIN snap_state s ON c.rel_path = s.rel_path
WHERE s.rel_path IS NULL OR s.file_sha <> c.file_sha""")
def q_changed_files(spark, sf):
    return C.changed_only(fx.snapshot_files(spark, sf), fx.snapshot_state(spark, sf)).select(
        "rel_path", "file_sha")


def _reindex(spark, sf):
    cur, state = fx.snapshot_files(spark, sf), fx.snapshot_state(spark, sf)
    diff = C.diff_snapshots(cur, state, carry=["path", "ext", "content"])   # one join for both uses
    old_chunks = chunking.extract_generic_chunks(fx.snapshot_previous(spark, sf), fixed_ts())
    new_chunks = chunking.extract_generic_chunks(C.changed_files(diff), fixed_ts())
    return state, diff, old_chunks, new_chunks


@query("index_upsert", W(ofx.SNAPSHOTS) + """
SELECT substr(md5(rel_path), 1, 16) AS chunk_id, rel_path AS file_path, sha256(content) AS checksum
FROM snap_cur""")
def q_index_upsert(spark, sf):
    _, diff, old_chunks, new_chunks = _reindex(spark, sf)
    return C.upsert_index(old_chunks, new_chunks, diff).select("chunk_id", "file_path", "checksum")


@query("index_state", W(ofx.SNAPSHOTS) + """
SELECT rel_path, file_sha, 1::BIGINT AS chunks_count FROM snap_cur""")
def q_index_state(spark, sf):
    state, diff, _, new_chunks = _reindex(spark, sf)
    st = C.next_state(state, diff, new_chunks, fixed_ts())
    return st.select("rel_path", "file_sha", F.col("chunks_count").cast("bigint").alias("chunks_count"))


@query("index_stats", W(ofx.SNAPSHOTS) + """
SELECT count(*) FILTER (WHERE change <> 'deleted')::BIGINT AS total_files,
       count(*) FILTER (WHERE change IN ('new', 'modified'))::BIGINT AS processed_files,
       count(*) FILTER (WHERE change = 'new')::BIGINT AS new_files,
       count(*) FILTER (WHERE change = 'modified')::BIGINT AS modified_files,
       count(*) FILTER (WHERE change = 'deleted')::BIGINT AS deleted_files,
       count(*) FILTER (WHERE change IN ('new', 'modified'))::BIGINT AS total_chunks
FROM snap_diff""")
def q_index_stats(spark, sf):
    _, diff, _, new_chunks = _reindex(spark, sf)
    return C.index_stats(diff, new_chunks)


# ---------------------------------------------------------------------------
# versions
# ---------------------------------------------------------------------------

@query("current_version", W(ofx.PROJECT_CHUNKS) + """
SELECT project, max(version)::BIGINT AS current_version FROM project_pairs GROUP BY project""")
def q_current_version(spark, sf):
    v = V.current_version(project_pairs(spark, sf))
    return v.select("project", F.col("current_version").cast("bigint").alias("current_version"))


@query("dataset_current", W(ofx.PROJECT_CHUNKS) + """
SELECT pair_id, project, version::BIGINT AS version FROM project_pairs p
WHERE version = (SELECT max(version) FROM project_pairs q WHERE q.project = p.project)""")
def q_dataset_current(spark, sf):
    d = V.read_dataset_version(project_pairs(spark, sf))
    return d.select("pair_id", "project", F.col("version").cast("bigint").alias("version"))


@query("pairs_since", W(ofx.PROJECT_CHUNKS) + """
SELECT project, pair_type, count(*)::BIGINT AS n_pairs FROM project_pairs WHERE version > 2 GROUP BY ALL""")
def q_pairs_since(spark, sf):
    return (V.pairs_since(project_pairs(spark, sf), since=2)
            .groupBy("project", "pair_type").agg(F.count(F.lit(1)).alias("n_pairs")))


# a version also repeats every pair of the version before whose id starts with an even digit
ROLLED_SQL = """,
rolled AS (
  SELECT pair_id, project, version, input_text, output_text FROM project_pairs
  UNION ALL
  SELECT pair_id, project, version + 1, input_text, output_text FROM project_pairs
  WHERE substr(pair_id, 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e'))"""


def rolled_pairs(spark, sf):
    p = project_pairs(spark, sf)
    again = p.where(F.substring("pair_id", 1, 1).isin(*"02468ace")).withColumn("version", F.col("version") + 1)
    return p.unionByName(again)


@query("version_delta", W(ofx.PROJECT_CHUNKS) + ROLLED_SQL + """
SELECT p.pair_id, p.project, p.version::BIGINT AS version FROM rolled p
WHERE NOT EXISTS (SELECT 1 FROM rolled q WHERE q.project = p.project AND q.version = p.version - 1
                  AND q.input_text = p.input_text AND q.output_text = p.output_text)""")
def q_version_delta(spark, sf):
    d = V.version_delta(rolled_pairs(spark, sf))
    return d.select("pair_id", "project", F.col("version").cast("bigint").alias("version"))


# every second pair also comes under another id, with some capitals and blanks around, and without an output
COPIED_SQL = """,
half AS (SELECT * FROM project_pairs WHERE substr(pair_id, 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e')),
copied AS (SELECT pair_id, input_text, output_text FROM project_pairs UNION ALL
           SELECT 'z' || pair_id, input_text, output_text FROM half)"""
SHOUTED_SQL = COPIED_SQL + """,
shouted AS (SELECT * FROM copied UNION ALL SELECT 'y' || pair_id, '  ' || translate(input_text, 'abcdefgh', 'ABCDEFGH'), output_text || ' ' FROM half
            UNION ALL SELECT 'x' || pair_id, input_text, NULL FROM half UNION ALL SELECT 'w' || pair_id, NULL, input_text FROM half
            UNION ALL SELECT 'x' || pair_id, input_text, NULL FROM half)"""


def copied_pairs(spark, sf):
    p = project_pairs(spark, sf).select("pair_id", "input_text", "output_text")
    again = p.where(F.substring("pair_id", 1, 1).isin(*"02468ace")).withColumn("pair_id", F.concat(F.lit("z"), "pair_id"))
    return p.unionByName(again)


def shouted_pairs(spark, sf):
    p = project_pairs(spark, sf).select("pair_id", "input_text", "output_text")
    half = p.where(F.substring("pair_id", 1, 1).isin(*"02468ace"))
    named = lambda c: F.concat(F.lit(c), "pair_id").alias("pair_id")
    none = half.select(named("x"), "input_text", F.lit(None).cast("string").alias("output_text"))
    return (copied_pairs(spark, sf).unionByName(half.select(named("y"), F.concat(F.lit("  "), F.translate("input_text", "abcdefgh", "ABCDEFGH")).alias("input_text"), F.concat("output_text", F.lit(" ")).alias("output_text")))
            .unionByName(none).unionByName(none).unionByName(half.select(named("w"), F.lit(None).cast("string").alias("input_text"), F.col("input_text").alias("output_text"))))


@query("dedupe_pairs", W(ofx.PROJECT_CHUNKS) + SHOUTED_SQL + """
SELECT min(pair_id) AS pair_id, sha256(coalesce(i, '?')) AS input_sha, sha256(coalesce(o, '?')) AS output_sha
FROM (SELECT pair_id, lower(trim(input_text)) AS i, lower(trim(output_text)) AS o FROM shouted) GROUP BY i, o""")
def q_dedupe_pairs(spark, sf):
    norm = lambda c: F.sha2(F.coalesce(F.lower(F.trim(c)), F.lit("?")), 256)
    return PR.dedupe_pairs(shouted_pairs(spark, sf)).select("pair_id", norm("input_text").alias("input_sha"), norm("output_text").alias("output_sha"))


# versions with repeats, and with pairs that are gone in the next version and come back in the one after
RETURNED_SQL = ROLLED_SQL + """,
returned AS (
  SELECT pair_id, pair_type, project, version, input_text, output_text FROM project_pairs
  UNION ALL SELECT pair_id, pair_type, project, version + 1, input_text, output_text FROM project_pairs
  WHERE substr(pair_id, 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e')
  UNION ALL SELECT pair_id, pair_type, project, version + 2, input_text, output_text FROM project_pairs WHERE substr(pair_id, 1, 1) IN ('1', '2', '3')
  UNION ALL SELECT 'z' || pair_id, pair_type, project, version + 1, input_text, output_text FROM project_pairs WHERE substr(pair_id, 1, 1) IN ('5', '6')
  UNION ALL SELECT pair_id, pair_type, project, version, input_text, output_text FROM project_pairs WHERE substr(pair_id, 1, 1) = '7')"""


def returned_pairs(spark, sf):
    p = project_pairs(spark, sf).select("pair_id", "pair_type", "project", "version", "input_text", "output_text")
    of = lambda digits, by: p.where(F.substring("pair_id", 1, 1).isin(*digits)).withColumn("version", F.col("version") + by)
    renamed = of("56", 1).withColumn("pair_id", F.concat(F.lit("z"), "pair_id"))
    return p.unionByName(of("02468ace", 1)).unionByName(of("123", 2)).unionByName(renamed).unionByName(of("7", 0))


def version_store(spark, sf) -> VersionStore:
    """All versions of all projects, written one after the other, the last one twice (a retry)."""
    store = VersionStore(spark, scratch_dir(spark, "versions"))
    rows = materialize(returned_pairs(spark, sf), "versions-input")
    versions = sorted(r.version for r in rows.select("version").distinct().collect())  # version numbers of a build series
    for v in [*versions, versions[-1]] if versions else []:
        store.add(rows.where(F.col("version") == v), v)
    return store


@query("version_store", W(ofx.PROJECT_CHUNKS) + RETURNED_SQL + """
SELECT project, version::BIGINT AS version, pair_id, sha256(input_text) AS input_sha, sha256(output_text) AS output_sha FROM returned""")
def q_version_store(spark, sf):
    """Every version of every project stored by content, and read back with its texts."""
    store = version_store(spark, sf)
    out = None
    for r in store._read("builds").select("version").distinct().collect():
        rows = store.read(r.version)
        out = rows if out is None else out.unionByName(rows)
    return out.select("project", F.col("version").cast("bigint").alias("version"), "pair_id",
                      F.sha2("input_text", 256).alias("input_sha"), F.sha2("output_text", 256).alias("output_sha"))


@query("version_store_delta", W(ofx.PROJECT_CHUNKS) + RETURNED_SQL + """
SELECT p.pair_id, p.project, p.version::BIGINT AS version, count(*)::BIGINT AS copies FROM returned p
WHERE NOT EXISTS (SELECT 1 FROM returned q WHERE q.project = p.project AND q.version = p.version - 1
                  AND q.input_text = p.input_text AND q.output_text = p.output_text) GROUP BY ALL""")
def q_version_store_delta(spark, sf):
    """J8 from the membership alone."""
    return version_store(spark, sf).delta().select("pair_id", "project", F.col("version").cast("bigint").alias("version"), "copies")


@query("version_store_since", W(ofx.PROJECT_CHUNKS) + RETURNED_SQL + """
SELECT project, version::BIGINT AS version, pair_type, count(*)::BIGINT AS n_pairs FROM returned WHERE version > 2 GROUP BY ALL""")
def q_version_store_since(spark, sf):
    """J7, W7 from the membership alone."""
    rows = version_store(spark, sf).rows(since=2)
    return (rows.groupBy("project", F.col("version").cast("bigint").alias("version"), "pair_type")
            .agg(F.sum("copies").cast("bigint").alias("n_pairs")))


@query("train_eval_split", W(ofx.PROJECT_CHUNKS) + COPIED_SQL + """
SELECT pair_id, CASE WHEN substr(sha256(input_text || chr(0) || output_text), 1, 8) < '1999999a' THEN 'eval' ELSE 'train' END AS split
FROM copied""")
def q_train_eval_split(spark, sf):
    return PR.split_train_eval(copied_pairs(spark, sf)).select("pair_id", "split")


@query("version_history", W(ofx.PROJECT_CHUNKS) + """,
per_type AS (SELECT project, version, pair_type, count(*) AS n FROM project_pairs GROUP BY ALL),
per_v AS (SELECT project, version, sum(n)::BIGINT AS total_pairs,
                 string_agg(pair_type || ':' || n, ',' ORDER BY pair_type) AS pairs_by_type
          FROM per_type GROUP BY ALL)
SELECT project, version::BIGINT AS version, total_pairs, pairs_by_type,
       (total_pairs - coalesce(lag(total_pairs) OVER (PARTITION BY project ORDER BY version), 0))::BIGINT AS growth
FROM per_v""")
def q_version_history(spark, sf):
    h = V.version_history(project_pairs(spark, sf))
    return h.select("project", F.col("version").cast("bigint").alias("version"),
                    F.col("total_pairs").cast("bigint").alias("total_pairs"),
                    F.array_join(F.transform(F.map_entries("pairs_by_type"),
                                             lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))),
                                 ",").alias("pairs_by_type"),
                    F.col("growth").cast("bigint").alias("growth"))


# ---------------------------------------------------------------------------
# model runs
# ---------------------------------------------------------------------------

MODELS_SQL = """
runs AS (SELECT 'src' || (user_id % 20) AS project, 1 + event_id % 12 AS version, event_type AS metric,
                arg_max(value, {'t': ts, 'e': event_id}) AS value, max(ts) AS ts FROM events GROUP BY ALL)"""


@query("latest_model_version", W(MODELS_SQL) + """
SELECT project, max(version)::BIGINT AS latest_version FROM runs GROUP BY project""")
def q_latest_model_version(spark, sf):
    """The newest model of each project."""
    m = V.latest_model_version(fx.model_runs(spark, sf))
    return m.select("project", F.col("latest_version").cast("bigint").alias("latest_version"))


@query("model_history", W(MODELS_SQL) + """,
h AS (SELECT project, version, string_agg(metric || '=' || round(value, 4)::DECIMAL(18,4), ',' ORDER BY metric) AS metrics, max(ts) AS ts FROM runs GROUP BY ALL)
SELECT project, version::BIGINT AS version, metrics, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS created_at,
       row_number() OVER (PARTITION BY project ORDER BY version)::BIGINT AS place FROM h""")
def q_model_history(spark, sf):
    """Each project's models in numeric order with their metrics."""
    h = V.model_history(fx.model_runs(spark, sf))
    shown = F.array_join(F.transform(F.map_entries("metrics"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 4).cast("decimal(18,4)").cast("string"))), ",")
    return h.select("project", F.col("version").cast("bigint").alias("version"), shown.alias("metrics"),
                    F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"), F.col("place").cast("bigint").alias("place"))
