"""Content-addressed versions; deduplication; model history; the summary's run and status map."""

import os

from pyspark.sql import functions as F

from corpusflow.operators import ledger as L
from corpusflow.operators import pairs as PR
from corpusflow.operators import versions as V
from corpusflow.operators.version_store import VersionStore
from corpusflow.streaming.jobs import scratch_dir
from tests.test_ledger import ten_created

DDL = "project string, pair_id string, pair_type string, input_text string, output_text string"


def test_versions_are_stored_by_content(spark):
    path = scratch_dir(spark, "t-versions")
    store = VersionStore(spark, path)
    long = "x" * 5000
    one = [("p", f"i{k}", "qa", f"{long}{k}", "out") for k in range(40)] + [("q", "i1", "qa", "other", None), ("q", "i1", "qa", "other", None)]
    builds = {1: one, 2: [r for r in one if r[1] != "i3"] + [("p", "new", "qa", "n", "o"), ("p", "renamed", "qa", f"{long}7", "out")],
              3: [r for r in one if r[0] == "p"], 5: [("q", "i1", "qa", None, "other")]}
    sizes = {}
    for v, rows in builds.items():
        df = spark.createDataFrame(rows, DDL)
        for _ in range(2):
            store.add(df, v)
        root = path.removeprefix("file:")
        sizes[v] = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet") and f"version={v}" in d)
        key = lambda r: tuple(map(str, r))
        got = [tuple(r)[:5] for r in store.read(v).collect()]
        assert sorted(got, key=key) == sorted(rows, key=key), v
    assert store._read("contents").groupBy("ck").count().where("count > 1").count() == 0
    delta = {(r.project, r.version, r.pair_id) for r in store.delta().collect() if r.version > 1}
    assert delta == {("p", 2, "new"), ("p", 3, "i3"), ("q", 5, "i1")}      # renamed has known texts, i3 came back
    spans = {(r.first, r.until) for r in store.intervals().where("pair_id = 'i3'").collect()}
    assert spans == {(1, 2), (3, None)}
    assert {(r.project, r.version): r.n_pairs for r in store.history().where("version > 1").collect()} == {("p", 2): 41, ("q", 2): 2, ("p", 3): 40, ("q", 5): 1}
    plan = store.delta()._jdf.queryExecution().toString()
    assert "contents" not in plan and "input_text" not in plan               # no text is read
    assert sizes[3] < sizes[1]


def test_dedupe_is_normalised_and_null_safe(spark):
    rows = [("b", "x", "y"), ("a", " X", "Y "), ("a", " X", "Y "), ("z", None, "z"), ("y", "z", None), ("c", "", ""), ("d", None, None), (None, "x", "y"), ("e", "xy", "")]
    got = PR.dedupe_pairs(spark.createDataFrame(rows, "pair_id string, input_text string, output_text string")).collect()
    assert sorted(r.pair_id for r in got) == ["a", "c", "d", "e", "y", "z"]


def test_model_history_is_numeric(spark):
    rows = [("p", "v9", "loss", 0.5, "2024-01-01", 1), ("p", "v10", "loss", 0.4, "2024-01-02", 1), ("p", "v10", "loss", 0.3, "2024-01-02", 2),
            ("p", "v10", "acc", 0.9, "2024-01-02", 1), ("p", "best", "loss", 0.1, "2024-01-09", 1), ("q", "draft", None, None, "2024-01-01", 1)]
    runs = spark.createDataFrame(rows, "project string, tag string, metric string, value double, created_at string, seq long")
    assert {r.project: r.latest_version for r in V.latest_model_version(runs).collect()} == {"p": 10, "q": 0}
    assert [(r.version, r.metrics, r.place) for r in V.model_history(runs).orderBy("place").collect()] == [(9, {"loss": 0.5}, 1), (10, {"acc": 0.9, "loss": 0.3}, 2)]


def test_summary_counts_every_status_and_names_the_run(spark):
    ledger = ten_created(spark).withColumn("status", F.when(F.col("svn_revision") == 10, "skipped").otherwise(F.col("status")))
    runs = spark.createDataFrame([(1, "2024-01-01", "a"), (2, "2024-01-03", "b"), (3, "2024-01-03", "c")], "run_id long, last_update_time string, svn_url string")
    s = L.migration_summary(ledger, runs).first()
    assert (s.skipped, s.total_revisions, sum(s.status_counts.values()), s.metadata.run_id) == (1, 10, 10, 3)
    assert s.status_counts["skipped"] == 1
    empty = L.migration_summary(ledger.limit(0), runs.limit(0)).first()
    assert empty.metadata is None and empty.status_counts == {} and empty.total_revisions == 0
