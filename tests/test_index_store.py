"""Bucketed index: joined in place, only touched buckets rewritten, replays, restarts."""

import os
import re

from pyspark.sql import functions as F

from corpusflow.operators.index_store import IndexStore
from corpusflow.sources.files import files_from_table
from corpusflow.streaming import jobs


def tree(spark, rows):
    return files_from_table(spark.createDataFrame(rows, "p string, c string"), "p", "c")


def stored(path):
    path = path.removeprefix("file:")
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def contents(store):
    chunks = {(r.file_path, r.checksum) for r in store.read("chunks").collect()}
    state = {(r.rel_path, r.file_sha, r.chunks_count) for r in store.read("state").collect()}
    return chunks, state


ROWS = [(f"d{k % 7}/f{k}.md", f"text {k}") for k in range(120)]


def test_only_touched_buckets_are_written(spark):
    store = IndexStore(spark, jobs.scratch_dir(spark, "t-index"), buckets=16)
    store.apply(tree(spark, ROWS), 0).unpersist()
    assert len(contents(store)[0]) == 120
    before = stored(store.path)
    second = [(p, c + "!" if p == "d3/f3.md" else c) for p, c in ROWS if p != "d4/f4.md"] + [("new/_x.md", "n")]
    new = store.apply(tree(spark, second), 1)
    assert {r.file_path for r in new.collect()} == {"d3/f3.md", "new/_x.md"}
    new.unpersist()
    chunks, state = contents(store)
    assert {p for p, _ in chunks} == {p for p, _ in second} and {s[0] for s in state} == {p for p, _ in second} and all(s[2] == 1 for s in state)
    after = stored(store.path)
    assert all(after[f] == t for f, t in before.items())                       # untouched files keep their bytes
    assert len({re.search(r"bucket=(\d+)", f)[1] for f in after.keys() - before.keys() if "bucket=" in f}) <= 3
    # the next poll changes nothing and drops what poll 2 replaced
    store.apply(tree(spark, second), 2).unpersist()
    assert contents(store) == (chunks, state)
    gens = {f.split("gen=")[1].split("/")[0] for f in stored(store.path) if "/chunks/" in f}
    assert gens == {"1", "2"} and len(stored(store.path)) < len(after)


def test_replay_and_a_batch_lost_before_its_heads(spark, monkeypatch):
    store = IndexStore(spark, jobs.scratch_dir(spark, "t-index"), buckets=8)
    store.apply(tree(spark, ROWS), 0).unpersist()
    first = contents(store)
    less = tree(spark, ROWS[:50])

    def stop(*a):
        raise RuntimeError("lost")
    write = IndexStore._write
    monkeypatch.setattr(IndexStore, "_write", lambda self, rows, kind, gen: stop() if kind == "state" else write(self, rows, kind, gen))
    try:
        store.apply(less, 1)
        raise AssertionError
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert contents(store) == first
    for _ in range(2):
        store.apply(less, 1).unpersist()
        assert {p for p, _ in contents(store)[0]} == {p for p, _ in ROWS[:50]}
    # another session finds the same index by its path
    assert contents(IndexStore(spark.newSession(), store.path, buckets=8)) == contents(store)
    store.apply(tree(spark, ROWS[:0]), 2).unpersist()
    assert contents(store) == (set(), set())


def test_no_exchange_on_the_index_side(spark):
    store = IndexStore(spark, jobs.scratch_dir(spark, "t-index"), buckets=16)
    store.apply(tree(spark, ROWS), 0).unpersist()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        gone = spark.createDataFrame([("d1/f1.md",)], "file_path string")
        for joined in (store.diff(tree(spark, ROWS)), store.read("chunks").join(gone, "file_path", "left_anti")):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and "Bucketed: true" in plan, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stream_restarts(spark):
    root = jobs.scratch_dir(spark, "t-index-stream")
    polls = [tree(spark, ROWS), tree(spark, ROWS[10:]), tree(spark, ROWS[10:] + [("z.md", "z")])]
    args = (f"{root}/polls", polls[0].schema, f"{root}/ds", f"{root}/ck")
    for n, poll in enumerate(polls):
        jobs.publish_poll(poll.repartition(3), f"{root}/polls", n + 1)
        jobs.stream_reindex_store(IndexStore(spark, f"{root}/index", 8), *args)
    store = IndexStore(spark, f"{root}/index", 8)
    assert {p for p, _ in contents(store)[0]} == {p for p, _ in ROWS[10:]} | {"z.md"}
    per_version = {r.version: r.n for r in spark.read.parquet(f"{root}/ds").groupBy("version").agg(F.count("*").alias("n")).collect()}
    assert per_version == {1: 120, 3: 1}
