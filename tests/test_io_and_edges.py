"""Sinks and round trips (S4, S7, S9, X30) and edge cases: forced re-index,
unchanged snapshots, empty inputs."""

from pyspark.sql import functions as F

from corpusflow.operators import changes, chunking, packing, tokens
from corpusflow.sources import files
from corpusflow.sources.files import files_from_table


def test_chunks_json_roundtrip(spark, tmp_path):
    src = spark.createDataFrame([("A.java", "class A {\n  int f() { return 1; }\n}")], "p string, c string")
    chunks = chunking.extract_chunks(files_from_table(src, "p", "c"), F.lit("2024-01-01 10:00:00").cast("timestamp"))
    files.write_chunks(chunks, str(tmp_path / "chunks"), fmt="json")
    back = files.read_jsonl(spark, str(tmp_path / "chunks"), chunking.CHUNK_SCHEMA, lenient=False)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, chunks.select(*chunking.CHUNK_COLUMNS).collect()))
    files.write_chunks(chunks, str(tmp_path / "pq"), partition_by=["chunk_type"])
    assert spark.read.parquet(str(tmp_path / "pq")).where("chunk_type = 'method'").count() == 1


def test_training_arrays_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("p", [1, 2], [1, 1], [-100, 2], 2, 5)],
                               "pair_id string, input_ids array<int>, attention_mask array<int>, labels array<int>, "
                               "token_count int, original_length int")
    tokens.write_tokenized(df, str(tmp_path / "train"))
    tokens.write_tokenized(df, str(tmp_path / "eval"))
    tr, ev = tokens.read_training_arrays(spark, str(tmp_path / "train"), str(tmp_path / "eval"))
    assert tr.columns == ["input_ids", "attention_mask", "labels"] and ev.first().labels == [-100, 2]
    tokens.write_tokenized(df, str(tmp_path / "jsonl"), fmt="json")   # JSON Lines, as the reference writes
    tj, none = tokens.read_training_arrays(spark, str(tmp_path / "jsonl"), fmt="json")
    assert none is None and tj.first().input_ids == [1, 2]


def test_append_event(spark, tmp_path):
    path = str(tmp_path / "events")
    ev = spark.createDataFrame([("p", "index", "done")], "project string, phase string, status string")
    files.append_event(ev, path)
    files.append_event(ev.withColumn("phase", F.lit("dataset")), path)
    got = spark.read.parquet(path)
    assert got.count() == 2 and "ts" in got.columns


def test_force_and_unchanged_snapshot(spark):
    cur = spark.createDataFrame([("a", "1"), ("b", "2")], "rel_path string, file_sha string")
    state = spark.createDataFrame([("a", "1"), ("b", "2")], "rel_path string, file_sha string")
    d = {r.rel_path: r.change for r in changes.diff_snapshots(cur, state).collect()}
    assert d == {"a": "unchanged", "b": "unchanged"}
    assert changes.changed_only(cur, state).count() == 0
    forced = {r.rel_path: r.change for r in changes.diff_snapshots(cur, state, force=True).collect()}
    assert forced == {"a": "new", "b": "new"}
    stats = changes.index_stats(changes.diff_snapshots(cur, state),
                                spark.createDataFrame([], "file_path string")).first()
    assert (stats.total_files, stats.processed_files, stats.total_chunks) == (2, 0, 0)


def test_empty_inputs(spark):
    tok = spark.createDataFrame([], "pair_id string, input_ids array<int>, attention_mask array<int>, "
                                "labels array<int>, token_count int")
    s = tokens.token_stats(tok).first()
    assert (s.total_pairs, s.total_tokens, s.avg_tokens_per_pair, s.max_tokens) == (0, 0, 0.0, 0)
    packed = packing.pack_batches(tok)
    assert packed.count() == 0
    b = packing.batch_stats(packed).first()
    assert (b.total_batches, b.avg_batch_size) == (0, 0.0)
    empty_files = spark.createDataFrame([], "rel_path string, ext string, content string")
    assert chunking.extract_chunks(empty_files).count() == 0
