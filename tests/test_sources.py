"""Sources and sinks: decoding, tree scan, JSON Lines, revision log XML, versions."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.operators import ledger, versions
from corpusflow.sources import files


def test_decode_invalid_utf8_and_crlf(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb\r\nc\rd"),)], "raw binary")
    assert df.select(files.decode_text(F.col("raw")).alias("t")).first()["t"] == "ab\nc\nd"


def test_scan_source_tree(spark, tmp_path):
    for rel, text in [("src/A.java", "class A {}"), (".git/x.java", "no"), ("build/B.java", "no"),
                      ("node_modules/m/c.md", "no"), ("docs/readme.md", "# hi"), ("src/skip.html", "no"),
                      ("a/target/b/t.py", "no"), ("src/.hidden.py", "x = 1")]:
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = {r["rel_path"]: r["ext"] for r in files.scan_source_tree(spark, str(tmp_path)).collect()}
    # hidden files are dropped by Spark's file listing; directories by F1; .html by F2
    assert got == {"src/A.java": ".java", "docs/readme.md": ".md"}


def test_scan_relative_root_under_a_skipped_name(spark, tmp_path, monkeypatch):
    for rel in ("build/proj/src/a.yml", "build/proj/b c.md", "build/proj/build/no.md", "build/proj/d.bin"):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("k: v")
    # Spark resolves a relative path in the folder that its JVM was started in
    here = spark._jvm.java.lang.System.getProperty("user.dir")
    for root in (os.path.relpath(tmp_path / "build" / "proj", here), f"file://{tmp_path}/build/proj/", f"{tmp_path}/build/proj"):
        got = {r["rel_path"]: r["path"] for r in files.scan_source_tree(spark, root).collect()}
        assert set(got) == {"src/a.yml", "b c.md"} and got["b c.md"] == str(tmp_path / "build/proj/b c.md")
    only = files.scan_source_tree(spark, f"{tmp_path}/build/proj", exts=[".bin"])   # a project's own list
    assert [r["rel_path"] for r in only.collect()] == ["d.bin"]


def test_read_jsonl_lenient_and_strict(spark, tmp_path):
    p = tmp_path / "pairs.jsonl"
    p.write_text('{"pair_id": "a", "n": 1}\n\nnot json\n{"pair_id": "b", "n": 2}\n')
    schema = T.StructType([T.StructField("pair_id", T.StringType()), T.StructField("n", T.IntegerType())])
    assert sorted(r["pair_id"] for r in files.read_jsonl(spark, str(p), schema).collect()) == ["a", "b"]
    try:
        files.read_jsonl(spark, str(p), schema, lenient=False).collect()
        raise AssertionError("strict read must fail on a bad line")
    except Exception as e:  # noqa: BLE001
        assert "AssertionError" not in type(e).__name__


def test_read_vcs_log_xml(spark, tmp_path):
    xml = ("<?xml version=\"1.0\"?><log>"
           "<logentry revision=\"3\"><author>ann</author><date>2024-01-03T00:00:00Z</date><msg>three</msg>"
           "<paths><path action=\"M\">/a</path><path action=\"A\">/b</path></paths></logentry>"
           "<logentry revision=\"1\"><date>2024-01-01T00:00:00Z</date><msg></msg></logentry>"
           "</log>")
    (tmp_path / "log.xml").write_text(xml)
    rows = ledger.read_vcs_log(spark, str(tmp_path / "log.xml")).collect()
    assert [(r.revision, r.author, r.message, r.files_changed) for r in rows] == [
        (1, "unknown", "", 0), (3, "ann", "three", 2)]


def test_dataset_versions_roundtrip(spark, tmp_path):
    path = str(tmp_path / "ds")
    pairs = spark.createDataFrame([("p1", "in", "out", "c", "qa")], "pair_id string, input_text string, "
                                  "output_text string, chunk_id string, pair_type string")
    assert versions.next_version(spark, path, "proj") == 1
    versions.write_dataset_version(pairs, path, "proj", 1)
    versions.write_dataset_version(pairs.withColumn("pair_id", F.lit("p2")), path, "proj", 2)
    versions.write_dataset_version(pairs.withColumn("pair_id", F.lit("p2")), path, "proj", 2)   # a retry
    assert spark.read.parquet(path).where("version = 2").count() == 1
    assert versions.next_version(spark, path, "proj") == 3
    table = spark.read.parquet(path)
    cur = versions.read_dataset_version(table, "proj")
    assert [r.pair_id for r in cur.collect()] == ["p2"]
    assert sorted(os.listdir(os.path.join(path, "project=proj"))) == ["version=1", "version=2"]


def test_log_entry_empty_vs_missing_author(spark):
    df = spark.createDataFrame([('<logentry revision="1"><author></author><date>d</date><msg></msg></logentry>',),
                                ('<logentry revision="2"><date>d</date></logentry>',)], "xml string")
    rows = sorted(tuple(r) for r in ledger.parse_log_xml(df).collect())
    assert rows == [(1, "", "d", "", 0), (2, "unknown", "d", "", 0)]   # empty element vs no element


def test_scan_keeps_underscore_folders_and_prunes_before_opening(spark, tmp_path):
    for rel in ("_docs/a.md", "__tests__/x/b.py", "src/_c.java", "node_modules/deep/er/no.md", ".git/no.py", "e.md"):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(rel)
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / "empty").mkdir()
    df = files.scan_source_tree(spark, str(tmp_path))
    assert {r.rel_path: r.content for r in df.collect()} == {k: k for k in ("_docs/a.md", "__tests__/x/b.py", "src/_c.java", "e.md")}
    assert "binaryFile" not in df._jdf.queryExecution().toString()
    listed = {r.rel_path for r in files.list_tree(spark, str(tmp_path)).collect()}
    assert not any(x.startswith(("node_modules", ".git", "loop")) for x in listed)
    kept = {r.rel_path for r in files.scan_source_tree(spark, str(tmp_path), keep_all=True).collect()}
    assert "node_modules/deep/er/no.md" in kept and ".git/no.py" in kept
    assert files.scan_source_tree(spark, str(tmp_path / "empty")).count() == 0


def test_large_contents_come_in_bounded_batches(spark, tmp_path, monkeypatch):
    for k in range(6):
        (tmp_path / f"f{k}.md").write_text("x" * 1000 * k)
    monkeypatch.setattr(files, "BATCH_BYTES", 2500)
    import pyarrow as pa
    batches = list(files._read_files(str(tmp_path), files.open_arrow)(iter([pa.RecordBatch.from_pydict({"rel_path": [f"f{k}.md" for k in range(6)] + ["gone.md"]})])))
    assert sum(b.num_rows for b in batches) == 6 and all(b.num_rows == 1 or b.column(1).nbytes < 3000 for b in batches) and len(batches) > 3
