import hashlib
import random

from corpusflow.llm import warc


def pages(spark, rows, parts=3):
    return spark.createDataFrame(rows, "page_id long, url string, html string, shard int").repartition(parts)


def rows():
    rnd = random.Random(3)
    out = [(k, f"http://h/{k}", "".join(rnd.choice("abcdefé<>\n") for _ in range(rnd.randrange(3000))), 1) for k in range(120)]
    big = "same payload " * 20
    return out + [(200, "u", big, 1), (150, None, big, 1), (201, "a\r\nb c", big, 1), (202, "", "short", 1), (203, "x", "short", 1),
                  (204, "n", None, 1), (None, "z", big, 1), (150, "again", big, 1), (205, "n2", None, 1), (206, "long", "q" * 200_000, 1)]


def want(rs):
    least = {}
    for i, _, h, _ in rs:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    done, out = set(), []
    for i, _, h, _ in sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (h or "").encode()
        again = len(data) >= 100 and (i != least[h or ""] or h in done)
        if i == least.get(h or ""):
            done.add(h)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", least[h or ""] if again else None))
    return sorted(out, key=str)


def test_round_trip_and_revisits(spark):
    root = warc.fresh_root(spark)
    manifest = warc.write(pages(spark, rows()), root, shard_bytes=20_000, file_bytes=8_000)
    assert manifest.count() > 10 and manifest.agg({"seq": "max"}).first()[0] > 0
    got = warc.read(spark, root)
    assert sorted((tuple(r[:5]) for r in got.collect()), key=str) == want(rows())
    assert got.filter("url is null").count() == 0


def test_same_bytes_whatever_the_partitions(spark):
    found = []
    for parts in (1, 5):
        m = warc.write(pages(spark, rows(), parts), warc.fresh_root(spark), shard_bytes=50_000, file_bytes=20_000)
        found.append(sorted((r.name, r.sha256) for r in m.collect()))
    assert found[0] == found[1]


def test_commit_can_be_repeated_and_drops_lost_attempts(spark, tmp_path):
    import pyarrow as pa
    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary" / "t1").write_bytes(b"data")
    row = pa.RecordBatch.from_pylist([{"temp": f"{tmp_path}/_temporary/t1", "name": "part-1", "file_bytes": 4}])
    commit = warc._committer(str(tmp_path))
    list(commit(iter([row])))
    list(commit(iter([row])))
    assert (tmp_path / "part-1").read_bytes() == b"data"


def test_empty_table(spark):
    root = warc.fresh_root(spark)
    assert warc.write(pages(spark, rows()).limit(0), root).count() == 0
    assert warc.read(spark, root).count() == 0


def test_shards_roll_at_the_default_sizes(spark):
    page = "concat_ws('', transform(sequence(1, 16384), k -> sha2(concat(id, ':', k), 256)))"  # a megabyte that halves
    table = spark.range(0, 90, 1, 6).selectExpr("id as page_id", "'u' as url", f"{page} as html")
    root = warc.fresh_root(spark)
    files = warc.write(table, root).collect()
    most = warc.SHARD_BYTES // warc.FILE_PART
    assert len({f.shard for f in files}) == 3 and all(f.file_bytes <= most for f in files)
    for shard in range(3):
        mine = sorted((f.seq, f.file_bytes) for f in files if f.shard == shard)
        assert len(mine) > 1 and [n for n, _ in mine] == list(range(len(mine))) and mine[0][1] > 0.9 * most


def test_files_grow_with_shards_beyond_the_most(spark, monkeypatch):
    monkeypatch.setattr(warc, "MOST_SHARDS", 2)
    table = spark.range(0, 400, 1, 4).selectExpr("id as page_id", "'u' as url", "concat_ws('', transform(sequence(1, 20), k -> sha2(concat(id, ':', k), 256))) as html")
    files = warc.write(table, warc.fresh_root(spark), shard_bytes=1_000).collect()
    assert len({f.shard for f in files}) <= 4 and all(50_000 < f.file_bytes < 100_000 for f in files if f.seq == 0)


def test_long_files_are_read_in_parts(spark, monkeypatch):
    root = warc.fresh_root(spark)
    manifest = warc.write(pages(spark, rows()), root)
    read, size = warc._reader(root), 7
    monkeypatch.setattr(warc, "READ_ROWS", size)
    import pyarrow as pa
    parts = list(read(iter([pa.RecordBatch.from_pylist([{"name": r.name} for r in manifest.collect()])])))
    assert len(parts) > 10 and max(p.num_rows for p in parts) == size and sum(p.num_rows for p in parts) == len(rows())


def test_whole_pages_come_back(spark):
    page = "concat_ws('', transform(sequence(1, 16384), k -> sha2(concat(id, ':', k), 256)))"
    root = warc.fresh_root(spark)
    warc.write(spark.range(0, 9, 1, 3).selectExpr("id as page_id", "'u' as url", f"{page} as html"), root, shard_bytes=1 << 20)
    got = warc.read(spark, root)
    assert got.select("page_id").distinct().count() == got.filter("payload_bytes = 1048576").count() == 9
