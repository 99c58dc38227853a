"""chunk_code with a table argument; blocks of files equal single files."""

import random

import pytest

from corpusflow.operators import chunking

JAVA = "class A {\n  /** f */\n  int f(int x) { return \"}\".length(); }\n  A() { }\n}\n"


def test_table_argument(spark):
    chunking.register_chunk_udtf(spark)
    rows = [(f"p{k}/A.java", JAVA.replace("class A", f"class A{k % 3}"), k) for k in range(9)] + [("none.java", None, 0), ("empty.java", "", 1)]
    spark.createDataFrame(rows, "path string, content string, other int").createOrReplaceTempView("tf_files")
    want = sorted((p, k, n, a, b) for p, t, _ in rows if t for k, n, a, b, *_ in chunking.java_spans(t))
    for how in ("", " PARTITION BY path", " PARTITION BY other ORDER BY path", " WITH SINGLE PARTITION"):
        got = spark.sql(f"SELECT * FROM chunk_code(TABLE(tf_files){how})").collect()
        assert sorted((r.path, r.chunk_type, r.chunk_name, r.start_line, r.end_line) for r in got) == want, how
    with pytest.raises(Exception, match="path and content"):
        spark.sql("SELECT * FROM chunk_code(TABLE(SELECT path FROM tf_files))").collect()


def test_unbalanced_files_do_not_reach_into_the_next():
    rng = random.Random(11)
    bits = ["class A ", "{", "}", "(", ")", ";", "\n", "void f", "(int a) ", "/** d */", "/* open", "\"", "'", "A(", "interface B ", "é\U0001F600", "\0"]
    for _ in range(300):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(5)]
        assert chunking.java_block_spans(texts) == [chunking.java_span_offsets(t) for t in texts]


def test_blocks_are_bounded(monkeypatch):
    monkeypatch.setattr(chunking, "BLOCK_CHARS", 10)
    assert list(chunking.file_blocks([4, 4, 4, 30, 1, 0, 9])) == [(0, 2), (2, 3), (3, 4), (4, 7)]
    assert list(chunking.file_blocks([])) == []


class Counted:
    """A pattern that counts what it is asked."""

    def __init__(self, pattern):
        self.pattern, self.asked = pattern, 0

    def fullmatch(self, *args):
        self.asked += 1
        return self.pattern.fullmatch(*args)


def test_heads_are_tried_for_declarations_only(monkeypatch):
    head = Counted(chunking._METHOD_HEAD)
    monkeypatch.setattr(chunking, "_METHOD_HEAD", head)
    body = "if (a > 1) { a = 1; } for (;;) { } while (a) { } " * 20
    found = chunking.java_block_spans(["class A { void f(int a) { " + body + "} }"] * 3)
    assert [[m[1] for m in file] for file in found] == [["A", "f"]] * 3
    assert head.asked == 3


def test_members_are_rows_of_their_own():
    import pyarrow as pa
    texts = [JAVA, None, "", "class B { void f() { } void f(int x) { } }"]
    batch = pa.RecordBatch.from_arrays([pa.array([f"p{k}" for k in range(4)]), pa.array(texts)], names=["rel_path", "content"])
    rows = pa.Table.from_batches(list(chunking._java_members_arrow(True)(iter([batch])))).to_pylist()
    assert [(r["rel_path"], r["chunk_type"], r["chunk_name"], r["nth"]) for r in rows] == [
        ("p0", "file", "file_content", 0), ("p0", "class", "A", 0), ("p0", "method", "f", 0), ("p0", "method", "A", 0), ("p2", "file", "file_content", 0),
        ("p3", "file", "file_content", 0), ("p3", "class", "B", 0), ("p3", "method", "f", 0), ("p3", "method", "f", 1)]
    assert [r["code"] for r in rows if r["chunk_type"] == "file"] == [texts[0], texts[2], texts[3]]


def test_a_lone_short_file_is_walked_without_arrays(monkeypatch):
    """PARTITION BY path hands the function one file at a time: arrays would cost it a millisecond a file."""
    rng = random.Random(7)
    bits = ["class A ", "enum E ", "{", "}", "{", "}", "(", ")", ";", "\n", "void f", "(int a) ", " throws X ", "/** d */", "/* open", "\"", "'", "A(", "A()", ") {", "[]",
            "interface B ", "@X(1) ", "public static int g(int a) {", "if (a) {", "\u3000", "\xa0", "\x1c", "é\U0001F600", "\0", "  ", "class A class C {", "return h() {", "final class D {"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(3000)] + [JAVA, ""]
    want = chunking.java_block_spans(texts)
    assert sum(map(len, want)) > 2000
    monkeypatch.setattr(chunking, "_block_columns", None)
    assert [chunking.java_span_offsets(t) for t in texts] == want
