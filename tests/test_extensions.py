"""User extension surface: extractor and handler registries, custom encoder, SQL table function."""

from pyspark.sql import functions as F

from corpusflow.operators import chunking, metadata, tokens
from corpusflow.sources.files import files_from_table


def test_register_extractor_and_handler(spark):
    def py_extractor(files, extracted_at):
        base = chunking.extract_generic_chunks(files, extracted_at)
        return base.withColumn("chunk_type", F.lit("file")).withColumn("description", F.lit("Python module"))

    saved = chunking.registered_extractors()
    try:
        chunking.register_extractor(".py", py_extractor)
        df = spark.createDataFrame([("m.py", "x = 1"), ("n.md", "# t")], "p string, c string")
        got = {r.file_path: r.description for r in chunking.extract_chunks(files_from_table(df, "p", "c")).collect()}
        assert got == {"m.py": "Python module", "n.md": "File: n.md"}
    finally:
        chunking._EXTRACTORS.clear()
        chunking._EXTRACTORS.update(saved)

    before = list(metadata._HANDLERS)
    try:
        metadata.register_handler("PropsHandler", [".properties"],
                                  lambda c: {"description": F.lit("Properties"), "lines": F.lit(1)})
        df = spark.createDataFrame([("a.properties", "k=v")], "rel_path string, content string")
        r = metadata.file_metadata(df).first()
        assert (r.handler, r.description) == ("PropsHandler", "Properties")
    finally:
        metadata._HANDLERS[:] = before


def test_user_encoder(spark):
    class UpperEncoder:  # defined locally so executors receive it by value
        def encode_batch(self, texts):
            return [None if t is None else [len(w) for w in t.split()] for t in texts]

    df = spark.createDataFrame([("ab c",), (None,)], "t string")
    out = [r.ids for r in tokens.encode_columns(df, {"t": "ids"}, UpperEncoder()).collect()]
    assert sorted(out, key=lambda x: x is None) == [[2, 1], None]


def test_chunk_code_udtf(spark):
    chunking.register_chunk_udtf(spark)
    spark.createDataFrame([("A.java", "class A {\n  int f() { return 1; }\n}")], "path string, content string"
                          ).createOrReplaceTempView("src_files")
    rows = spark.sql("SELECT c.chunk_type, c.chunk_name, c.start_line FROM src_files, "
                     "LATERAL chunk_code(path, content) c ORDER BY c.start_line").collect()
    assert [(r.chunk_type, r.chunk_name, r.start_line) for r in rows] == [("class", "A", 1), ("method", "f", 2)]


def test_user_encoder_is_given_bounded_blocks(spark):
    from corpusflow.operators import tokens as K

    class Widest:
        """Returns how many texts and characters it was given at once; local, so that it travels by value."""

        def encode_batch(self, texts):
            size = sum(len(t) for t in texts if t is not None)
            return [None if t is None else [len(texts), size] for t in texts]

    rows = [(k, "x" * 200_000 if k != 5 else None) for k in range(40)]
    df = spark.createDataFrame(rows, "k long, text string").coalesce(1)
    got = K.encode_columns(df, {"text": "ids"}, Widest(), keep=["k"]).collect()
    assert sorted(r.k for r in got) == list(range(40)) and [r.k for r in got if r.ids is None] == [5]
    assert max(r.ids[1] for r in got if r.ids is not None) <= K.ENCODE_BYTES
