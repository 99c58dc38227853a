"""The pipeline against a plain version, over a whole small table and over odd rows."""

import hashlib
import math
import re
from collections import defaultdict

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from corpusflow.llm import langid, secrets
from corpusflow.llm.common import keep_as_table

from . import brute
from .test_mixing import water
from .test_secrets import ASSIGN

SF = "/root/testdata/sf0.001"


def masked(text):
    """Base secrets replaced, kind after kind."""
    text = ASSIGN.sub(lambda m: secrets.MASK if len(m[2]) >= 6 else m[0], text)
    text = re.sub("AKIA[A-Z0-9]+", lambda m: secrets.MASK if len(m[0]) >= 20 else m[0], text)
    return re.sub("[0-9a-f]+", lambda m: secrets.MASK if len(m[0]) >= 24 else m[0], text)


def copies(rows):
    """(doc_id, source, text) -> how often the mix takes each."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, _, t in rows}
    total = defaultdict(int)
    for i, s, _ in rows:
        total[s] += size[i]
    names = sorted(total)
    target = water(total, {s: k % 3 + 1 for k, s in enumerate(names)})
    out = {}
    for s in names:
        whole = math.floor(target[s] / total[s])
        need, upto = target[s] - whole * total[s], 0
        for i in sorted((i for i, x, _ in rows if x == s), key=lambda i: hashlib.md5(f"mix-1:{i}".encode()).hexdigest()):
            upto += size[i]
            out[i] = whole + (upto - size[i] / 2 <= need)
    return out


def test_whole_run_equals_plain_version(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if any(c.isalpha() for c in r.text or "")]
    kept = {i for i, _, _, stays in brute.near_duplicates([(r.doc_id, r.text) for r in docs], 80) if stays}
    rows = [(r.doc_id, r.source, masked(r.text)) for r in docs if r.doc_id in kept]
    times = copies(rows)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, n, t, tuple(library.encode(t))) for i, _, t in rows for n in [len(t)] for _ in range(times[i]))
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids"]
    assert sorted((r.doc_id, r.n_chars, r.text, tuple(r.token_ids)) for r in got.collect()) == want


def test_stages_keep_the_columns(spark, odd_docs, no_docs):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for start in (odd_docs, no_docs):
        docs = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = keep_as_table(stage(spark, docs, SF), f"t-{name}")
            assert out.columns == [*docs.columns, *(["token_ids"] if k == len(corpus_pipeline.STAGES) - 1 else [])]
            if start is odd_docs and name == "language":
                # nulls, blanks and digits are in no language, nor is a long row of one letter
                assert {r.doc_id for r in out.collect()} == {1, 2, None, 6, 7, 10, 11, 12}
            docs = out
    assert docs.count() == 0


def test_language_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    gone = docs.join(corpus_pipeline.language(spark, docs, SF).select("doc_id"), "doc_id", "left_anti")
    assert all(not any(c.isalpha() for c in r.text or "") for r in gone.collect())
    assert langid.NONE == "und"


def test_language_rejects_one_that_no_row_is_labelled_with(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    langs = {r.doc_id: r.lang for r in docs.collect()}
    for unlearned in ("de", "es"):
        mixed = docs.withColumn("lang", F.when(F.col("lang") != unlearned, F.col("lang")))
        stay = {r.doc_id for r in corpus_pipeline.language(spark, mixed, SF).select("doc_id").collect()}
        long = {r.doc_id for r in docs.filter(langid.letters(F.col("text")) >= langid.ENOUGH_LETTERS).collect()}
        foreign = {i for i in long if langs[i] == unlearned}
        assert len(foreign & stay) <= 0.02 * len(foreign), unlearned
        assert {i for i in long if langs[i] != unlearned} <= stay
