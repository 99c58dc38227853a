"""Registered queries do the whole job: every row of their tables passes through the operator."""

from collections import Counter

import regex
from pyspark.sql import functions as F

from corpusflow.operators import retrieval, tokens, versions
from corpusflow.plans import queries_io as io
from corpusflow.plans import queries_tokens as qt
from corpusflow.plans.queries_corpus import project_pairs
from corpusflow.sources import fixtures as fx

SF_SMALL = "/root/testdata/sf0.001"


def test_all_versions_are_written(spark, monkeypatch):
    paths, write = [], versions.write_dataset_versions
    monkeypatch.setattr(versions, "write_dataset_versions", lambda p, path: (paths.append(path), write(p, path)))
    got = io.q_dataset_version_write(spark, SF_SMALL)
    want = Counter((r.project, r.version, r.pair_id) for r in project_pairs(spark, SF_SMALL).collect())
    assert Counter(map(tuple, got.collect())) == want and len({v for _, v, _ in want}) == 4
    assert len(paths) == 2 and spark.read.parquet(paths[0]).count() == sum(want.values())


def test_no_token_of_a_pair_is_lost(spark):
    pairs = fx.turn_pairs(spark, SF_SMALL).collect()
    count = {r.pair_id: len(regex.findall(tokens.TOKEN_PATTERN, r.input_text + tokens.EXPLANATION_HEADER + r.output_text)) for r in pairs}
    assert max(count.values()) > qt.MAX_LENGTH
    rows = qt.turn_windows(spark, SF_SMALL)
    mine = rows.groupBy("pair_id").agg(F.sum("token_count").alias("n"), F.sum(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)).alias("m"))
    assert {r.pair_id: (r.n, r.m) for r in mine.collect()} == {k: (n, n) for k, n in count.items()}
    stats = qt.q_token_stats(spark, SF_SMALL).first()
    assert (stats.total_pairs, stats.total_tokens, stats.max_tokens) == (len(count), sum(count.values()), max(count.values()))
    assert sum(r.n_tokens for r in qt.q_collate(spark, SF_SMALL).collect()) == sum(count.values())


def test_citations_show_whole_chunks(spark):
    chunks = spark.createDataFrame([("c1", "a.md", "file", "a.md", "x" * 900)],
                                   "chunk_id string, file_path string, chunk_type string, chunk_name string, code_content string")
    topk = spark.createDataFrame([(1, 1, "c1")], "qid long, rank int, chunk_id string")
    shown = [retrieval.citations(topk, chunks, **cut).first().citations[0].context.count("x") for cut in ({}, {"snippet_cut": retrieval.SNIPPET_CUT})]
    assert shown == [900, retrieval.SNIPPET_CUT]
