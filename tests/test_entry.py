"""Driver contract: entry() runs; every registered query has a callable; a
sample of queries matches its DuckDB oracle at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["total_files"] > 0


def test_registry_shape():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert qs and set(sql) <= set(qs)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", ["java_chunks", "training_pairs", "ledger_apply", "snapshot_diff",
                                 "tokenize_pairs", "pack_batches", "retrieve_topk", "file_metadata",
                                 "stream_ledger", "corpus_report"])
def test_oracle_sample(spark, duck, key):
    got = digest(entry.queries()[key](spark, SF).toPandas())
    want = digest(duck.execute(entry.oracle_sql()[key]).fetchdf())
    assert got[:3] == want[:3]
