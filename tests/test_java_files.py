"""The Java fixture on odd tables: texts joined by blocks equal texts made order by order; one pass over the tables."""

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import chunking
from corpusflow.sources import fixtures

ORDERS = [(None, "1-X"), (0, "1-URGENT"), (5, "2-H"), (5, "3-H"), (7, None), (-5, "4"), (9, "5-L"), (10, "1"), (11, "2"), (12, ""), (13, "1")]
ITEMS = [(None, 1, 1, 1, 1.0, "A"), (0, 3, 1, 2, 1.0, "A"), (0, 3, 2, 1, 1.0, "R"), (0, 3, 1, 1, 1.0, "N"), (0, 3, 1, 1, 1.0, "R"),
         (0, 3, 1, 1, float("nan"), None), (0, 3, 1, None, None, "A"), (5, 4, 4, 4, 4.0, "N"), (5, 2, 2, 2, 2.0, "A"), (7, 1, 1, 1, 1.0, "A"),
         (8, 1, 1, 1, 1.0, "A"), (-5, -4, 1, 1, 1.0, "A"), (9, None, 1, 1, 1.0, "A"), (9, 1, None, 1, 1.0, "A"), (10, None, 1, 1, 1.0, "R"),
         (10, None, 1, 1, 1.0, "A"), (11, None, 1, 1, 1.0, "R"), (11, 6, 1, 1, 1.0, "R")] + [
         (13, j, j % 3, j % 7, -float(j % 5), "RAN"[j % 3]) for j in range(100)]


def pick(values, k):
    place = (k % len(values) if k >= 0 else -(-k % len(values))) + 1     # SQL's remainder, places from 1 or, below 0, from the end
    return values[place - 1 if place > 0 else place]


def method(part, line, flag):
    if part is None or line is None:
        return None
    body = {"R": "System.out.println(a);", "A": "return a;"}.get(flag, "a = a + 1;")
    return (f"    public static {'int' if flag == 'A' else 'void'} {pick(fixtures.METHOD_VERBS, part)}{part}(int a) {{\n"
            f"        if (a > {line}) {{ a = a - 1; }}\n        {body}\n    }}")


def plain():
    last = lambda v: (v is not None, v != v, 0 if v is None or v != v else v)  # noqa: E731  (null first, NaN last)
    out = []
    for key, priority in ORDERS:
        if key is None or priority is None:
            out.append((None, None, None))
            continue
        items = [(*(last(v) for v in (line, part, supp, price)), last(t), t) for k, part, supp, line, price, flag in ITEMS if k == key
                 for t in [method(part, line, flag)]]
        texts = [i[-1] for i in sorted(items, key=lambda i: i[:-1]) if i[-1] is not None]
        cls = f"Order{key}" + pick(fixtures.CLASS_SUFFIXES, key)
        doc = f" /** Handles order {key}. */" if key % 5 == 0 else ""
        content = (f"package com.shop.p{priority[:1]};\n\nimport java.util.List;\nimport com.shop.base.*;\n\npublic class {cls} {{{doc}\n"
                   + ("\n".join(texts) + "\n" if items else "") + "}")
        out.append((f"shop/p{priority[:1]}/{cls}.java", ".java", content))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(ORDERS, "o_orderkey bigint, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(ITEMS, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, "
                                 "l_returnflag string").write.parquet(f"{d}/lineitem.parquet")
    return str(d)


@pytest.mark.parametrize("rows", ["1", "7", "10000"])
def test_files_of_odd_tables(spark, odd, rows):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = [(r.rel_path, r.ext, r.content) for r in fixtures.java_files(spark, odd).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(got, key=str) == plain()


def test_files_are_neither_joined_nor_made_for_other_extensions(spark, odd):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    files = fixtures.java_files(spark, odd)
    assert "Join" not in plan(files) and "collect_list" not in plan(files)
    assert "orders" not in plan(files.where(~F.col("ext").isin([".java"]))) and "MapInArrow" not in plan(files.where(F.col("ext") == ".py"))


def test_a_paths_hash_is_made_once_a_file(spark):
    files = spark.createDataFrame([("a/A.java", "class A { void f() { } void g() { } }")], "rel_path string, content string")
    chunks = chunking.extract_java_chunks(files, F.lit(None).cast("timestamp"))
    plan = chunks.select("chunk_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("md5") and plan.count("md5") == 1


def test_brackets_nested_deeper_than_short_keys():
    deep = ["class A " + "{" * 70000 + "}" * 70000, "class B { void f() { } }"]
    assert [[m[:2] for m in found] for found in chunking.java_block_spans(deep)] == [[("class", "A")], [("class", "B"), ("method", "f")]]
