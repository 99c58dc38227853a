"""Metadata patterns: comments, literals, fences and other declarations."""

import random

from pyspark.sql import functions as F

from corpusflow.functions import describe
from corpusflow.operators import chunking
from corpusflow.operators import metadata as M
from corpusflow.plans import queries_meta

JAVA = '''// this class does nothing
package a . b.c; import x.y.Z; import static p.Q.*;
/* class Hidden {} import no.no.No; */
public final class One<T> extends Two { String s = "class Text { import t.T; }"; Object k = One.class; char c = '"'; }
interface Three { } enum Four { A } record Five(int x) { }
@interface Six { }
'''


def one(spark, cols, text):
    return spark.createDataFrame([(text,)], "content string").select(*[c.alias(n) for n, c in cols.items()]).first()


def test_java(spark):
    r = one(spark, M.java_metadata(F.col("content")), JAVA)
    assert r["package"] == "a.b.c" and r["imports"] == ["x.y.Z", "p.Q.*"]
    assert r["classes"] == ["One", "Three", "Four", "Five", "Six"]
    assert r["description"] == "Java file in package a.b.c containing classes: One, Three, Four, Five, Six"


def test_java_without_anything(spark):
    r = one(spark, M.java_metadata(F.col("content")), "")
    assert r["package"] is None and r["classes"] == [] and r["description"] == "Java file"


def test_markdown(spark):
    r = one(spark, M.markdown_metadata(F.col("content")), "# A\n#no\n```\n# code\n```\n## B  \n####### seven\n   ### C\n")
    assert r["headings"] == ["A", "B", "C"] and r["has_code_blocks"]


def test_yaml(spark):
    r = one(spark, M.yaml_metadata(F.col("content")), "---\nname: x\n# c: d\n  inner: 1\n'quoted': 2\na-b.c:\nurl:http\n- item: 3\nname: again\n")
    assert r["top_level_keys"] == ["a-b.c", "name", "quoted"]


def test_javadoc_keeps_inner_stars(spark):
    raw = "/**\n * Says 2 * 3.\n * @see a.*\n */"
    got = spark.createDataFrame([(raw,)], "t string").select(describe.clean_javadoc(F.col("t"))).first()[0]
    assert got == "Says 2 * 3.\n  @see a.*"


def test_file_metadata_runs_each_pattern_once_and_equals_the_handlers(spark):
    texts = {"A.java": JAVA, "b.md": "# A\n```\n# code\n```\n## B\n", "c.yml": "name: x\nother:\n", "d.txt": "class X {}", "E.java": "", "f.md": ""}
    df = spark.createDataFrame([(p, t) for p, t in texts.items()], "rel_path string, content string")
    got = {r.rel_path: r for r in M.file_metadata(df).collect()}
    for path, h in (("A.java", M.java_metadata), ("E.java", M.java_metadata), ("b.md", M.markdown_metadata), ("f.md", M.markdown_metadata), ("c.yml", M.yaml_metadata)):
        want = one(spark, h(F.col("content")), texts[path])
        assert (got[path].description, got[path].file_type, got[path].lines) == (want["description"], want["file_type"], want["lines"])
    assert got["d.txt"].handler is None and got["d.txt"].description is None
    stored = df.repartition(2)  # a plan that the optimizer cannot evaluate in place
    plan = M.file_metadata(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|//[^") == 1 and plan.count("`{3}[^") <= 2


def test_java_texts_are_cleaned_once_and_patterns_find_what_they_did(spark):
    """The query's comments are blanked once a file; a look at the next character changes no match."""
    plan = queries_meta.q_java_metadata(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count('"{3}.*?') == 1
    name, qualified = M.JAVA_NAME, M.JAVA_QUALIFIED
    plain = [(M.JAVA_OPAQUE, r"""(?s)"{3}.*?"{3}|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|/\*.*?\*/|//[^\n]*"""),
             (M.JAVA_PACKAGE, r"(?m)(?:^|(?<=;))\s*package\s+(" + qualified + r")\s*;"),
             (M.JAVA_IMPORT, r"(?m)(?:^|(?<=;))\s*import\s+(?:static\s+)?(" + qualified + r"(?:\s*\.\s*\*)?)\s*;"),
             (M.JAVA_TYPE, r"(?<![\p{L}\p{N}_$.])(?:class|interface|enum|record)\s+(" + name + r")(?=\s*[<({]|\s+(?:extends|implements|permits)\b)")]
    rng = random.Random(3)
    bits = ["import ", "package ", "a.b", ";", "\n", "  ", "\r\n", "class A", " {", "enum E(", "static ", ".class", "record R<", "'", '"', '"""', "\\", "/*", "*/", "//", "/", "é", "\x85", "xclass B {", "interface I extends "]
    df = spark.createDataFrame([("".join(rng.choice(bits) for _ in range(rng.randrange(30))),) for _ in range(1500)], "t string")
    for now, before in plain:
        assert df.where(F.regexp_replace("t", now, "#") != F.regexp_replace("t", before, "#")).count() == 0
    lines = df.select("t", chunking.line_count(F.col("t")).alias("n")).collect()
    assert all(r.n == r.t.count("\n") + 1 for r in lines)
