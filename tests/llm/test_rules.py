import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow.llm import rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """n_words and the contract's base counts, word by word."""
    text = text or ""
    w = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    often = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if often[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(rules.SYMBOLS, text)), dup, len(covered)


def checked(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in rules.judge(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        n, *base = plain(t)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *base), t
        assert r.base_failed == (n < 50 or 100 * base[3] > 50 * n)
        assert r.kept == (not r.base_failed and not r.failed)
    return got


def test_counts_by_hand(spark):
    checked(spark, [None, "", " \t\n", "one", "a b", "a b c", "a b c a b c", "a a a a", "a a a a a b a a a", "x\ny\nx\n\n \nx",
                    "# $a |\x0bb\x0c<c>\r&", "é日 \U0001F600 ß x  y", "a b c d a b c e b c d", "A b c a b c"])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "é", "a b", "\n", "#x", "\t", ""]), max_size=40).map(" ".join), min_size=30, max_size=30))
def test_counts_property(spark, texts):
    checked(spark, texts)


def test_each_rule(spark):
    good = [f"word{k}" if k % 3 else "the" for k in range(120)]
    cases = {
        "good": " ".join(good), "word_length": " ".join(["the"] * 1 + [f"incomprehensibilities{k}" for k in range(90)] + ["of", "and"]),
        "symbols": " ".join(w + "#" * (k % 4 == 0) for k, w in enumerate(good)),
        "letters": " ".join(w if k % 2 else str(k) * 4 for k, w in enumerate(good)),
        "stop_words": " ".join(f"word{k}" for k in range(120)),
        "repeated_lines": "\n".join(" ".join(good[k:k + 12]) for k in range(0, 120, 12)) + "\nsame line" * 6,
        "bullet_lines": "\n".join("- " + " ".join(good[k:k + 12]) for k in range(0, 120, 12)),
        "ellipsis_lines": "\n".join(" ".join(good[k:k + 12]) + " ..." for k in range(0, 120, 12)),
    }
    got = checked(spark, list(cases.values()))
    for k, name in enumerate(cases):
        assert got[k].failed == ([] if name == "good" else [name]), (name, got[k])
        assert not got[k].base_failed


def test_table_from_dataframe(spark):
    t = spark.createDataFrame([("short", "word_chars", "n_words", None, 400)], "name string, value string, base string, least int, most int")
    docs = spark.createDataFrame([(1, " ".join(f"abc{k % 10}" for k in range(60)) , "x"), (2, " ".join(f"w{k}" for k in range(60)), "y")], "doc_id long, text string, _q_n_words string")
    table = rules.rules_of(t)
    assert table == (rules.Rule("short", "word_chars", "n_words", None, 400),)
    kept = rules.keep(docs, table)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
    with pytest.raises(ValueError):
        rules.compiled((rules.Rule("x", "nothing", "n_words", 1, None),))
    with pytest.raises(ValueError):
        rules.rules_of(t.unionAll(t), most=1)


def test_odd_rows(odd_docs, no_docs):
    assert rules.judge(odd_docs).count() == odd_docs.count() and rules.judge(no_docs).count() == 0
    clash = odd_docs.withColumn("_words", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("failed", F.lit(3))
    assert rules.keep(clash).columns == clash.columns
    assert {r.doc_id for r in rules.keep(clash).collect()} <= {6, 7}
    assert rules.keep(no_docs).count() == 0
