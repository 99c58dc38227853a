"""Language, quality and fingerprints: held-out accuracy and stated invariants."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import langid, parsing, quality

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.filter(~langid.held_out()))
    got = langid.identify(docs, model).filter(langid.held_out())
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.98
    assert got.filter("score < 0 or score > 1").count() == 0


def test_filter_finds_every_learned_gram_and_corrects_for_others(spark):
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de")] * 9)],
                                 "doc_id long, text string, lang string")
    model = langid.fit(docs)
    counts, total, _ = model.find(["the house and the garden", "zzqqzz xxyyxx", None, "123"])
    assert counts[0, model.langs.index("en")] == pytest.approx(total[0], rel=0.02)
    assert counts[1].max() < 2 and total[2] == total[3] == 0
    assert model.decide([None, "", "12 !", "zzqq"])[0][:3] == ["und"] * 3


def test_long_texts_are_read_whole(monkeypatch, spark):
    docs = spark.createDataFrame([(0, "alpha beta gamma", "a"), (1, "uno dos tres", "b")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    text = "alpha beta " * 40 + "uno dos tres " * 200
    whole = model.find([text, "alpha"])
    monkeypatch.setattr(langid, "WINDOW", 37)
    cut = model.find([text, "alpha"])
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_language_on_odd_rows(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    got = {r.doc_id: r for r in langid.identify(odd_docs, model).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == got[9].lang_pred == "und"
    assert got[10].lang_pred == "de" and got[7].lang_pred == "en"
    none = langid.fit(no_docs)
    assert {r.lang_pred for r in langid.identify(odd_docs, none).collect()} == {"und"}
    assert langid.identify(no_docs, model).count() == 0


def test_quality_and_toxicity_of_unseen_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.filter("doc_id % 3 <> 0")
    got = quality.classify(docs, seen).join(labels.filter("doc_id % 3 = 0"), "doc_id")
    q, t = got.agg(F.avg(((F.col("p_quality") >= 0.5) == (F.col("quality") == 1)).cast("int")), F.avg(((F.col("p_toxic") >= 0.5) == (F.col("toxic") == 1)).cast("int"))).first()
    assert q > 0.97 and t > 0.9
    clean = got.filter("quality = 1 and toxic = 0")
    assert clean.filter("kept").count() >= 0.98 * clean.count()


def test_sparse_sites_are_shrunk(spark):
    rows = [(k, f"=h{k % 4}", "=p", 4.0 if k % 4 == 0 else -4.0, -3.0) for k in range(400)] + [(1000, "=rare", "=p", -4.0, -3.0)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, host string, path string, quality double, toxic double")).collect()}
    assert got[0].host_quality > 0.9 > 0.1 > got[1].host_quality
    assert got[1].host_quality < got[1000].host_quality < 0.27  # one document moves it little from the mean of a quarter


def test_quality_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (2, None, 1), (None, 1, 1), (99, 0, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd_docs.withColumn("quality", F.lit("x")), labels)
    assert got.count() == odd_docs.count() and got.filter("kept is null").count() == 0
    assert quality.classify(no_docs, labels).count() == 0
    assert quality.classify(odd_docs, labels.limit(0)).count() == odd_docs.count()


def test_host_and_path(spark):
    urls = [("http://a.B.c:80/x/y?z", "a.b.c", "/x"), ("https://u:p@h/", "h", "/"), ("nothing", None, None), (None, None, None)]
    rows = quality.host_and_path(spark.createDataFrame([(u,) for u, _, _ in urls], "url string")).collect()
    assert [(r.host, r.path) for r in rows] == [(h, p) for _, h, p in urls]


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 8))) for _ in range(n))


def test_equal_substrings_share_interior_phrases():
    rnd = random.Random(2)
    body = words(rnd, 300)
    (names, bounds), = [parsing.phrases([body, words(rnd, 7) + body + words(rnd, 9)])[-1]]
    one, two = set(names[bounds[0]:bounds[1]].tolist()), set(names[bounds[1]:bounds[2]].tolist())
    assert len(one - two) <= 6 < 40 < len(one)


def test_sketches_do_not_depend_on_the_batch():
    rnd = random.Random(3)
    texts = [words(rnd, k) for k in (1, 2, 5, 40, 300)] + ["", "a", "aa", "a" * 500, "ab" * 300, "\U0001F600\n" * 9]
    together = [parsing.as_text(s) for s in parsing.sketches(texts)]
    assert together == [parsing.as_text(parsing.sketches([t])[0]) for t in texts]
    assert len(set(together)) == len(texts)
    a = parsing.sketches([texts[4], texts[4] + " more", texts[3], ""])
    assert parsing.likeness(a[0], a[0]) == 1 == parsing.likeness(a[3], a[3]) and parsing.likeness(a[0], a[3]) == 0
    assert parsing.likeness(a[0], a[1]) > 0.85 > 0.2 > parsing.likeness(a[0], a[2])


def successors(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    return zip(order, order[1:] + order[:1], strict=True)


@pytest.mark.parametrize("size", [10_000_000, 900])
def test_edited_texts_in_any_ranges(spark, size):
    rnd = random.Random(4)
    rows = [(k * k, words(rnd, rnd.randrange(60))) for k in range(60)] + [(4, "again"), (4, None), (None, "no number"), (7, "é\U0001F600x")]
    got = sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in parsing.fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size).collect())
    want = []
    for (i, t), (_, nxt) in successors(rows):
        t, nxt = t or "", nxt or ""
        edited = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        want.append(str((i, len(t), hashlib.sha256(edited.encode()).hexdigest())))
    assert got == sorted(want)


def test_fingerprints_on_odd_rows(spark, odd_docs, no_docs):
    got = parsing.fingerprint(odd_docs).collect()
    assert len(got) == odd_docs.count() and len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert parsing.fingerprint(no_docs).count() == 0
    alone = parsing.fingerprint(odd_docs.filter("doc_id = 10")).first()
    assert alone.near_next == 1
