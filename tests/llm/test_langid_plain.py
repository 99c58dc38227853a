"""Language identification against dictionaries of n-grams: the same learned sets, counts within the
filter's error, the same decisions wherever the counts are not close."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corpusflow.llm import langid


def grams(text):
    """(length, n-gram) at every place that lies in one word; a border of it may stand at either end."""
    low = "\0" + "".join(c if c.isalpha() else "\0" for c in (text or "").lower())
    s = low + "\0" * 3
    return [(n, s[i:i + n]) for i in range(len(low)) for n in langid.LENGTHS if "\0" not in s[i + 1:i + n - 1]]


def learned(rows):
    """Language -> its n-grams, by the two thresholds."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        for n, g in grams(text):
            counts[n, g][lang] += 1
            totals[lang, n] += 1
    out = defaultdict(set)
    for (n, g), by in counts.items():
        rate = {lang: c / totals[lang, n] for lang, c in by.items()}
        for lang, r in rate.items():
            if r >= langid.MIN_SHARE and r >= langid.MIN_RATIO * max(rate.values()):
                out[lang].add((n, g))
    return out


def test_same_as_dictionaries(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train = docs.filter(~langid.held_out())
    known = learned([(r.text, r.lang) for r in train.collect() if r.text is not None and r.lang is not None])
    model = langid.fit(train)
    assert model.langs == sorted(known)
    rows = docs.orderBy("doc_id").collect()
    found, total, _ = model.find([r.text for r in rows])
    answers, checked, close = model.decide([r.text for r in rows])[0], 0, 0
    for k, r in enumerate(rows):
        mine = grams(r.text)
        assert total[k] == len(mine)
        exact = [sum(g in known[lang] for g in mine) for lang in model.langs]
        raw = found[k] * (1 - model.false) + total[k] * model.false
        for j in range(len(exact)):
            if found[k][j] > 0:
                assert raw[j] >= exact[j] - 1e-6          # a filter finds all that was learned
            close += abs(found[k][j] - exact[j]) <= 0.02 * total[k] + 3
        best, second = sorted(exact)[-1], sorted(exact)[-2]
        if best - second > 0.1 * max(1, total[k]):
            checked += 1
            assert answers[k] == model.langs[exact.index(best)]
    assert checked > 0.9 * len(rows) and close > 0.98 * len(rows) * len(model.langs)


def test_low_shares_of_training_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    shares = langid.low_shares(docs, model, quantile=0.5)
    assert set(shares) == set(model.langs) and all(0.5 < s <= 1 for s in shares.values())
    assert langid.low_shares(docs.limit(0), model) == {}
    assert docs.select(langid.letters(F.lit("aé1 ß!")).alias("n")).first().n == 3


def test_thresholds_come_from_all_rows(spark):
    """4,000 rows of one language, one of them short of known n-grams: each counts, none is drawn."""
    rows = [(k, f"the old house stands near the river and the people walk there every morning {k} times", "en") for k in range(4000)]
    odd = [(9000 + k, "zq xj kv wq " * 30 + f"the {k}", "en") for k in range(60)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(docs, sample=None)
    found = langid.identify(docs, model, out=("_pred", "_score", "_known"))
    shares = sorted(r._known for r in found.filter(langid.letters(F.col("text")) >= langid.ENOUGH_LETTERS).collect())
    assert len(shares) == 4060
    want = {q: shares[max(0, -(-len(shares) * q // 10_000) - 1)] for q in (1, 100, 147, 149, 5000)}
    for q, share in want.items():
        assert langid.low_shares(docs, model, q / 10_000)["en"] == share
        assert langid.low_shares(found.withColumn("_n", langid.letters(F.col("text"))), model, q / 10_000, ("_known", "_n"))["en"] == share


def test_whole_fit_counts_every_row(spark):
    """An n-gram of one row in 4,000 is in the counts of the whole fit, with its own rate."""
    rows = [(f"river house {k % 7}", "en") for k in range(4000)] + [("qxzv " * 20, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    model = langid.fit(docs, sample=None, min_share=1e-4)
    assert model.decide(["qxzv qxzv"])[2][0] == 1
