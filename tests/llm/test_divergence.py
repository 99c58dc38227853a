import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from corpusflow.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, k):
    """(lang, source, text) -> the contract's rows, group by group."""
    per, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(LOW))
        per[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        mine = [g for g in groups if g[0] == lang]
        total = {g: sum(per[g][t] for t in kept) for g in mine}
        of = {g: {t: 1 + 10**9 * (per[g][t] + 5) // (total[g] + 5 * len(kept)) for t in kept} for g in mine}
        whole = {t: sum(per[g][t] for g in mine) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 5) // (sum(whole.values()) + 5 * len(kept)) for t in kept}
        for g in mine:
            pair = sorted((-sum(abs(of[g][t] - of[h][t]) for t in kept), h[1].encode()) for h in mine if h != g)
            term = sorted((q[t] - of[g][t], t.encode()) for t in kept if per[g][t] and of[g][t] > q[t])[:k]
            out += [(*g, part, item.decode(), -v, r + 1) for part, found in (("pair", pair), ("term", term)) for r, (v, item) in enumerate(found)]
    return sorted(out)


def some_rows(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(9) for b in range(6)] + ["École", "straße", "日本", "\U0001F600x"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", None])
        lean = rng.random() ** 2
        rows.append((lang, source, " ".join(rng.choice(vocabulary[:int(5 + lean * 53)]).title() for _ in range(rng.randrange(12)))))
    return [*rows, ("xx", "only", "no kept term"), ("xx", "two", None), ("en", "empty", None)]


def got(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "lang string, source string, text string, n int, term string")
    return sorted(map(tuple, divergence.audit(df, **kw).collect()))


def test_same_as_plain(spark):
    rows = some_rows(300)
    assert got(spark, rows, least_docs=5, k=6) == plain(rows, 5, 6)


def test_many_tiles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES", 2)
    monkeypatch.setattr(divergence, "TERMS", 7)
    rows = some_rows(260, seed=2)
    assert got(spark, rows, least_docs=3, k=50) == plain(rows, 3, 50)


def test_skyband_keeps_exactly_the_undominated():
    rng = random.Random(5)
    rows = [(f"t{rng.randrange(10**6)}", rng.randrange(1, 60), rng.randrange(60, 200)) for _ in range(900)]
    rows = sorted(set(rows), key=lambda r: (-r[1], r[2], r[0]))
    rows = list({r[0]: r for r in rows}.values())
    rows.sort(key=lambda r: (-r[1], r[2], r[0]))
    batch = lambda part: pa.RecordBatch.from_pydict({"lang": ["l"] * len(part), "source": ["s"] * len(part), "term": [r[0] for r in part], "n": [r[1] for r in part], "ln": [r[2] for r in part]})
    for k in (1, 4, 20):
        kept = [t for b in divergence._skyband(k, 32)(iter([batch(rows[:500]), batch(rows[500:])])) for t in b.column(2).to_pylist()]
        want = [r[0] for r in rows if sum(o[1] >= r[1] and o[2] <= r[2] and o[0] < r[0] for o in rows) < k]
        assert kept == want and len(want) < len(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.lang, r.source, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, divergence.audit(odd_docs.withColumn("zero", F.lit(1)), least_docs=1).collect())) == plain(rows, 1, 50)
    assert divergence.audit(no_docs).count() == 0


def test_rates_are_exact(spark):
    rng = random.Random(9)
    rows = [(0, 1, 1), (7, 0, 0), (10**12, 10**12 + 10**6, 5000), (9 * 10**9, 9 * 10**9, 1), (9 * 10**9 + 1, 10**13, 7)]
    for _ in range(3000):
        total = rng.randrange(1, 10 ** rng.randrange(1, 16))
        rows.append((rng.randrange(total + 1), total, rng.randrange(1, 10 ** rng.randrange(1, 7))))
    df = spark.createDataFrame(rows, "n long, total long, kept long").withColumn("p", divergence._rate(F.col("n"), F.col("total"), F.col("kept")))
    for n, total, kept, p in df.collect():
        assert p == (1 + 10**9 * (n + 5) // (total + 5 * kept) if kept else 0), (n, total, kept)
