"""Fingerprints and quality against plain versions; rows without keys in ranges of their own."""

import math
import random

import numpy as np
import pytest

from corpusflow.llm import parsing, quality, warc

M64 = (1 << 64) - 1


def mix(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M64
    return x ^ x >> 31


def toss(left, own):
    if left == own:
        return 0
    place = ((left ^ own) & -(left ^ own)).bit_length() - 1
    return 2 * place + (own >> place & 1)


def parse(names):
    """One level of one text, symbol by symbol."""
    runs = []
    for s in names:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    symbols = [mix(s ^ (n * 0xD6E8FEB86659FD93 & M64)) if n > 1 else s for s, n in runs]
    labels = [toss(M64 if k == 0 else symbols[k - 1], s) for k, s in enumerate(symbols)]
    for _ in range(3):
        labels = [toss(255 if k == 0 else labels[k - 1], own) for k, own in enumerate(labels)]
    phrases = []
    for k, s in enumerate(symbols):
        right = labels[k + 1] if k + 1 < len(labels) else 255
        if k == 0 or (labels[k] < labels[k - 1] and labels[k] < right):
            phrases.append([])
        phrases[-1].append(s)
    return [mix((sum(mix((s + p * 0x9E3779B97F4A7C15) & M64) for p, s in enumerate(ph)) + len(ph)) & M64) for ph in phrases]


def sketch(text):
    levels, names = [], [mix(ord(c) + 1) for c in text]
    for _ in range(3):
        names = parse(names)
        levels.append(names)
    least = lambda names, k: sorted({n >> 32 for n in names})[:k]
    return least(levels[2], 48), least(levels[1], 16)


def alike(a, b):
    x, y, k = (a[0], b[0], 48) if min(len(a[0]), len(b[0])) >= 8 else (a[1], b[1], 16)
    if not x or not y:
        return float(not x and not y)
    union = sorted({*x, *y})[:k]
    return sum(u in x and u in y for u in union) / len(union)


def as_text(s):
    return ":".join("".join(f"{n:08x}" for n in part) for part in s)


def texts(n=70, seed=11):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé日\U0001F600") for _ in range(rnd.randrange(1, 7)))
    out = ["", "a", "aa", "a" * 700, "ab" * 200, "\n\n"]
    while len(out) < n:
        out.append(" ".join(word() for _ in range(rnd.randrange(120))))
        out.append(out[-1] + " and " + word())
    return out


@pytest.mark.parametrize("size", [10_000_000, 3000])
def test_fingerprints_equal_the_plain_version(spark, size):
    rows = [(k * 3, t) for k, t in enumerate(texts())]
    got = {r.doc_id: r for r in parsing.fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size).collect()}
    order = sorted(rows, reverse=True)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        own, new, nxt = sketch(t), sketch(edited), sketch(after)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (as_text(own), as_text(new))
        assert (got[i].near_edited, got[i].near_next) == (pytest.approx(alike(own, new)), pytest.approx(alike(own, nxt)))


def test_rows_without_a_doc_id_lie_in_several_ranges(spark):
    some = [t for t in texts(90, 5) if t]
    rows = [(None, t) for t in dict.fromkeys(some)] + [(k, t) for k, t in enumerate(some[:20])] + [(None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one, many = (parsing.fingerprint(df, size) for size in (10_000_000, 2500))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, one.collect())) == sorted(map(key, many.collect())) and many.count() == len(rows)
    sizes = [sum(1 for r in part if r.doc_id is None) for part in many.rdd.glom().collect()]
    assert sum(n > 0 for n in sizes) > 3 and max(sizes) < len(some) / 2


def test_pages_without_an_id_lie_in_several_shards(spark):
    rnd = random.Random(8)
    rows = [(None, f"u{k}", "".join(rnd.choice("abcdef") for _ in range(1500))) for k in range(80)] + [(5, "u", "x" * 300), (None, "v", "x" * 300), (None, "v", "x" * 300)]
    root = warc.fresh_root(spark)
    manifest = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), root, shard_bytes=20_000)
    assert manifest.select("shard").distinct().count() > 4 and manifest.agg({"records": "max"}).first()[0] < 40
    got = warc.read(spark, root).collect()
    assert sorted(r.payload_bytes for r in got) == [300] * 3 + [1500] * 80
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got if r.payload_bytes == 300) == [
        ("5", "response", None), ("None", "revisit", 5), ("None", "revisit", 5)]


def sig(x):
    return 1 / (1 + math.exp(-x))


def strength(groups, mean):
    """``groups``: (documents, sum of probabilities, what its mean is shrunk towards)."""
    n = sum(g[0] for g in groups)
    if len(groups) < 2:
        return 100.0
    q = sum(c * (s / c - to) ** 2 for c, s, to in groups)
    between = (q - (len(groups) - 1) * mean * (1 - mean)) / max(1e-9, n - sum(c * c for c, _, _ in groups) / n)
    return min(1e4, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e4


def posteriors(rows, head):
    """(doc_id, host, path, logits ...) -> doc_id -> (posterior, host's, path's), site by site."""
    sites, hosts = {}, {}
    for r in rows:
        for of, key in ((sites, (r[1], r[2])), (hosts, r[1])):
            n, s = of.get(key, (0, 0.0))
            of[key] = (n + 1, s + sig(r[head]))
    mean = sum(s for _, s in hosts.values()) / len(rows)
    a = strength([(n, s, mean) for n, s in hosts.values()], mean)
    of_host = {h: (s + a * mean) / (n + a) for h, (n, s) in hosts.items()}
    b = strength([(n, s, of_host[h]) for (h, _), (n, s) in sites.items()], mean)
    out = {}
    for r in rows:
        (n, s), to = sites[r[1], r[2]], of_host[r[1]]
        others = (s - sig(r[head]) + b * to) / (n - 1 + b)
        p = sig(r[head] + math.log(others / (1 - others)) - math.log(mean / (1 - mean)))
        out[r[0]] = (p, to, (s + b * to) / (n + b))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_posteriors_equal_a_plain_empirical_bayes(spark, seed):
    rnd = random.Random(seed)
    of = {(h, p): rnd.gauss(0, 2) for h in range(9) for p in range(4)}
    rows = []
    for k in range(400):
        h, p = min(8, int(rnd.expovariate(0.6))), rnd.randrange(4)
        rows.append((k, f"=h{h}", f"=p{p}" if p else "null", of[h, p] + rnd.gauss(0, 2), rnd.gauss(-2, 1)))
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, host string, path string, quality double, toxic double").repartition(3)).collect()
    want = [posteriors(rows, 3), posteriors(rows, 4)]
    assert len(got) == len(rows)
    for r in got:
        q, t = (w[r.doc_id] for w in want)
        assert (r.p_quality, r.host_quality, r.path_quality) == pytest.approx(q) and (r.p_toxic, r.host_toxic, r.path_toxic) == pytest.approx(t)
        assert r.kept == (r.p_quality >= 0.5 and r.p_toxic < 0.5)


def test_evidence_equals_a_plain_classifier(spark):
    rnd = random.Random(3)
    words = ["good", "Fine", "bad!", "UGLY", "x1", "été", "the", "of", "a-b", "(none)"]
    docs = [(k, "\n".join(" ".join(rnd.choices(words, k=rnd.randrange(9))) for _ in range(rnd.randrange(6))), f"s{k % 3}", "l") for k in range(120)] + [(500, None, None, "l"), (501, "", "s1", None)]
    odds = {"w good": (0.7, -0.2), "w bad": (-1.1, 0.9), "s A": (-0.3, 0.4), "s a9": (0.2, 0.0), "w été": (0.05, -0.5)}
    rng = np.random.default_rng(5)
    model = quality.Classifier(odds, rng.normal(size=(2, 8)) / 3, rng.normal(size=6) / 5, 0.5 + rng.random(6))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").repartition(3)
    got = {r.doc_id: r for r in quality.evidence(df, model, "source", "lang").collect()}
    for k, text, host, path in docs:
        t = text or ""
        kinds = [sum(c.isascii() and c.isupper() for c in t), sum(c in "0123456789" for c in t), sum(33 <= ord(c) < 127 and not c.isalnum() for c in t)]
        size, tokens, lines = max(1, len(t.encode())), t.split(), [x for x in t.split("\n") if x]
        ratios = [math.log1p(len(tokens)), *[x / size for x in kinds], 1 - len(set(lines)) / max(1, len(lines)), len(set(tokens)) / max(1, len(tokens))]
        has = {f for w in tokens for f in quality._features(w)}
        for h, head in enumerate(quality.HEADS):
            x = [1, sum(o[h] for f, o in odds.items() if f in has), *[(v - m) / s for v, m, s in zip(ratios, model.mean, model.std, strict=True)]]
            assert got[k][head] == pytest.approx(sum(a * b for a, b in zip(x, model.weights[h], strict=True)))
        assert (got[k].host, got[k].path) == ("null" if host is None else "=" + host, "null" if path is None else "=" + path)
