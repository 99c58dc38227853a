import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, whitened string, _x int"


def some(n=200, d=6, seed=3):
    rng = np.random.default_rng(seed)
    v = (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.3).tolist()
    v[7], v[8], v[9], v[10] = None, [], [math.nan] + [0.0] * (d - 1), [math.inf] + [0.0] * (d - 1)
    v[11] = [None] + [0.1] * (d - 1)
    for k in range(20, 90):
        v[k] = v[19]
    v[95] = [-0.0] * d
    return [(k, x, "old", 1) for k, x in enumerate(v)]


def plain(rows, k, counted=False):
    good = [(i, x) for i, x, *_ in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    d = max((len(x) for _, x in good), default=0)
    whole = [(i, tuple(math.floor(256 * c) for c in x) + (0,) * (d - len(x))) for i, x in good]
    fit = [x for _, x in whole] if counted else list(dict.fromkeys(x for _, x in whole))
    n, sums = len(fit), [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in whole:
        z = (np.array(x, float) - np.array(sums) / n) @ vectors[:, :k] / np.sqrt(values[:k])
        out[i] = (n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), z, values[:k] / values.sum())
    return out


def test_same_as_plain(spark):
    rows = some()
    want = plain(rows, 4)
    got = whitening.components_of(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 * len(want)
    sign = {}
    for r in got:
        n, dev, z, share = want[r.vec_id]
        c = r.component - 1
        assert (r.n, r.deviation) == (n, dev) and abs(r.explained / share[c] - 1) < 1e-9 and r.identity_error < 1e-9
        assert abs(abs(r.whitened) - abs(z[c])) < 1e-9
        if abs(z[c]) > 1e-6:
            assert sign.setdefault(c, np.sign(r.whitened) * np.sign(z[c])) == np.sign(r.whitened) * np.sign(z[c])


def test_counts_as_weights(spark):
    rows = some()
    want = plain(rows, 3, counted=True)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA), 3, "count").collect()
    assert len(got) == len(want)
    for r in got:
        n, dev, z, share = want[r.vec_id]
        assert (r.n, r.deviation) == (n, dev) and np.allclose(np.abs(r.whitened), np.abs(z), atol=1e-9)
        assert np.allclose(r.explained, share) and r.identity_error < 1e-9 and r._x == 1
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame(rows, SCHEMA), 3, "half")


def test_wide_values_stay_exact(spark):
    rows = [(1, [3e9, 1.0]), (2, [-3e9, 2.0]), (3, [1e9, 5.0]), (4, [1e300, 0.0])]
    small = whitening.whiten(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), 2).collect()
    want = plain([(*r,) for r in rows[:3]], 2)
    for r in small:
        dev = want[r.vec_id][1]
        assert r.deviation == (dev if dev < 2 ** 63 else None)
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2).count() == 4


def test_odd_rows(spark):
    df = spark.createDataFrame(some(), SCHEMA)
    assert whitening.components_of(df.limit(0)).count() == 0
    assert whitening.components_of(df.filter("vec_id in (7, 8, 9)")).count() == 0
    assert whitening.components_of(df.filter("vec_id between 19 and 80")).count() == 0  # one distinct vector
    two = whitening.components_of(df.filter("vec_id in (1, 2)").withColumn("vec_id", F.lit(None).cast("long"))).collect()
    assert len(two) == 2 and {r.component for r in two} == {1} and all(abs(abs(r.whitened) - 1) < 1e-9 for r in two)


def test_cold_join(spark, monkeypatch):
    monkeypatch.setattr(whitening, "HOT", 5)
    rows = some()
    got = whitening.components_of(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 * len(plain(rows, 4))
