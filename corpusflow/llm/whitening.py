"""Embedding whitening by weighted multiplicity covariance.

Vectors are quantised to whole numbers (``floor(256 * entry)``), so that equal vectors are equal
bit by bit. Identical ones are grouped once; each distinct vector enters the fit with its number of
copies (``weights="count"``) or with one (``weights="one"``). Tasks subtract the mean and multiply
(one matrix product a batch); the partial products, one matrix a task, are summed by Spark,
and only the covariance itself (dimension x dimension) is decomposed on the driver. Every distinct
vector is whitened once and joined back to the rows that hold it.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped; vectors shorter than
the longest are filled up with zeros; entries beyond 64 bits after scaling are held at the ends of the range;
null and repeated ids are rows of their own; components whose eigenvalue is not above ``TINY`` of the trace
(constant or dependent entries) are not returned, so a table of one distinct vector gives no row; a deviation beyond 64 bits is null; an
empty table gives an empty result; other columns are ignored by the query and returned by ``whiten``.

Scale: one shuffle groups the vectors (a vector held by a third of all rows is combined before it)
and one joins the rows back. Vectors held by more than a ``HOT``-th of all rows, fewer than ``HOT`` in
number, are broadcast and their rows are not shuffled. A task holds one batch and one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_as_table

SCALE = 256
HOT = 1_000
TINY = 1e-12
_SAFE = 2 ** 62


class Fit(NamedTuple):
    """n: weight of the fit list; sums: its sums by dimension; matrix: dimension x components, each
    column a unit eigenvector over the root of its eigenvalue; explained: shares of the trace."""
    n: int
    sums: list[int]
    matrix: np.ndarray
    explained: list[float]


def quantised(vectors: DataFrame, value: str) -> DataFrame:
    """Rows with a finite vector: ``_row`` (all columns) and ``_x`` (array of longs, all of one length)."""
    finite = F.forall(value, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    good = vectors.filter(F.col(value).isNotNull() & finite)
    width = good.agg(F.max(F.size(value))).first()[0] or 0
    x = F.transform(value, lambda e: F.floor(e.cast("double") * SCALE).cast("long"))
    return good.select(F.struct(*vectors.columns).alias("_row"),
                       F.when(F.size(value) == width, x)
                       .otherwise(F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(value)))).alias("_x"))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The batch's vectors, one a row."""
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _weights(batch: pa.RecordBatch, counted: bool) -> np.ndarray:
    copies = batch.column(1).to_numpy(zero_copy_only=False)
    return copies if counted else np.ones_like(copies)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def _sums(width: int, counted: bool):
    """Per task: the exact weighted sum of each dimension, as text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for b in batches:
            x, w = _matrix(b, width), _weights(b, counted)
            wide = _largest(x) * int(w.sum()) >= _SAFE
            part = (x.astype(object) * w[:, None].astype(object)).sum(axis=0) if wide else w @ x
            total = [t + int(p) for t, p in zip(total, part, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(map(str, total), pa.string())], ["i", "part"])
    return run


def _products(mean: np.ndarray, counted: bool):
    """Per task: the matrix of its centred vectors' weighted products, row by row."""
    width = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((width, width))
        for b in batches:
            c = _matrix(b, width) - mean
            acc += c.T @ (c * _weights(b, counted)[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(acc), pa.list_(pa.float64()))], ["i", "part"])
    return run


def _apply(fit: Fit):
    """Whitened vector and exact deviation of each distinct vector."""
    n, sums, width = fit.n, fit.sums, len(fit.sums)
    mean = np.array([s / n for s in sums])
    matrix, most = fit.matrix, max(map(abs, sums), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, width)
            far = _largest(x) * n + most
            if far * far * width < _SAFE:
                dev = ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
                dev = [int(d) if d < 2 ** 63 else None for d in exact]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(dev, pa.int64()), pa.array(list((x - mean) @ matrix), pa.list_(pa.float64()))],
                ["_x", "copies", "deviation", "whitened"])
    return run


def distinct(rows: DataFrame) -> DataFrame:
    """Each distinct vector once, with its number of rows, as a table."""
    return keep_as_table(rows.groupBy("_x").agg(F.count(F.lit(1)).alias("copies")), "white-distinct")


def fit(unique: DataFrame, components: int, weights: str = "one") -> Fit | None:
    """The fit over ``distinct``'s table; None if there is no vector or no entry."""
    if weights not in ("one", "count"):
        raise ValueError("weights are 'one' or 'count'")
    counted = weights == "count"
    n, width = unique.agg(F.sum("copies") if counted else F.count(F.lit(1)), F.max(F.size("_x"))).first()
    if not n or not width:
        return None
    parts = unique.mapInArrow(_sums(width, counted), "i int, part string")
    sums = [int(r.s) for r in parts.groupBy("i").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()]
    mean = np.array([s / n for s in sums])
    cells = (unique.mapInArrow(_products(mean, counted), "i int, part array<double>")
             .select("i", F.posexplode("part").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
             .groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("row"))
             .orderBy("i").collect())
    cov = np.array([r.row for r in cells]) / n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    trace = float(np.trace(cov))
    order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > TINY * trace and values[k] > 0]
    axes = vectors[:, order]
    # the sign of an eigenvector is free: its largest entry is made positive
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(len(order))] < 0, -1.0, 1.0) if order else axes
    return Fit(int(n), sums, axes / np.sqrt(values[order]), [float(values[k]) / trace for k in order])


def identity_error(white: DataFrame, fitted: Fit, weights: str = "one") -> float:
    """Largest absolute entry of the covariance of the whitened fit list, centred first, minus the identity."""
    k = len(fitted.explained)
    w = F.col("copies") if weights == "count" else F.lit(1)
    z = [F.col("whitened")[j] for j in range(k)]
    means = white.agg(*[(F.sum(z[j] * w) / fitted.n).alias(f"m{j}") for j in range(k)]).first()
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    cov = white.agg(*[(F.sum((z[a] - means[a]) * (z[b] - means[b]) * w) / fitted.n).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(cov, pairs, strict=True))


def whiten(vectors: DataFrame, components: int = 4, weights: str = "one", value: str = "embedding",
           out: tuple[str, str, str, str, str] = ("whitened", "deviation", "explained", "n", "identity_error")) -> DataFrame:
    """Finite rows of ``vectors`` with all their columns and, named by ``out`` (columns of these names
    are replaced): the whitened vector (array, first component first), its deviation, each
    component's share of the trace, the weight of the fit list and the identity error."""
    rows = quantised(vectors, value)
    unique = distinct(rows)
    fitted = fit(unique, components, weights)
    if fitted is None or not fitted.explained:
        white = unique.limit(0).select("_x", "copies", F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
        fitted, error = Fit(0, [], np.zeros((0, 0)), []), 0.0
    else:
        white = keep_as_table(unique.mapInArrow(_apply(fitted), "_x array<long>, copies long, deviation long, whitened array<double>"), "white-vectors")
        error = identity_error(white, fitted, weights)
    total = unique.agg(F.sum("copies")).first()[0] or 0
    keyed = lambda df: df.withColumn("_h", F.xxhash64("_x"))
    found = keyed(white.select("_x", "copies", F.struct("deviation", "whitened").alias("_found")))
    hot, rare = (found.filter(c).drop("copies") for c in (F.col("copies") * HOT > total, F.col("copies") * HOT <= total))
    on = ["_h", "_x"]
    # fewer than HOT distinct vectors can be held by more than a HOT-th of the rows each
    mine = keyed(rows)
    done = (mine.join(F.broadcast(hot), on).select("_row", "_found")
            .unionByName(mine.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rare, on).select("_row", "_found")))
    new = {out[0]: F.col("_found.whitened"), out[1]: F.col("_found.deviation"),
           out[2]: F.array(*map(F.lit, fitted.explained)).cast("array<double>"), out[3]: F.lit(fitted.n).cast("long"),
           out[4]: F.lit(error).cast("double")}
    return done.select(*[F.col("_row")[c].alias(c) for c in vectors.columns if c not in new], *[v.alias(c) for c, v in new.items()])


def components_of(vectors: DataFrame, components: int = 4) -> DataFrame:
    """One row per finite row of ``vectors`` and component: vec_id, component, n, deviation, whitened,
    explained, identity_error."""
    white = whiten(vectors.select("vec_id", "embedding"), components)
    return (white.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
                    F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error"))
