"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors are linked if their labels are equal and their cosine in double precision reaches the
threshold. A unit vector u is quantised to int8 with a scale of its own; with v its dequantised form
and e = |u - v|, two vectors' cosine differs from the product of the quantised ones by at most
|v1| * e2 + e1. Tiles of quantised vectors are multiplied: a product that reaches the threshold even
less that bound is a link, one that misses it even with the bound is none, and only the vectors of
pairs in between are sent again in full, to the tile that asked for them, and their cosine computed.

A label of more than ``TILE`` vectors is dealt to cells, each vector to the nearest of some of the
label's own vectors (at most ``CENTRES`` in all). By the triangle inequality of angles a vector can
only be linked with a vector of a cell whose centre is no further than the cell's radius and the
threshold's angle together: it visits those cells, of higher number than its own, and no others. A
cell's own vectors and its visitors lie in blocks of about ``TILE`` by hash, and every pair of blocks
with own vectors in it is one tile, so a cell with a third of all rows is many tiles. A tile returns
link counts per vector and a spanning forest, never its pairs.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components, or
whose label is null, links with nothing; vectors of different lengths do not link; equal vectors
(one node with a count) link with each other; rows of one vec_id are rows of their own; a null
vec_id is a component's id only if all in it are null; an empty table gives an empty result; other columns
are ignored.

Scale: tiles are sent a byte a component; full vectors only where the bound leaves a pair open. How many
cells a vector visits depends on the data: in vectors without any clusters each meets all of its label,
and products grow with the square of the largest label. Memory per task is two blocks and one
block of products; the centres and radii are what is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_as_table, mark_held
from .components import components

TILE, STEP, PAIRS = 4096, 1024, 200_000
COSINE = 0.98
CENTRES = 2048
#: Angles are computed in doubles: far more than what rounding can do to them near 0.
SLACK = 1e-5


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) -> vec_id, label, dim, key, data (components as doubles; null if
    the vector cannot link)."""
    for batch in batches:
        col = batch.column(2)
        labels, data, keys, dims = batch.column(1), [], [], []
        starts, flat = col.offsets.to_numpy(), col.values
        known = col.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
        whole = flat.is_valid().to_numpy(zero_copy_only=False)
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        good = whole & np.isfinite(values)
        for ok, a, b in zip(known, starts[:-1], starts[1:], strict=True):
            v = values[a:b]
            ok = bool(ok and b > a and good[a:b].all() and v.any())
            raw = v.tobytes() if ok else None
            data.append(raw)
            keys.append(hashlib.blake2b(raw, digest_size=16).digest() if ok else None)
            dims.append(int(b - a) if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), labels, pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(data, pa.binary())],
                                         names=["vec_id", "label", "dim", "key", "data"])


def _units(data: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors scaled by their largest component, the norms of those, and unit vectors."""
    v = np.frombuffer(b"".join(data), np.float64).reshape(-1, dim)
    full = v / np.abs(v).max(1, keepdims=True)
    norm = np.sqrt((full * full).sum(1))
    return full, norm, full / norm[:, None]


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 form, scale, length of the dequantised vector, and its distance from the unit vector."""
    scale = 127 / np.abs(unit).max(1)
    q = np.rint(unit * scale[:, None]).astype(np.int8)
    back = q / scale[:, None]
    return q, scale, np.sqrt((back * back).sum(1)), np.sqrt(((unit - back) ** 2).sum(1)) + 1e-9


def _exact(dim: int) -> type:
    """A float type in which products of int8 vectors are exact whole numbers, however they are summed."""
    return np.float32 if dim * 127 * 127 < 1 << 24 else np.float64


class Block:
    """Vectors of a tile's side, in order of their nodes: the quantised form, and, if the table holds
    ``data``, scaled doubles and their norms."""

    def __init__(self, table: pa.Table, dim: int):
        table = table.sort_by("node")
        self.node = table.column("node").to_numpy()
        self.copies = table.column("copies").to_numpy()
        if "data" in table.column_names:
            self.full, self.norm, unit = _units(table.column("data").to_pylist(), dim)
        if "q" in table.column_names:
            q = np.frombuffer(b"".join(table.column("q").to_pylist()), np.int8).reshape(-1, dim)
            self.scale, self.length, self.error = (table.column(c).to_numpy() for c in ("scale", "length", "error"))
        else:
            q, self.scale, self.length, self.error = quantise(unit)
        self.q = q.astype(_exact(dim))


def bounded(a: Block, b: Block, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (places in a, places in b) that may reach ``least``, and whether they surely do, by blocks
    of STEP x STEP products. The same two vectors get the same answer in any tile that holds them in this order."""
    for i in range(0, len(a.node), STEP):
        for j in range(i if same else 0, len(b.node), STEP):
            ra, rb = slice(i, i + STEP), slice(j, j + STEP)
            product = (a.q[ra] @ b.q[rb].T).astype(np.float64) / (a.scale[ra, None] * b.scale[None, rb])
            bound = a.length[ra, None] * b.error[None, rb] + a.error[ra, None] + 1e-9
            x, y = np.nonzero(product + bound >= least)
            sure = product[x, y] - bound[x, y] >= least
            x, y = x + i, y + j
            if same:
                up = x < y
                x, y, sure = x[up], y[up], sure[up]
            for k in range(0, len(x), PAIRS):
                yield x[k:k + PAIRS], y[k:k + PAIRS], sure[k:k + PAIRS]


def _forest(n: int, x: np.ndarray, y: np.ndarray, root: np.ndarray) -> np.ndarray:
    """``root`` (least place reachable, so far) after the links (x, y)."""
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        new = new[root]
        if np.array_equal(new, root):
            return root
        root = new


_TILE = ("label", "dim", "cell", "i", "j")
_LINKS = "a long, b long, n long, side int, label string, dim int, cell int, i int, j int"


def _tile(least: float, again: bool):
    """One tile -> rows (a, root b), (a, links n), and, of the first pass, (a, side) for vectors with a
    pair that the bound leaves open. ``again``: those vectors with their full form, only open pairs."""
    def run(table: pa.Table) -> pa.Table:
        key = [table.column(c)[0].as_py() for c in _TILE]
        (dim, i, j), side = (key[1], key[3], key[4]), table.column("side").to_numpy()
        names = [f.split()[0] for f in _LINKS.split(", ")]
        types = [pa.int64()] * 3 + [pa.int32(), pa.string()] + [pa.int32()] * 4
        if not (side == i).any() or not (side == j).any():
            return pa.table([pa.array([], t) for t in types], names=names)
        a = Block(table.filter(pa.array(side == i)), dim)
        b = a if i == j else Block(table.filter(pa.array(side == j)), dim)
        shift = 0 if i == j else len(a.node)
        node = a.node if i == j else np.concatenate([a.node, b.node])
        copies = a.copies if i == j else np.concatenate([a.copies, b.copies])
        count, root, open_ = np.zeros(len(node), np.int64), np.arange(len(node)), np.zeros(len(node), bool)
        for x, y, sure in bounded(a, b, i == j, least):
            if again:
                x, y = x[~sure], y[~sure]
                hit = np.einsum("ij,ij->i", a.full[x], b.full[y]) / (a.norm[x] * b.norm[y]) >= least
            else:
                hit = sure
                open_[x[~sure]] = open_[y[~sure] + shift] = True
            x, y = x[hit], y[hit] + shift
            np.add.at(count, x, copies[y])
            np.add.at(count, y, copies[x])
            root = _forest(len(node), x, y, root)
        tree, met, ask = np.flatnonzero(root != np.arange(len(node))), np.flatnonzero(count), np.flatnonzero(open_)
        t, m, o = len(tree), len(met), len(ask)
        of = np.where(np.arange(len(node)) < len(a.node), i, j).astype(np.int32)
        cols = [pa.array(node[np.concatenate([tree, met, ask])], pa.int64()),
                pa.concat_arrays([pa.array(node[root[tree]], pa.int64()), pa.nulls(m + o, pa.int64())]),
                pa.concat_arrays([pa.nulls(t, pa.int64()), pa.array(count[met], pa.int64()), pa.nulls(o, pa.int64())]),
                pa.concat_arrays([pa.nulls(t + m, pa.int32()), pa.array(of[ask], pa.int32())]),
                *[pa.array([k] * (t + m + o), kind) for k, kind in zip(key, types[4:], strict=True)]]
        return pa.table(cols, names=names)
    return run


def _large(nodes: DataFrame, tile: int) -> dict[tuple[str, int], np.ndarray]:
    """(label, dim) -> unit vectors of its centres, for labels of more than a tile: those of its
    vectors whose keys come first by hash, at most CENTRES in all."""
    total = nodes.count()
    n = F.col("size")
    sizes = (nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size"))
             .select("label", "dim", F.least(F.ceil(n / tile), F.floor(n * CENTRES / max(1, total))).cast("int").alias("k")).filter("k > 1"))
    first = Window.partitionBy("label", "dim").orderBy(F.xxhash64("key"), "key")
    # each of these labels takes two centres or more, so they are at most CENTRES / 2
    rows = (nodes.select("label", "dim", "key", "node").join(F.broadcast(sizes), ["label", "dim"])
            .withColumn("place", F.row_number().over(first)).filter(F.col("place") <= CENTRES).filter(F.col("place") <= F.col("k"))
            .select("node", "place"))
    found: dict[tuple[str, int], list] = {}
    for label, dim, data, _ in sorted((nodes.join(F.broadcast(rows), "node").select("label", "dim", "data", "place")).collect(), key=lambda r: r.place):
        found.setdefault((label, dim), []).append(bytes(data))
    return {k: _units(v, k[1])[2] for k, v in found.items()}


def _at_centres(batch: pa.RecordBatch, centres: dict) -> Iterator[tuple]:
    """Rows (label, dim, data as the first columns) of labels with centres: key, row numbers, cells, and
    angles to all centres. Cells are the nearest by whole-number products, so that they do not depend on the batch."""
    labels, dims = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    of: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(labels, dims, strict=True)):
        if key in centres:
            of.setdefault(key, []).append(k)
    for key, rows in of.items():
        c, exact = centres[key], _exact(key[1])
        cq, scale = quantise(c)[:2]
        for k in range(0, len(rows), STEP):
            part = np.array(rows[k:k + STEP])
            unit = _units(batch.column(2).take(pa.array(part)).to_pylist(), key[1])[2]
            cell = ((quantise(unit)[0].astype(exact) @ cq.astype(exact).T).astype(np.float64) / scale).argmax(1)
            yield key, part, cell, np.arccos(np.clip(unit @ c.T, -1, 1))


def _radii(nodes: DataFrame, centres: dict) -> dict[tuple[str, int], np.ndarray]:
    """(label, dim) -> per cell the largest angle between its centre and its vectors (-9: no vectors)."""
    sent = nodes.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (label, dim), _, cell, angle in _at_centres(batch, sent.value):
                far = np.full(angle.shape[1], -9.0)
                np.maximum.at(far, cell, angle[np.arange(len(cell)), cell])
                at = np.flatnonzero(far > -9)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array([dim] * len(at), pa.int32()),
                                                  pa.array(at, pa.int32()), pa.array(far[at])], names=["label", "dim", "cell", "far"])
    out = {k: np.full(len(c), -9.0) for k, c in centres.items()}
    for label, dim, cell, far in (nodes.select("label", "dim", "data").mapInArrow(run, "label string, dim int, cell int, far double")
                                  .groupBy("label", "dim", "cell").agg(F.max("far")).collect()):  # at most CENTRES rows
        out[label, dim][cell] = far
    return out


def seats(nodes: DataFrame, least: float, tile: int) -> DataFrame:
    """Nodes (label, dim, data, node, copies) in quantised form, one row per cell that a node lies in
    (``home``) or visits."""
    centres = _large(nodes, tile)
    reach = {k: r + np.arccos(np.clip(least, -1, 1)) + SLACK for k, r in _radii(nodes, centres).items()} if centres else {}
    sent = nodes.sparkSession.sparkContext.broadcast((centres, reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dims = len(batch), batch.column(1).to_numpy()
            raw, facts = [b""] * n, np.zeros((3, n))
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for k in range(0, len(rows), STEP):
                    part = rows[k:k + STEP]
                    q, *three = quantise(_units(batch.column(2).take(pa.array(part)).to_pylist(), int(dim))[2])
                    facts[:, part] = three
                    for at, row in zip(part, q, strict=True):
                        raw[at] = row.tobytes()
            cells, row_of, home_of = [np.zeros(n, np.int64)], [np.arange(n)], [np.ones(n, bool)]
            for key, part, cell, angle in _at_centres(batch, sent.value[0]):
                cells[0][part] = cell
                x, y = np.nonzero(angle <= sent.value[1][key])
                up = y > cell[x]
                cells.append(y[up])
                row_of.append(part[x[up]])
                home_of.append(np.zeros(up.sum(), bool))
            cell, row, home = map(np.concatenate, (cells, row_of, home_of))
            base = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(raw, pa.binary()), *map(pa.array, facts)],
                                              names=["label", "dim", "node", "copies", "q", "scale", "length", "error"])
            for k in range(0, len(row), TILE):
                part = base.take(pa.array(row[k:k + TILE]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell[k:k + TILE], pa.int32()), pa.array(home[k:k + TILE])],
                                                 names=[*part.schema.names, "cell", "home"])
    return nodes.select("label", "dim", "data", "node", "copies").mapInArrow(
        run, "label string, dim int, node long, copies long, q binary, scale double, length double, error double, cell int, home boolean")


def _links(nodes: DataFrame, least: float, tile: int) -> DataFrame:
    """Rows of ``_tile``: a spanning forest (a, b) and link counts (a, n) of all nodes."""
    seated = keep_as_table(seats(nodes, least, tile), "embedding-seats")
    per = lambda c: F.ceil(F.count_if(c) / tile).cast("int")
    sizes = seated.groupBy("label", "dim", "cell").agg(per(F.col("home")).alias("own"), per(~F.col("home")).alias("visiting"))
    spot = F.xxhash64("node")
    own, visiting = F.col("own"), F.col("visiting")
    tiles = (seated.join(sizes, ["label", "dim", "cell"]).filter(own > 0)  # a cell without own vectors has no tile
             .withColumn("side", F.when(F.col("home"), F.pmod(spot, own)).otherwise(own + F.pmod(spot, visiting)).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("home"), own + visiting).otherwise(own) - 1)))
             .select("label", "dim", "cell", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"),
                     "side", "node", "copies", "q", "scale", "length", "error"))
    first = keep_as_table(tiles.groupBy(*_TILE).applyInArrow(_tile(least, False), _LINKS), "embedding-links")
    asked = first.filter(F.col("side").isNotNull()).select(*_TILE, "side", F.col("a").alias("node"))
    vectors = nodes.select("node", "copies", "data")
    held = mark_held(vectors, F.col("node"), asked.select("node"), "_held").filter("_held").drop("_held")
    second = keep_as_table(asked.join(held, "node").groupBy(*_TILE).applyInArrow(_tile(least, True), _LINKS), "embedding-open")
    return first.filter(F.col("side").isNull()).unionByName(second).select("a", "b", "n")


def near_duplicates(vectors: DataFrame, least: float = COSINE, tile: int = TILE) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, n_links, component_id, kept, one row per row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    parsed = keep_as_table(rows.mapInArrow(_valid, "vec_id long, label string, dim int, key binary, data binary"), "embedding-rows")
    usable = parsed.filter(F.col("key").isNotNull())
    nodes = keep_as_table(
        usable.groupBy("label", "dim", "key")
        .agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("data").alias("data"))
        .withColumn("node", F.monotonically_increasing_id()), "embedding-nodes")
    out = _links(nodes, least, tile)
    roots = components(out.filter(F.col("b").isNotNull()).select("a", "b"))
    counts = out.filter(F.col("n").isNotNull()).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    named = (nodes.select("node", "label", "dim", "key", "vec_id", "copies").join(roots, "node", "left").join(counts, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    least_id = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    of_key = named.join(least_id, "root").select("label", "key", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return (parsed.select("vec_id", "label", "key").join(of_key, ["label", "key"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(v, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN m ON m.v = e.vec_id
"""
