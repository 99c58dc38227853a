import numpy as np

from corpusflow.llm import embeddings
from corpusflow.llm.components import components

from . import brute


def vectors(seed=2, kind="float"):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(30):
        v = rng.normal(size=16)
        for _ in range(6):
            out.append((v.astype(np.float32).tolist(), c % 3))
            v = v + rng.normal(size=16) * 0.22 * rng.random()
    out += [(out[0][0], 0), (out[0][0], 0), (out[0][0], 1), (out[0][0], None), (None, 1), ([], 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1),
            ([float("inf")] + [1.0] * 15, 1), ([None] + [1.0] * 15, 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([1e30] * 16, 2), ([1e-30] * 16, 2)]
    rows = [(k, *r) for k, r in enumerate(out)] + [(None, *out[1]), (7, *out[20])]
    return rows, f"vec_id long, embedding array<{kind}>, label int"


def plain(rows):
    def vec(v, label):
        if v is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float64)
        return x / np.abs(x).max()
    vs = [vec(v, label) for _, v, label in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if vs[a] is not None and vs[b] is not None and rows[a][2] == rows[b][2]
              and len(vs[a]) == len(vs[b]) and vs[a] @ vs[b] / np.sqrt((vs[a] @ vs[a]) * (vs[b] @ vs[b])) >= 0.98]
    comp = brute.components([i for i, _, _ in rows], linked)
    n = [0] * len(rows)
    for a, b in linked:
        n[a] += 1
        n[b] += 1
    return sorted(str((i, n[k], comp[k], i == comp[k])) for k, (i, _, _) in enumerate(rows))


def test_links_equal_brute_force_in_any_tiling(spark):
    rows, shape = vectors()
    df = spark.createDataFrame(rows, shape).repartition(3)
    for tile in (4096, 9):
        got = embeddings.near_duplicates(df, tile=tile).collect()
        assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == plain(rows)


def test_bounds_hold_for_every_pair():
    import pyarrow as pa
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 24)) * np.exp(rng.normal(size=(300, 1)) * 5)
    block = embeddings.Block(pa.table({"node": list(range(300)), "copies": [1] * 300, "data": [x.tobytes() for x in v]}), 24)
    true = (v @ v.T) / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    near = (block.q @ block.q.T) / np.outer(block.scale, block.scale)
    assert (np.abs(true - near) <= np.outer(block.length, block.error) + block.error[:, None] + 1e-9).all()


def test_empty_and_clashing_columns(spark):
    rows, shape = vectors()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], shape + ", copies int, key string")
    assert embeddings.near_duplicates(df).count() == len(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 3), (301, 300), (300, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {300: 300, 301: 300}
    assert got == want


def clusters(n=8, size=60, dim=24, seed=6):
    """Tight clusters of one label: links inside them at, above and below the threshold."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        centre = rng.normal(size=dim)
        out += [(centre + rng.normal(size=dim) * s).tolist() for s in rng.uniform(0.05, 0.25, size)]
    return [(k, v, 1) for k, v in enumerate(out)], "vec_id long, embedding array<double>, label int"


def test_one_large_label_in_cells_equals_brute_force(spark):
    rows, shape = clusters()
    df = spark.createDataFrame(rows, shape).repartition(4)
    want = plain(rows)
    for tile in (7, 40, 4096):
        got = embeddings.near_duplicates(df, tile=tile).collect()
        assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == want


def test_vectors_visit_near_cells_only_and_a_byte_a_component_is_sent(spark):
    rows, _ = clusters()
    nodes = spark.createDataFrame([("1", 24, bytearray(np.array(v).tobytes()), k, 1, bytearray(b"%d" % k)) for k, v, _ in rows],
                                  "label string, dim int, data binary, node long, copies long, key binary")
    got = embeddings.seats(nodes, 0.98, 10)
    assert "data" not in got.columns and all(len(r.q) == 24 for r in got.collect())
    cells = got.filter("home").select("cell").distinct().count()
    assert got.filter("home").count() == len(rows) and cells > 20
    assert got.count() < len(rows) * cells / 8  # all pairs of cells would be half of that product


def test_sure_and_open_pairs_are_told_apart():
    import pyarrow as pa
    rows, _ = clusters()
    v = np.array([r[1] for r in rows])
    block = embeddings.Block(pa.table({"node": list(range(len(v))), "copies": [1] * len(v), "data": [x.tobytes() for x in v]}), 24)
    true = (v @ v.T) / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    seen = np.zeros(true.shape, np.int8)
    for x, y, sure in embeddings.bounded(block, block, True, 0.98):
        seen[x, y] = 1 + sure
    up = np.triu(np.ones(true.shape, bool), 1)
    assert (true[seen == 2] >= 0.98).all() and (true[up & (seen == 0)] < 0.98).all()
    assert (seen == 2).any() and (seen == 1).any()
