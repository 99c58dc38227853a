"""Near-duplicates by circulant MinHash, banding and exact verification.

A document's set holds its distinct shingles of ``WIDTH`` words, as 64-bit hashes. One permutation
(a mix of the hash) gives a shingle its place on a ring of 2**RING_BITS, a second one is a fixed random
permutation of the ring, and coordinate k of the signature is the least value of the second,
circularly shifted by k, over the set's places. Equal sets are one node. Bands of a few coordinates make
candidates; their number and rows follow from the similarity asked for (``banding``), so that two sets of just that
similarity share no band with probability below 1e-8. Every link is confirmed on full sets.

Only components are wanted, so pairs are not expanded. First each set of a bucket is compared with the
bucket's first one, and what is linked becomes one component, so that copies of one text cost
comparisons in proportion to their number. Then all pairs of a bucket that lie in different
components are compared, in tiles of bounded size inside the tasks, each pair in the first band that it
shares; only links between components come back. A link inside a component changes nothing, so no
link between candidates is lost.

Defined results: null text, or text without words, has an empty set (n_shingles 0) and is linked with
nothing; a text of fewer than WIDTH words has one shingle; rows of equal sets are linked; rows of one
doc_id are rows of their own; a null doc_id is never a component's id unless all of it are null;
an empty table gives an empty result; other columns are ignored.

Scale: one pass over the texts, unshuffled, writes 16-byte set keys and band hashes; buckets are
found by a partial aggregate; only documents in some bucket of two or more sets are read again for
their full sets. Joins are on nodes and buckets, which adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_as_table, mark_held
from .components import components
from .pieces import text_blocks, then_released

WIDTH = 5
ROWS = 7  # of a band, at most
COORDINATES = 384  # of a signature, at most
MISS = 1e-8
RING_BITS = 20
SIMILARITY = 85  # percent
BLOCK_BYTES, GATHER = 250_000, 4096
TILE, STEP = 2048, 256  # members of a bucket compared by one task, and at once
CELLS = 1 << 23
_SEPARATORS = (9, 10, 11, 12, 13, 32)


def banding(similarity: int) -> tuple[int, int]:
    """Rows of a band and number of bands: the longest bands with which two sets of this similarity
    (percent) share none with probability below MISS."""
    if not 0 < similarity <= 100:
        raise ValueError(f"similarity is a percentage above 0: {similarity}")
    for rows in range(ROWS, 0, -1):
        same = (similarity / 100) ** rows
        bands = 1 if same == 1 else math.ceil(math.log(MISS) / math.log1p(-same))
        if rows * bands <= COORDINATES:
            return rows, bands
    raise ValueError(f"similarity {similarity} needs more than {COORDINATES} bands")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_RNG = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)  # of a byte, A-Z as a-z
_VALUE[65:91] = _VALUE[97:123]
_BASE = 0x9E3779B97F4A7C15
_PLACE = _RNG.integers(1, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)
_BAND = _RNG.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = []
_RINGS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _POWERS[k:k + 1] = [np.multiply.accumulate(out)]
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the texts' bounds among them (len(texts) + 1)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    gap = np.isin(data, _SEPARATORS)
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers(1 << max(18, int(len(data)).bit_length()))
    run = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE[data] * power[:len(data)])])
    words = _mix((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return words, np.concatenate([[0], np.searchsorted(starts, ends_of_text)])


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, bounds = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    n = len(words) - width + 1
    sums = np.zeros(max(0, n), np.uint64)
    for k in range(width):
        sums += words[k:k + len(sums)] * _PLACE[k % WIDTH]
    shingles = _mix(sums)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(shingles[a:b - width + 1]))
        elif b > a:
            part = words[a:b]
            out.append(_mix((part * _PLACE[:b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], similarity: int = SIMILARITY) -> np.ndarray:
    """Circulant MinHash of each (non-empty) set: len(sets) x (rows * bands)."""
    size = math.prod(banding(similarity))
    if not _RINGS:
        ring = np.random.Generator(np.random.PCG64(97)).permutation(1 << RING_BITS).astype(np.int32)
        _RINGS.append(np.concatenate([ring, ring[:COORDINATES]]))
    windows = np.lib.stride_tricks.sliding_window_view(_RINGS[0], size)
    out = np.full((len(sets), size), np.iinfo(np.int32).max, np.int32)
    if not sets:
        return out
    places = (_mix(np.concatenate(sets) ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - RING_BITS)).astype(np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for a in range(0, len(places), GATHER):
        mine = owner[a:a + GATHER]
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        least = np.minimum.reduceat(windows[places[a:a + GATHER]], first, axis=0)
        out[mine[first]] = np.minimum(out[mine[first]], least)
    return out


def bands(signature: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """Band hashes (number of the band included): n x bands."""
    rows, count = banding(similarity)
    parts = signature.astype(np.uint64).reshape(-1, count, rows)
    return _mix(_mix((parts * _BAND[:rows]).sum(2, dtype=np.uint64)) + np.arange(1, count + 1, dtype=np.uint64)).view(np.int64)


def _sign(similarity: int):
    """(doc_id, text) -> doc_id, n, key (of the set; null if empty), bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in text_blocks(batch.column(1), BLOCK_BYTES):
                sets = shingle_sets(texts)
                full = [s for s in sets if len(s)]
                hashes = iter(bands(signatures(full, similarity), similarity).tolist())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                     pa.array([next(hashes) if len(s) else None for s in sets], pa.list_(pa.int64()))], names=["doc_id", "n", "key", "bands"])
    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> key, shingles."""
    for batch in batches:
        for _, _, texts in text_blocks(batch.column(0), BLOCK_BYTES):
            sets = [s for s in shingle_sets(texts) if len(s)]
            sizes = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], names=["key", "shingles"])


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) of nodes whose full sets are similar enough."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (pairs.join(x, "a").join(y, "b").withColumn("both", both)
            .filter(100 * F.col("both") >= similarity * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b"))


def _common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets x[k] and y[k] (sorted, distinct)."""
    used, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    mine = [sets[k] for k in used.tolist()]
    if len(x) * 16 >= len(used) ** 2:
        words, column = np.unique(np.concatenate(mine), return_inverse=True)
        if len(words) * len(used) <= CELLS:  # most pairs are asked for: one product of incidence matrices
            held = np.zeros((len(used), len(words)), np.float32)
            held[np.repeat(np.arange(len(used)), [len(s) for s in mine]), column] = 1
            return (held @ held.T)[place[:len(x)], place[len(x):]].astype(np.int64)
    out = np.empty(len(x), np.int64)
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        one, two = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
        at = np.minimum(np.searchsorted(two, one), len(two) - 1)
        out[k] = np.count_nonzero(two[at] == one)
    return out


def _tile(similarity: int):
    """One tile of a bucket -> links (a, b) between components that its members lie in, a spanning
    forest of them. A pair is looked at in the first band that it shares, and no pair leaves the task."""
    count = banding(similarity)[1]

    def run(table: pa.Table) -> pa.Table:
        bucket, i, j = (table.column(c)[0].as_py() for c in ("bucket", "i", "j"))
        root, block = table.column("root").to_numpy(), table.column("block").to_numpy()
        held = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, count)
        band = int(np.flatnonzero(held[0] == bucket)[0])
        lists = table.column("shingles").combine_chunks()
        flat = lists.flatten().to_numpy().view(np.uint64)  # each set as it was made: sorted, distinct
        sizes = pc.list_value_length(lists).to_numpy()
        sets = np.split(flat, np.cumsum(sizes)[:-1])
        parent: dict[int, int] = {}

        def find(r: int) -> int:
            while (up := parent.get(r, r)) != r:
                parent[r] = parent.get(up, up)
                r = up
            return r
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for a in range(0, len(one), STEP):
            p = one[a:a + STEP]
            for b in range(a if i == j else 0, len(two), STEP):
                q = two[b:b + STEP]
                look = root[p][:, None] != root[q][None, :]
                if i == j:
                    look &= p[:, None] < q[None, :]
                look &= 100 * np.minimum(sizes[p][:, None], sizes[q][None, :]) >= similarity * np.maximum(sizes[p][:, None], sizes[q][None, :])
                for k in range(band):
                    look &= held[p, k][:, None] != held[q, k][None, :]
                x, y = np.nonzero(look)
                if not len(x):
                    continue
                x, y = p[x], q[y]
                both = _common(sets, x, y)
                hit = 100 * both >= similarity * (sizes[x] + sizes[y] - both)
                for u, v in set(zip(root[x[hit]].tolist(), root[y[hit]].tolist(), strict=True)):
                    u, v = find(u), find(v)
                    if u != v:
                        parent[max(u, v)] = min(u, v)
        links = [(a, b) for a, b in parent.items() if a != b]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})
    return run


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept, one row per row; also the set's key, the
    component's root node (both null for an empty set), and whether the doc_id is null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = keep_as_table(rows.mapInArrow(then_released(_sign(similarity)), "doc_id long, n long, key binary, bands array<long>"), "minhash-rows")
    nodes = keep_as_table(
        signed.filter(F.col("key").isNotNull()).groupBy("key")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    banded = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = (banded.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last"))
              .filter(F.col("first") < F.col("last")).select("bucket", "first"))
    members = keep_as_table(banded.join(shared, "bucket"), "minhash-members")
    # full sets of the documents that are in some shared bucket
    wanted = keep_as_table(members.select("node").distinct().join(nodes.select("node", "key", "doc_id"), "node"), "minhash-wanted")
    texts = mark_held(rows, F.col("doc_id"), wanted.select("doc_id"), "_may").filter("_may").select("doc_id", "text").join(wanted.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    found = texts.select("text").mapInArrow(then_released(_sets), "key binary, shingles array<long>")
    sets = keep_as_table(found.join(wanted.select("node", "key"), "key").dropDuplicates(["node"]).select("node", "shingles"), "minhash-sets")
    fits = lambda m, n: 100 * F.least(m, n) >= similarity * F.greatest(m, n)
    size = members.select(F.col("node").alias("first"), F.col("n").alias("first_n")).distinct()
    stars = (members.filter(F.col("node") != F.col("first")).select("node", "n", "first").distinct()
             .join(size, "first").filter(fits(F.col("n"), F.col("first_n"))).select(F.col("first").alias("a"), F.col("node").alias("b")))
    roots = components(_confirmed(stars, sets, similarity))
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = (placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"))
             .filter("lo < hi").select("bucket", F.ceil(F.col("size") / TILE).cast("int").alias("blocks")))
    rest = (placed.select("bucket", "node", "root").join(mixed, "bucket")
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("bucket", "node", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    # compute-heavy for its bytes: dealt to the session's number of tasks, not coalesced by size
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = rest.join(nodes.select("node", "bands"), "node").join(sets, "node").repartition(tasks, "bucket", "i", "j")
    more = whole.groupBy("bucket", "i", "j").applyInArrow(_tile(similarity), "a long, b long")
    # links between components: components of those, then of the nodes in them
    above = components(more)
    roots = keep_as_table(roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "full_outer")
                          .select(F.coalesce("node", "root").alias("node"), F.coalesce("top", "root").alias("root")), "minhash-roots")
    named = (nodes.select("node", "key", "doc_id").join(roots, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_key = named.join(least, "root").select("key", "root", "component_id")
    return (signed.select("doc_id", F.col("n").alias("n_shingles"), "key").join(of_key, "key", "left")
            .select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "key", "root")
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
            .withColumn("doc_id_order", F.col("doc_id").isNull()))



def _keyed(names: list[str], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_blocks(batch.column(at), BLOCK_BYTES):
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in shingle_sets(texts)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(keys, pa.binary())], names=[*names, "_mh_key"])
    return run


def deduplicate(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: one of the least doc_id, and if rows repeat
    that doc_id, of the least set key and then of the least text. Rows without words all stay, and so
    do all columns."""
    found = keep_as_table(near_duplicates(docs, similarity), "minhash-found")
    chosen = found.filter(F.col("key").isNotNull()).groupBy("root").agg(F.min(F.struct("doc_id_order", "doc_id", "key")).alias("c"))
    chosen = chosen.select(F.col("c.doc_id").alias("_mh_id"), F.col("c.key").alias("_mh_chosen"))
    wordless = found.filter(F.col("key").isNull()).select(F.col("doc_id").alias("_mh_id"))
    ids = chosen.select("_mh_id").unionByName(wordless).distinct()
    gone = keep_as_table(found.select(F.col("doc_id").alias("_mh_id")).distinct()
                         .join(ids.withColumnRenamed("_mh_id", "_kept"), F.col("_mh_id").eqNullSafe(F.col("_kept")), "left_anti"), "minhash-gone")
    own = F.col("doc_id").cast("long")
    # only documents that may be in ``gone`` are shuffled
    marked = mark_held(docs, own, gone, "_mh_may")
    rows = (marked.filter("not _mh_may").drop("_mh_may")
            .unionByName(marked.filter("_mh_may").drop("_mh_may").join(gone, own.eqNullSafe(F.col("_mh_id")), "left_anti")))
    repeats = keep_as_table(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("_mh_id")), "minhash-repeats")
    if not repeats.limit(1).count():
        return rows
    once = rows.join(repeats, own.eqNullSafe(F.col("_mh_id")), "left_anti")
    again = rows.join(repeats, own.eqNullSafe(F.col("_mh_id")), "left_semi")
    keyed = again.mapInArrow(_keyed(again.columns, again.columns.index("text")), T.StructType([*again.schema.fields, T.StructField("_mh_key", T.BinaryType())]))
    named = keyed.join(chosen, own.eqNullSafe(F.col("_mh_id")) & (F.col("_mh_key") == F.col("_mh_chosen")), "left")
    first = Window.partitionBy("_mh_id", "_mh_key").orderBy("text", *[c for c in docs.columns if c != "text"])
    picked = named.filter(F.col("_mh_chosen").isNotNull()).withColumn("_mh_n", F.row_number().over(first)).filter("_mh_n = 1")
    return once.unionByName(picked.select(*docs.columns)).unionByName(named.filter(F.col("_mh_key").isNull()).select(*docs.columns))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])
                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.v = d.doc_id
"""
