"""Greedy dynamic batching.

The reference sorts pairs by token count (descending, stable) and fills
batches greedily: a new batch opens when the sequence count is reached or the
tokens would overflow; an oversize pair stays alone. Sorted by length, every
batch is a contiguous run, and all pairs of one size behave alike, so:

1. range-partition and sort (id, size), and write that once, with each row's
   partition and place in it,
2. count rows per size and partition (a partial aggregate of that table),
3. fold the counts per size in one streamed pass (one row per distinct size),
   giving for each size the batch its first rows join and how many fit in
   a fresh batch,
4. a row's rank in its size run is its place less the run's first place in
   the partition, plus the counts of the partitions before; the batch id is
   arithmetic on the rank.

The result equals the sequential fold row for row, at any scale.

In the given order (``pack_batches_in_order``) a batch is also a contiguous
run, but where it starts depends on all rows before. A partition's rows can
be entered in at most ``max_sequences`` ways (the row at which its first own
batch starts), so every partition is folded once for each way, in parallel,
and the partitions' maps are composed in order: one row per partition and way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

DEFAULT_MAX_TOKENS = 2048
DEFAULT_MAX_SEQUENCES = 16
PLACE_BITS = (1 << 33) - 1  # of monotonically_increasing_id: the row's place in its partition

_RUN_SCHEMA = T.StructType([
    T.StructField("size", T.LongType()),
    T.StructField("head_batch", T.LongType()),
    T.StructField("head_take", T.LongType()),
    T.StructField("first_new", T.LongType()),
    T.StructField("per_batch", T.LongType()),
])


def _fold_runs(max_tokens: int, max_sequences: int):
    """Streamed fold of (size, n) in descending size order."""
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, cur_len, cur_tok = -1, max_sequences, 0  # no batch open yet
        for pdf in frames:
            out = []
            for size, n in zip(pdf["size"].tolist(), pdf["n"].tolist()):
                per_batch = max_sequences if size <= 0 else max(1, min(max_sequences, max_tokens // size))
                if batch < 0:
                    room = 0
                elif size <= 0:
                    room = max_sequences - cur_len
                else:
                    room = min(max_sequences - cur_len, max(0, (max_tokens - cur_tok) // size))
                take = max(0, min(n, room))
                rest = n - take
                out.append((size, batch, take, batch + 1, per_batch))
                if rest > 0:
                    n_new = -(-rest // per_batch)
                    batch += n_new
                    cur_len = rest - (n_new - 1) * per_batch
                    cur_tok = cur_len * size
                else:
                    cur_len += take
                    cur_tok += take * size
            yield pd.DataFrame(out, columns=_RUN_SCHEMA.fieldNames())
    return fold


def _placed(df: DataFrame, order: list, num_partitions: int | None, name: str) -> DataFrame:
    """``df`` range-partitioned and sorted, written once: partition numbers (_pid) and places in the
    partition (_place) are fixed from then on."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                       .withColumn("_pid", F.spark_partition_id())
                       .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE_BITS))), name)


def pack_batches(df: DataFrame, id_col: str = "pair_id", size_col: str = "token_count",
                 max_tokens: int = DEFAULT_MAX_TOKENS, max_sequences: int = DEFAULT_MAX_SEQUENCES,
                 num_partitions: int | None = None) -> DataFrame:
    """W2 + W3: (id, size, batch_id, seq) for every row; batch ids start at 0
    in descending size order, ties in ``id_col`` order (stable sort)."""
    slim = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("_size"))
    placed = _placed(slim, [F.desc("_size"), F.asc("_id")], num_partitions, "pack-sorted")
    # rows per (size, range partition), and the place at which the size starts there
    counts = placed.groupBy("_size", "_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_place").alias("_first"))
    runs = counts.groupBy("_size").agg(F.sum("_cnt").alias("n")).select(F.col("_size").alias("size"), "n")
    folded = (runs.repartition(1).sortWithinPartitions(F.desc("size"))
              .mapInPandas(_fold_runs(max_tokens, max_sequences), _RUN_SCHEMA))
    w = Window.partitionBy("_size").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_size", "_pid", (F.coalesce(F.sum("_cnt").over(w), F.lit(0)) - F.col("_first")).alias("_off"))
    r = (placed.join(offsets, ["_size", "_pid"]).withColumn("_rank", F.col("_off") + F.col("_place"))
         .join(folded, F.col("_size") == F.col("size")))
    batch = F.when(F.col("_rank") < F.col("head_take"), F.col("head_batch")).otherwise(
        F.col("first_new") + F.floor((F.col("_rank") - F.col("head_take")) / F.col("per_batch")))
    return r.select(F.col("_id").alias(id_col), F.col("_size").alias(size_col),
                    batch.cast("long").alias("batch_id"))


def _fits(count: int, tokens: int, size: int, max_tokens: int, max_sequences: int) -> bool:
    return count > 0 and count < max_sequences and tokens + max(size, 0) <= max_tokens


#: Rows of a partition that are worked on at once.
CHUNK_ROWS = 1 << 16


class _Chunk:
    """A run of rows in order. ``jumps[k][i]`` is the row at which the batch 2**k batches after one that
    starts at row i starts (the number of rows if there is none): the first by prefix sums and a
    sorted search, the others by doubling. All are nondecreasing in i."""

    def __init__(self, sizes: np.ndarray, max_tokens: int, max_sequences: int):
        self.n, self.max_tokens, self.max_sequences = len(sizes), max_tokens, max_sequences
        self.sums = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
        at = np.arange(self.n)
        fit = np.searchsorted(self.sums, self.sums[:-1] + max_tokens, side="right") - 1
        step = np.minimum(np.minimum(at + max_sequences, np.maximum(at + 1, fit)), self.n)
        self.jumps = [np.append(step, self.n)]
        while self.jumps[-1][0] < self.n:
            self.jumps.append(self.jumps[-1][self.jumps[-1]])

    def joining(self, count: int, tokens: int) -> int:
        """Rows at the start that still go to an open batch."""
        if count <= 0:
            return 0
        fit = int(np.searchsorted(self.sums, self.max_tokens - tokens, side="right")) - 1
        return max(0, min(self.n, self.max_sequences - count, fit))

    def last(self, start: int) -> tuple[int, int]:
        """(batches that start at or after row ``start``, first row of the last), if one starts there."""
        at, opened = start, 1
        for k in range(len(self.jumps) - 1, -1, -1):
            if self.jumps[k][at] < self.n:
                at, opened = int(self.jumps[k][at]), opened + (1 << k)
        return opened, at

    def starts(self, start: int) -> np.ndarray:
        """First rows of all batches from the one that starts at row ``start``."""
        opened = self.last(start)[0]
        at, steps = np.full(opened, start), np.arange(opened)
        for k, jump in enumerate(self.jumps):
            at = np.where(steps >> k & 1, jump[at], at)
        return at

    def walk(self, opened: int, count: int, tokens: int, skip: int) -> tuple[int, int, int, int, int]:
        """State after the chunk: batches opened, the open batch's rows and tokens, rows still to skip; and the
        row at which the first own batch starts (the number of rows if none does)."""
        if skip >= self.n:
            return opened, count, tokens, skip - self.n, self.n
        first = skip or self.joining(count, tokens)
        if first >= self.n:
            return opened, count + self.n, tokens + int(self.sums[-1]), 0, self.n
        new, last = self.last(first)
        return opened + new, self.n - last, int(self.sums[-1] - self.sums[last]), 0, first


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """(_pid, rows): the frames joined to some CHUNK_ROWS rows and cut where the partition changes."""
    def cut(held):
        rows = pd.concat(held, ignore_index=True)
        edges = [0, *(np.flatnonzero(np.diff(rows["_pid"].to_numpy())) + 1).tolist(), len(rows)]
        for a, b in zip(edges, edges[1:]):
            yield int(rows["_pid"].iat[a]), rows.iloc[a:b]
    held, n = [], 0
    for f in frames:
        if len(f):
            held.append(f)
            n += len(f)
        if n >= CHUNK_ROWS:
            yield from cut(held)
            held, n = [], 0
    if held:
        yield from cut(held)


def _partition_maps(max_tokens: int, max_sequences: int):
    """(_pid, _size) rows of a partition in order -> for each entry (rows that belong to an earlier
    partition's batch): batches opened, and the open batch's rows and tokens at the end. ``heads`` are
    the first sizes, by which the batch open before decides the entry."""
    names = ["_pid", "entry", "rows", "heads", "opened", "count", "tokens"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, heads, ways, rows = None, [], [], 0
        for p, piece in _pieces(frames):
            if p != pid:
                if pid is not None:
                    yield pd.DataFrame([(pid, e, rows, heads, *w[:3]) for e, w in enumerate(ways)], columns=names)
                pid, heads, rows, ways = p, [], 0, [(0, 0, 0, e) for e in range(max_sequences + 1)]
            sizes = piece["_size"].to_numpy()
            heads = [*heads, *sizes[:max_sequences + 1 - len(heads)].tolist()]
            chunk = _Chunk(sizes, max_tokens, max_sequences)
            ways = [chunk.walk(*w)[:4] for w in ways]
            rows += len(sizes)
        if pid is not None:
            yield pd.DataFrame([(pid, e, rows, heads, *w[:3]) for e, w in enumerate(ways)], columns=names)
    return run


def _compose(max_tokens: int, max_sequences: int):
    """Streamed composition of the partitions' maps in order -> (_pid, entry, first batch of its own,
    batch open before)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, count, tokens, pid, entry = -1, 0, 0, None, 0
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if r[0] != pid:
                    pid, entry = r[0], 0
                    joined_count, joined_tokens = count, tokens
                    for size in r.heads:
                        if not _fits(joined_count, joined_tokens, size, max_tokens, max_sequences):
                            break
                        entry, joined_count, joined_tokens = entry + 1, joined_count + 1, joined_tokens + max(size, 0)
                if r.entry == entry:
                    out.append((pid, entry, batch + 1, batch))
                    if entry >= r.rows:  # all rows went to the batch open before
                        count, tokens = joined_count, joined_tokens
                    else:
                        batch, count, tokens = batch + r.opened, r.count, r.tokens
            yield pd.DataFrame(out, columns=["_pid", "entry", "first_own", "before"])
    return run


def _numbered(max_tokens: int, max_sequences: int, schema: list[str]):
    """Rows of a partition in order, with its entry -> rows with batch_id."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, state = None, (0, 0, 0, 0)
        for p, piece in _pieces(frames):
            first_own, before = int(piece["first_own"].iat[0]), int(piece["before"].iat[0])
            if p != pid:
                pid, state = p, (0, 0, 0, int(piece["entry"].iat[0]))
            chunk = _Chunk(piece["_size"].to_numpy(), max_tokens, max_sequences)
            opened, skipping = state[0], state[3] > 0
            *state, first = chunk.walk(*state)
            # rows before the first own batch go on with the open one: this partition's, or the one before it
            ids = np.full(chunk.n, before if skipping or not opened else first_own + opened - 1, np.int64)
            if first < chunk.n:
                starts = chunk.starts(first)
                ids[first:] = first_own + opened + np.repeat(np.arange(len(starts)), np.diff(np.append(starts, chunk.n)))
            yield pd.DataFrame({schema[0]: piece["_id"], schema[1]: piece["_size"], "batch_id": ids})
    return run


def pack_batches_in_order(df: DataFrame, order_col: str, id_col: str = "pair_id", size_col: str = "token_count",
                          max_tokens: int = DEFAULT_MAX_TOKENS, max_sequences: int = DEFAULT_MAX_SEQUENCES,
                          num_partitions: int | None = None) -> DataFrame:
    """W3 with ``sort_by_length=False``: batches of rows in ``order_col`` order, ties in ``id_col`` order.
    The sequential part is one row per partition and entry; a partition's own rows are streamed."""
    slim = df.select(F.col(order_col).alias("_order"), F.col(id_col).alias("_id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("_size"))
    placed = _placed(slim, [F.asc("_order"), F.asc("_id")], num_partitions, "pack-ordered")
    # whole range partitions, in order: dealt by their numbers, sorted by place
    dealt = placed.repartition("_pid").sortWithinPartitions("_pid", "_place")
    maps = dealt.select("_pid", "_size").mapInPandas(
        _partition_maps(max_tokens, max_sequences),
        "_pid int, entry int, rows long, heads array<long>, opened long, count long, tokens long")
    entries = materialize(maps.repartition(1).sortWithinPartitions("_pid", "entry")
                          .mapInPandas(_compose(max_tokens, max_sequences), "_pid int, entry int, first_own long, before long"), "pack-entries")
    joined = (placed.join(entries, "_pid").select("_pid", "_place", "_id", "_size", "entry", "first_own", "before")
              .repartition("_pid").sortWithinPartitions("_pid", "_place"))
    kind = slim.schema["_id"].dataType.simpleString()
    return joined.select("_pid", "_id", "_size", "entry", "first_own", "before").mapInPandas(
        _numbered(max_tokens, max_sequences, [id_col, size_col]), f"{id_col} {kind}, {size_col} long, batch_id long")


def collate(tokenized: DataFrame, packed: DataFrame, id_col: str = "pair_id",
            size_col: str = "token_count") -> DataFrame:
    """Rectangular arrays per batch (at most ``max_sequences`` rows each),
    rows in packing order (size descending, then id)."""
    # the token arrays are wide: never let a size estimate broadcast them
    j = tokenized.hint("merge").join(packed.select(id_col, "batch_id", (-F.col(size_col)).alias("_neg")), id_col)
    rows = F.sort_array(F.collect_list(F.struct(
        F.col("_neg"), F.col(id_col), "input_ids", "attention_mask", "labels")))
    g = j.groupBy("batch_id").agg(rows.alias("_rows"))
    return g.select(
        "batch_id",
        F.transform("_rows", lambda r: r[id_col]).alias(id_col + "s"),
        F.transform("_rows", lambda r: r["input_ids"]).alias("input_ids"),
        F.transform("_rows", lambda r: r["attention_mask"]).alias("attention_mask"),
        F.transform("_rows", lambda r: r["labels"]).alias("labels"),
    )


def batch_stats(packed: DataFrame) -> DataFrame:
    """Number of batches and avg / min / max batch size (zeros when empty)."""
    sizes = packed.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("total_batches"),
        F.coalesce(F.round(F.avg("n"), 6), F.lit(0.0)).alias("avg_batch_size"),
        F.coalesce(F.min("n"), F.lit(0)).cast("bigint").alias("min_batch_size"),
        F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("max_batch_size"),
    )
