"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Word separators of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_as_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: a Parquet table in the shared folder of ``spark.checkpoint.dir``."""
    return materialize(df, name)


def global_rank(df: DataFrame, order: list, name: str, out: str = "rank") -> DataFrame:
    """``df`` with ``out`` = 0, 1, 2 ... in ``order``, without a single-task sort.

    Rows are range-partitioned and sorted; the table is written once, so that partition
    numbers are fixed, and each row's rank is its place in its partition plus the sizes of
    the partitions before (one row per partition)."""
    placed = keep_as_table(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
          .withColumn("_part", F.spark_partition_id())
          .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), name)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return (placed.join(before, "_part")
            .withColumn(out, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before"))


def key_ranges(rows: DataFrame, key: str, weight: str, target: int, most: int = 20_000) -> list[int]:
    """Lower bounds, ascending, that cut an integer key into ranges of about ``target`` weight
    (at least a ``most``-th of all weight): the same for the same rows, however they are
    partitioned. Bins of equal width are summed, and bins that are too heavy are cut in eight
    until they are light or hold one key; at most ``8 * most`` bin sums reach the driver at once."""
    lo, hi, total = rows.filter(F.col(key).isNotNull()).agg(F.min(key), F.max(key), F.sum(weight)).first()
    if lo is None:
        return []
    target = max(target, -(-int(total or 0) // most))
    # bins are named by the key's high bits alone: keys may lie more than 64 bits apart
    shift = max(0, (hi - lo).bit_length() - 11)
    part, done = rows.filter(F.col(key).isNotNull()), []
    while True:
        sums = part.groupBy(F.shiftright(key, shift).alias("bin")).agg(F.sum(weight).alias("w")).collect()
        heavy = [b for b, w in sums if (w or 0) > target and shift > 0]
        done += [(b << shift, int(w or 0)) for b, w in sums if not ((w or 0) > target and shift > 0)]
        if not heavy:
            break
        part, shift = rows.filter(F.shiftright(key, shift).isin(heavy)), max(0, shift - 3)
    bounds, run = [], 0
    for at, w in sorted(done):
        if not bounds or run + w > target:
            bounds.append(at)
            run = 0
        run += w
    return bounds


def range_of(key: str, bounds: list[int]):
    """Number (0, 1, ...) of the range of ``key_ranges`` that a key lies in; null lies in 0."""
    cuts = np.asarray(bounds[1:], dtype=np.int64)

    @F.pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts, keys.fillna(np.iinfo(np.int64).min).to_numpy(dtype=np.int64), side="right")
        return pd.Series(at.astype(np.int32))
    return find(F.col(key).cast("long"))


def null_safe_ranges(rows: DataFrame, key: str, tie: str, weight: str, target: int, most: int = 20_000):
    """Ranges of ``key_ranges`` for a key that many rows may lack: rows without a key are cut by the long ``tie`` (of
    theirs, a hash) in ranges of their own, which come first. Number of ranges, and the function (key
    column, tie column) -> number of a row's range."""
    bounds = key_ranges(rows, key, weight, target, most)
    without = key_ranges(rows.filter(F.col(key).isNull()), tie, weight, target, most)

    def of(key: str, tie: str):
        at = range_of(key, bounds)
        return F.when(F.col(key).isNull(), range_of(tie, without)).otherwise(at + len(without)) if without else at
    return max(1, len(bounds) + len(without)), of


def mark_held(df: DataFrame, key, ids: DataFrame, out: str, bits: int = 23) -> DataFrame:
    """``df`` with ``out``: may ``key`` be in the one-column table ``ids`` of longs? True for every id
    in the table, and for few others while the table has far fewer than 2**bits rows, so most rows can
    be kept out of a join that then decides; null is always marked. The test is a bitmap of fixed size: at most
    2**bits / 64 words (131,072, some 2 MB), which is what is broadcast."""
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(1 << bits))
    words = keep_as_table(
        ids.select(place(F.col(ids.columns[0])).alias("at")).groupBy(F.shiftright("at", 6).alias("_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("_set")), "bitmap")
    bit = F.expr("shiftright(_set, cast(_at & 63 as int)) & 1L") == 1
    return (df.withColumn("_at", place(key)).join(F.broadcast(words), F.shiftright("_at", 6) == F.col("_word"), "left")
            .withColumn(out, key.isNull() | F.coalesce(bit, F.lit(False))).drop("_at", "_word", "_set"))
