"""Mixing sources to target weights by capped water-filling.

Every source gets ``total * weight / sum(weights)`` words, but at most ``max_epochs`` times
its own size; what a clamped source leaves goes to the others in proportion to their weights,
until no target is above its cap. A source's documents are then repeated: all of them
``floor(target / size)`` times, and a seeded random order decides which get one more, up to
the fractional rest. The rest is met to within half a document.

Defined results: null or wordless text has size 0 and is taken 0 words; a null source is a
source of its own, after all others; rows with one doc_id are rows of their own; an empty table
gives an empty result; other columns of the input are ignored.

Scale: texts are read once and never shuffled. Sums per source are partial aggregates. The cut of
a source in its random order is found through 4,096 buckets and 4,096 sub-buckets of the order
(sums per bucket), so only the rows of one sub-bucket of a source are ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, global_rank, keep_as_table

MAX_EPOCHS = 3
SEED = "mix-1"
CYCLE = 3  # weights 1, 2, 3, 1, ... by the sources' order


def word_count(text) -> F.Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_weights(sources: DataFrame) -> DataFrame:
    """(source, ...) with ``weight``: 1, 2, 3, repeating by code point order, null last."""
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "mix-sources")
    return ranked.withColumn("weight", F.col("rank") % CYCLE + 1).drop("rank")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight) -> the same with ``target``. Each round clamps every
    source above its cap; only three sums reach the driver."""
    cap = F.col("source_size") * max_epochs
    state = sources.withColumn("clamped", F.lit(False))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        open_, taken = ~F.col("clamped"), F.col("clamped")
        weights, used, n = state.agg(F.sum(F.when(open_, F.col("weight"))), F.sum(F.when(taken, cap)),
                                     F.count(F.when(taken, 1))).first()
        rest = total - (used or 0)
        share = F.col("weight") * F.lit(rest) / F.lit(weights or 1)
        state = sources.withColumn("share", share)
        # a source once clamped stays so: shares only grow from round to round
        state = state.withColumn("clamped", (F.col("share") > cap) if weights else F.lit(True))
        state = state.withColumn("clamped", F.col("clamped") | (F.col("source_size") == 0))
        now = state.agg(F.count(F.when(F.col("clamped"), 1))).first()[0]
        if now == n:
            return state.withColumn("target", F.when(taken, cap).otherwise(F.col("share")).cast("double")).drop("share", "clamped")


def _cut(rows: DataFrame, bucket: str) -> DataFrame:
    """Per source: the bucket in which its cut lies and the words before it. ``rows`` has
    source_key, size, need (words wanted) and ``bucket``. None where all rows are taken."""
    sums = rows.groupBy("source_key", bucket).agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    w = Window.partitionBy("source_key").orderBy(bucket)
    run = sums.withColumn("upto", F.sum("words").over(w))
    found = (run.filter(F.col("upto") > F.col("need")).groupBy("source_key")
             .agg(F.min_by(F.struct(bucket, (F.col("upto") - F.col("words")).alias("before")), F.col(bucket)).alias("cut"))
             .select("source_key", F.col(f"cut.{bucket}").alias("cut"), F.col("cut.before").alias("before")))
    # one row a source, written: the planner knows its size, and while it is small it is broadcast,
    # so that a hot source's documents are not brought together
    return keep_as_table(found, f"mix-{bucket}")


def _order(seed: str) -> F.Column:
    """A document's place in the seeded random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _key() -> F.Column:
    """The source as a key that may be joined on; null is a key too."""
    return F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Repetitions of each document. Input: doc_id, text, source. Output: doc_id, source, size,
    source_size, target, ``copies`` (times the mix takes it), taken (= copies * size); also source_key,
    order, whole and extra, of which copies is made."""
    rows = keep_as_table(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _order(seed).alias("order")), "mix-sizes")
    sources = source_weights(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    filled = water_fill(keep_as_table(sources, "mix-weights"), max_epochs)
    plan = keep_as_table(
        filled.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("source_key", _key()), "mix-plan")
    digit = lambda a: F.conv(F.substring("order", a, 3), 16, 10).cast("int")
    d = (rows.withColumn("source_key", _key()).drop("source").join(plan, "source_key")
         .withColumn("b1", digit(1)).withColumn("b2", digit(4)))
    cut1 = _cut(d, "b1").withColumnsRenamed({"cut": "cut1", "before": "before1"})
    d = d.join(cut1, "source_key", "left")
    edge = (d.filter(F.col("b1") == F.col("cut1"))
            .withColumn("need", F.col("need") - F.col("before1")))
    cut2 = _cut(edge, "b2").withColumnsRenamed({"cut": "cut2", "before": "before2"})
    d = keep_as_table(d.join(cut2, "source_key", "left"), "mix-cut")
    on_edge = (F.col("b1") == F.col("cut1")) & (F.col("b2") == F.col("cut2"))
    full = F.col("cut1").isNull() | (F.col("b1") < F.col("cut1")) | ((F.col("b1") == F.col("cut1")) & (F.col("b2") < F.col("cut2")))
    w = Window.partitionBy("source_key").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rest = F.col("need") - F.col("before1") - F.col("before2")
    inside = (d.filter(on_edge).withColumn("extra", ((F.sum("size").over(w) - F.col("size") / 2) <= rest).cast("long")))
    outside = d.filter(~F.coalesce(on_edge, F.lit(False))).withColumn("extra", F.coalesce(full, F.lit(False)).cast("long"))
    both = inside.unionByName(outside).withColumn("copies", (F.col("whole") + F.col("extra")).cast("long"))
    return both.select("doc_id", "source", "size", "source_size", "target", "copies",
                       (F.col("copies") * F.col("size")).alias("taken"), "source_key", "order", "whole", "extra")



def apply_mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as its copies say (none, once, ...). All
    columns stay. A source's cut in the random order (one row a source) is brought to the rows, so
    texts are not shuffled for it while that table is small enough for the planner to broadcast;
    rows equal in doc_id and size at the cut are taken alike."""
    place = lambda: F.struct("order", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), "size")
    cuts = keep_as_table(mix(docs, max_epochs, seed).groupBy("source_key")
                         .agg(F.first("whole").alias("_whole"), F.max(F.when(F.col("extra") > 0, place())).alias("_cut")), "mix-cuts")
    hidden = docs.select(F.struct(*docs.columns).alias("_row"), _key().alias("source_key"), _order(seed).alias("order"),
                         word_count(F.col("text")).alias("size"), "doc_id")
    copies = (F.col("_whole") + F.coalesce(place() <= F.col("_cut"), F.lit(False)).cast("long")).cast("int")
    return (hidden.join(cuts, "source_key").withColumn("_copies", copies).filter("_copies > 0")
            .select("_row", F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).select("_row.*"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS ord FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
      (SELECT sum(size)::BIGINT FROM d) AS total FROM s),
-- clamped sources are those with the least cap per weight: a prefix of this order
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS k FROM w),
r AS (SELECT *, total - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
      sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM o),
f AS (SELECT min(k) AS k FROM r WHERE weight * rest <= 3 * source_size * open_weight),
t AS (SELECT r.source, r.source_size, CASE WHEN r.k < f.k OR f.k IS NULL THEN (3 * r.source_size)::DOUBLE
      ELSE (r.weight * p.rest)::DOUBLE / p.open_weight::DOUBLE END AS target
      FROM r, f LEFT JOIN r AS p ON p.k = f.k),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size AS need,
      sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN upto - size / 2.0 <= need THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
