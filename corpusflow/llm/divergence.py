"""Source divergence audit: which sources of a language differ, and by which terms.

Smoothed term rates of every (language, source) group are compared with each other (part
``pair``: sum of absolute differences over the kept terms) and with the language's (part
``term``: the terms that the group uses more). All arithmetic is in whole numbers.

The best ``k`` terms of a group come from a dominance skyband: a term's value can only grow with its
count in the group and fall with its count in the language, and ties go to the earlier text. So
a term with ``k`` others that have at least its group count, at most its language count and an earlier text
can't be among the first ``k``. Every partition keeps the terms that fewer than ``k`` of its terms dominate; the
skybands are merged in two rounds by the same rule, and only what is left is ranked by value.

Defined results: null text, language and source read as ''; groups without any term, and languages
without any kept one, still give their pairs (value 0 without kept terms); repeated rows and rows with equal or null
doc_id are documents of their own; a language with one source has no pair; an empty table gives an empty
result; other columns are ignored.

Scale: texts are read once and never shuffled; (language, source, term) counts are combined before
their shuffle, so a source with a third of all rows adds no more than its distinct terms. The pair part is a
dense product of terms by sources: blocks of about ``TERMS`` terms and twice ``SOURCES`` sources
go to one task call each, which returns partial sums, so neither depends on how many terms or
sources there are. A skyband scan holds one group's skyband and one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_as_table

#: What separates terms, and the smoothing of the rates.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SMOOTH = 5
UNIT = 1_000_000_000
LEAST_DOCS = 30
TOP = 50
SOURCES = 256
TERMS = 1_024
SALTS = 16
CHUNK = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case and no other letter changed: for a text of one byte a character that is
    what ``lower`` does, faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term) with ``n`` occurrences and ``docs`` documents."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
                       F.split(_lowered(F.coalesce("text", F.lit(""))), SEPARATORS, -1).alias("terms"))
    both = rows.select("lang", "source", F.explode(F.array(
        F.struct(F.lit(0).alias("once"), F.col("terms").alias("terms")),
        F.struct(F.lit(1).alias("once"), F.array_distinct("terms").alias("terms")))).alias("t"))
    one = both.select("lang", "source", F.col("t.once").alias("once"), F.explode("t.terms").alias("term")).filter("term != ''")
    return one.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("docs"))


def _rate(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * kept)), in whole numbers."""
    def quotient(over: Column, under: Column) -> Column:
        # the remainder goes first, so that the quotient, UNIT at most, is whole
        return (over - F.pmod(over, under)) / under

    wide = lambda c: c.cast("decimal(20,0)")
    count, total, kept = (c.cast("long") for c in (count, total, kept))
    most = F.greatest(total + kept * SMOOTH, F.lit(1))  # without kept terms no rate is used
    short = F.rint(quotient((count + SMOOTH) * UNIT, most)).cast("long")
    long = quotient((wide(count) + SMOOTH) * F.lit(UNIT).cast("decimal(10,0)"), wide(most)).cast("long")
    # up to 9 * 10^9 occurrences the product fits in 64 bits
    return F.when(kept > 0, F.when(count <= 9_000_000_000, short).otherwise(long) + 1).otherwise(F.lit(0)).cast("long")


def rates(docs: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """(groups, cells), tables. groups: lang, source, kept (terms of the language), total, zero (rate of
    a term that the group lacks). cells: lang, source, term, n, p (the group's rate), ln, q (the language's)."""
    counts = keep_as_table(term_counts(docs), "terms")
    common = (counts.groupBy("lang", "term").agg(F.sum("n").alias("ln"), F.sum("docs").alias("docs"))
              .filter(F.col("docs") >= least_docs).drop("docs"))
    held = keep_as_table(counts.drop("docs").join(common, ["lang", "term"]), "terms-kept")
    per_lang = (held.groupBy("lang", "term").agg(F.first("ln").alias("ln"))
                .groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("ln").alias("all")))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = keep_as_table(
        every.join(totals, ["lang", "source"], "left").join(per_lang, "lang", "left")
        .na.fill(0, ["total", "kept", "all"]).withColumn("zero", _rate(F.lit(0), F.col("total"), F.col("kept"))), "term-groups")
    cells = (held.join(groups, ["lang", "source"])
             .withColumn("p", _rate(F.col("n"), F.col("total"), F.col("kept")))
             .withColumn("q", _rate(F.col("ln"), F.col("all"), F.col("kept"))))
    return groups, cells.select("lang", "source", "term", "n", "p", "ln", "q")


def _dominators(a_terms: np.ndarray, a_low: np.ndarray, terms: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each (terms, low): how many of (a_terms, a_low) have an earlier term and no higher language count."""
    return ((a_low[None, :] <= low[:, None]) & (a_terms[None, :] < terms[:, None])).sum(axis=1)


def _skyband(k: int, chunk_rows: int = CHUNK):
    """Rows sorted by group, falling group count, language count, term: those that fewer than ``k``
    rows of their group dominate. Dominators come first in this order, and a row with ``k`` of them has ``k`` in
    the skyband itself, so only kept rows and the rows of the same chunk are compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept_terms, kept_low = None, [], np.zeros(0, np.int64)
        for b in batches:
            langs, sources, terms = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("lang", "source", "term"))
            low = b.column(b.schema.get_field_index("ln")).to_numpy()
            keys = list(zip(langs, sources, strict=True))
            good, start = [], 0
            while start < len(keys):
                if keys[start] != now:
                    now, kept_terms, kept_low = keys[start], [], np.zeros(0, np.int64)
                end = start + 1
                while end < len(keys) and end - start < chunk_rows and keys[end] == now:
                    end += 1
                chunk, chunk_low = terms[start:end], low[start:end]
                # places of the texts in code point order, which is that of their UTF-8 bytes
                place = np.unique(np.array(kept_terms + chunk, dtype=object), return_inverse=True)[1]
                old, new = place[:len(kept_terms)], place[len(kept_terms):]
                earlier = np.tri(len(new), k=-1, dtype=bool)
                inside = (earlier & (chunk_low[None, :] <= chunk_low[:, None]) & (new[None, :] < new[:, None])).sum(axis=1)
                stay = np.flatnonzero(_dominators(old, kept_low, new, chunk_low) + inside < k)
                kept_terms += [chunk[j] for j in stay]
                kept_low = np.concatenate([kept_low, chunk_low[stay]])
                good += (stay + start).tolist()
                start = end
            if good:
                yield b.take(pa.array(good, pa.int64()))
    return run


def top_terms(cells: DataFrame, k: int = TOP) -> DataFrame:
    """Part ``term``: the first ``k`` terms of each group."""
    schema = "lang string, source string, term string, n long, p long, ln long, q long"
    order = [F.col("lang"), F.col("source"), F.col("n").desc(), F.col("ln"), F.col("term")]
    sky = lambda df: df.sortWithinPartitions(*order).mapInArrow(_skyband(k), schema)
    local = sky(cells.filter((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", "term", "n", "p", "ln", "q"))
    salted = local.withColumn("_salt", F.spark_partition_id() % SALTS).repartition("lang", "source", "_salt").drop("_salt")
    merged = sky(sky(salted).repartition("lang", "source"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.col("term"))
    return (merged.withColumn("value", F.col("p") - F.col("q")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


def _block(table: pa.Table) -> pa.Table:
    """Partial distances of the source pairs of one block. Rows without a term name the sources, their
    rate where they lack a term, the side(s) they are on, and the kept terms if the block is the language's first."""
    is_head = pc.is_null(table["term"])
    head = table.filter(is_head).sort_by("idx")
    body = table.filter(pc.invert(is_head)).select(["idx", "term", "p"]).combine_chunks()
    names, tile, zero = head["source"].to_pylist(), head["tile"].to_numpy(), head["p"].to_numpy()
    extra = pc.max(head["kept"]).as_py()
    coded = pc.dictionary_encode(body["term"]).unify_dictionaries().combine_chunks()
    coded = coded if isinstance(coded, pa.DictionaryArray) else coded.chunk(0) if coded.num_chunks else pa.array([], pa.string()).dictionary_encode()
    n_terms = len(coded.dictionary)
    rate = np.repeat(zero[:, None], n_terms, axis=1)
    rate[np.searchsorted(head["idx"].to_numpy(), body["idx"].to_numpy()), coded.indices.to_numpy()] = body["p"].to_numpy()
    lang, a_tile, b_tile = (head[c][0].as_py() for c in ("lang", "a", "b"))
    left, right = np.flatnonzero(tile == a_tile), np.flatnonzero(tile == b_tile)
    firsts, seconds, values = [], [], []
    for i in left:
        others = right[right > i] if a_tile == b_tile else right
        # terms that no source of the block holds count zero against zero, and are added once for all
        far = np.abs(rate[others] - rate[i]).sum(axis=1) + np.abs(zero[others] - zero[i]) * (extra - n_terms)
        firsts += [names[i]] * len(others)
        seconds += [names[j] for j in others]
        values.append(far)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.table({"lang": pa.array([lang] * len(firsts), pa.string()), "one": pa.array(firsts, pa.string()),
                     "two": pa.array(seconds, pa.string()), "value": pa.array(flat, pa.int64())})


def distances(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """Part ``pair``: every other source of the language, the farthest first."""
    numbered = groups.select("lang", "source", "zero", "kept", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("idx"),
                             F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("n_sources"))
    numbered = keep_as_table(numbered.withColumn("tile", F.floor(F.col("idx") / SOURCES).cast("int"))
                             .withColumn("tiles", F.ceil(F.col("n_sources") / SOURCES).cast("int"))
                             .withColumn("blocks", F.greatest(F.ceil(F.col("kept") / TERMS), F.lit(1)).cast("int")), "term-sources")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    tiled = lambda df: (df.withColumn("_o", other).withColumn("a", F.least("tile", "_o")).withColumn("b", F.greatest("tile", "_o")))
    columns = ["lang", "a", "b", "block", "tile", "idx", "source", "term", "p", "kept"]
    heads = (tiled(numbered).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("term", F.lit(None).cast("string")).withColumn("p", F.col("zero"))
             .withColumn("kept", F.when(F.col("block") == 0, F.col("kept")).otherwise(0)))
    body = (tiled(cells.select("lang", "source", "term", "p").join(numbered.select("lang", "source", "idx", "tile", "tiles", "blocks"), ["lang", "source"]))
            .withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks").cast("long")).cast("int"))
            .withColumn("kept", F.lit(0).cast("long")).withColumn("source", F.lit(None).cast("string")))
    both = heads.select(*columns).unionByName(body.select(*columns))
    parts = both.groupBy("lang", "a", "b", "block").applyInArrow(_block, "lang string, one string, two string, value long")
    sums = parts.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    sides = sums.select("lang", "value", F.explode(F.array(
        F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))).alias("s"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.col("item"))
    return (sides.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
            .withColumn("rank", F.row_number().over(w)))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, k: int = TOP) -> DataFrame:
    """Both parts: lang, source, part, item, value, rank."""
    groups, cells = rates(docs, least_docs)
    return distances(groups, cells).unionByName(top_terms(cells, k))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
o AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS ln FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(ln)::HUGEINT AS nl FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
r AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
      (1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v))::BIGINT AS p, (1 + (1000000000 * (k.ln + 5)) // (l.nl + 5 * l.v))::BIGINT AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f
      FROM r a JOIN r b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM r WHERE n > 0 AND p > q),
x AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM x WHERE part = 'pair' OR rank <= 50
"""
