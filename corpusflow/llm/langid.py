"""Language identification by bit-sliced Bloom filters of character n-grams.

One filter serves all languages: every slot holds a bitmask with one bit per language (several
planes of 64 beyond that), so that the slots of an n-gram, and-ed, return all languages that may
contain it. Per language the n-grams of a text found so are counted (popcount by bit) and corrected
for false positives with the language's own fill: ``(found - n * p) / (1 - p)``. The language with
the largest corrected count wins; its share of all languages' counts is the score.

Training reads a sample of labelled rows (``SAMPLE`` rows a language in the mean, chosen by a hash of
the row, so it does not grow with the corpus), or all of them with ``sample=None``, as the pipeline does. A language keeps the n-grams with at least
``MIN_SHARE`` of its n-grams (hence at most 1 / MIN_SHARE per length) whose rate is at least ``MIN_RATIO`` of the
rate in the language that has them most, which leaves out what other languages' quotations bring.

Defined results: null text, and text without a letter, is ``und`` with score 0; a text whose
n-grams no language has gets the language with the most training rows, with score 0; ties go to the
language that sorts first; without training rows every text is ``und``; repeated rows are predicted
each; other columns pass through ``identify``, which replaces those of its own names.

Scale: prediction is narrow (no shuffle), over whole texts in windows of bounded size; the filter (1
to a few MB, by the bounds above) is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_as_table
from .pieces import blocks, text_blocks, then_released

SAMPLE = 2000
MIN_SHARE = 2e-5
MIN_RATIO = 0.1
LENGTHS = (3, 4)
PROBES = 2
SLOTS_PER_GRAM = 16
BLOCK_CHARS, WINDOW = 250_000, 250_000
NONE = "und"

_LETTER = np.zeros(0, bool)


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])
    out = _LETTER[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        out[high] = [chr(c).isalpha() for c in codes[high].tolist()]
    return out


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, non-letters 0, with one 0 around each text; and the
    texts' bounds (len(texts) + 1)."""
    low = ["\0" + (t or "").lower() for t in texts]
    bounds = np.cumsum([0, *map(len, low)])
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0" * max(LENGTHS), np.uint32)
    return np.where(_letters(codes), codes, 0).astype(np.uint64), bounds


def _grams(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram at each position, and whether it lies in one word (a border of a word may
    stand at either end)."""
    size = len(codes) - n + 1
    h = np.full(size, n, np.uint64)
    inside = np.ones(size, bool)
    for k in range(n):
        part = codes[k:k + size]
        h = h * np.uint64(0x100000001B3) + part
        if 0 < k < n - 1:
            inside &= part > 0
    return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9), inside


@dataclass
class Filter:
    """``planes``: slots x planes of 64 languages; ``false``: false positive rate per language."""

    langs: list[str]
    bits: int
    planes: np.ndarray
    false: np.ndarray
    usual: int  # the language with the most training rows

    def slots(self, h: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(PROBES):
            yield ((h * np.uint64(2 * k + 0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: corrected counts by language, n-grams, and whether it has a letter."""
        codes, bounds = _codes(texts)
        found = np.zeros((len(texts), len(self.langs)))
        total = np.zeros(len(texts), np.int64)

        def per_text(marks: np.ndarray, a: int) -> np.ndarray:
            run = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
            at = np.clip(bounds - a, 0, len(marks))
            return run[at[1:]] - run[at[:-1]]

        letters = np.zeros(len(texts), np.int64)
        for a in range(0, int(bounds[-1]), WINDOW):
            b = min(a + WINDOW, int(bounds[-1]))
            letters += per_text(codes[a:b] > 0, a)
            for n in LENGTHS:
                h, inside = _grams(codes[a:b + n - 1], n)
                total += per_text(inside, a)
                masks = None
                for slot in self.slots(h):
                    masks = self.planes[slot] if masks is None else masks & self.planes[slot]
                masks[~inside] = 0
                for k in range(len(self.langs)):
                    plane, bit = divmod(k, 64)
                    found[:, k] += per_text((masks[:, plane] >> np.uint64(bit)).astype(np.uint8) & 1, a)
        return np.maximum(0, found - total[:, None] * self.false) / (1 - self.false), total, letters > 0

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and the share of a text's n-grams that its language has."""
        counts, total, lettered = self.find(texts)
        if not self.langs:
            return [NONE] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        best = counts.argmax(1)
        top, sums = counts.max(1), counts.sum(1)
        best = np.where(sums > 0, best, self.usual)
        score = np.where(lettered & (sums > 0), top / np.maximum(sums, 1e-300), 0.0)
        share = np.where(lettered & (total > 0), np.minimum(1, top / np.maximum(total, 1)), 0.0)
        return [self.langs[b] if ok else NONE for b, ok in zip(best, lettered, strict=True)], score, share


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, n, gram, count), summed per block."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            mine = [t for x, t in zip(langs, texts, strict=True) if x == lang]
            for a, b in blocks(mine, BLOCK_CHARS):
                codes, _ = _codes(mine[a:b])
                for n in LENGTHS:
                    h, inside = _grams(codes, n)
                    grams, counts = np.unique(h[inside], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams), pa.string()), pa.array([n] * len(grams), pa.int32()),
                         pa.array(grams.view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "n", "gram", "count"])


def fit(train: DataFrame, sample: int | None = SAMPLE, min_share: float = MIN_SHARE, min_ratio: float = MIN_RATIO) -> Filter:
    """Learn from (text, lang); rows without either are left out. ``sample``: rows a language in
    the mean, None: all rows; at most 1 / min_share n-grams of each length and language reach the driver."""
    rows = train.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("_h"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Filter([], 1, np.zeros((2, 1), np.uint64), np.zeros(0), 0)
    if sample is not None:
        rate = F.lit(0.0)
        for lang in langs:
            rate = F.when(F.col("lang") == lang, min(1.0, sample / sizes[lang])).otherwise(rate)
        rows = rows.filter(F.pmod("_h", F.lit(1 << 30)) < rate * (1 << 30))
    counts = keep_as_table(rows.select("lang", "text").mapInArrow(then_released(_count), "lang string, n int, gram long, count long")
                           .groupBy("lang", "n", "gram").agg(F.sum("count").alias("count")), "langid-counts")
    totals = counts.groupBy("lang", "n").agg(F.sum("count").alias("total"))
    rates = counts.join(F.broadcast(totals), ["lang", "n"]).withColumn("rate", F.col("count") / F.col("total"))
    tops = rates.filter(F.col("rate") >= min_share)
    most = rates.groupBy("n", "gram").agg(F.max("rate").alias("most"))
    kept = tops.join(most, ["n", "gram"]).filter(F.col("rate") >= min_ratio * F.col("most")).select("lang", "gram").toPandas()
    grams = kept["gram"].nunique()
    bits = max(10, int(np.ceil(np.log2(max(1, grams * SLOTS_PER_GRAM)))))
    planes = np.zeros((1 << bits, -(-len(langs) // 64)), np.uint64)
    made = Filter(langs, bits, planes, np.zeros(len(langs)), max(range(len(langs)), key=lambda k: sizes[langs[k]]))
    for k, lang in enumerate(langs):
        h = kept.loc[kept["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
        plane, bit = divmod(k, 64)
        for slot in made.slots(h):
            planes[slot, plane] |= np.uint64(1 << bit)
    made.false = np.array([float(((planes[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) ** PROBES for k in range(len(langs))])
    return made


#: A text with fewer letters is too short for its share of known n-grams to say much.
ENOUGH_LETTERS = 50


def letters(text):
    """Letters of a text."""
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))


def identify(docs: DataFrame, model: Filter, text: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "known")) -> DataFrame:
    """``docs`` with the language, the score and the share of the n-grams that the language has.
    Columns of these names are replaced."""
    docs = docs.drop(*out)
    names, at = docs.columns, docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType())
    shape = T.StructType([*docs.schema.fields, *map(T.StructField, out, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_blocks(batch.column(at), BLOCK_CHARS):
                langs, score, known = sent.value.decide(texts)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(langs, pa.string()), pa.array(score), pa.array(known)],
                                                 names=[*names, *out])
    return docs.mapInArrow(then_released(run), shape)


def low_shares(train: DataFrame, model: Filter, quantile: float = 0.01, found: tuple[str, str] | None = None) -> dict[str, float]:
    """Per learned language: the share of known n-grams that all but a ``quantile`` of its training rows
    reach (rows of at least ENOUGH_LETTERS letters), over all rows with text and lang. ``found``: the columns of ``train``
    with the known share and the number of letters, if ``identify`` has been over it."""
    rows = train.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    if found is None:
        rows = identify(rows.filter(letters(F.col("text")) >= ENOUGH_LETTERS), model, out=("_pred", "_score", "_known"))
        known = "_known"
    else:
        known = found[0]
        rows = rows.filter(F.col(found[1]) >= ENOUGH_LETTERS)
    by_lang = rows.groupBy(F.col("lang").cast("string").alias("_lang"))
    return {r[0]: r[1] for r in by_lang.agg(F.percentile_approx(known, quantile, 10_000)).collect()}


def held_out(doc_id: str = "doc_id"):
    """Rows that training must not see."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
