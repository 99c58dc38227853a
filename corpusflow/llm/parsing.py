"""Document fingerprints by locally consistent parsing.

A text's characters are parsed into phrases, the phrases' names into longer phrases, and so on.
Runs of one symbol are one symbol. Then deterministic coin tossing gives each symbol a small label
that depends on a few symbols to its left only (lowest bit in which it differs from its left
neighbour, and that bit, four times over), and a phrase starts at each local minimum of the labels.
A phrase is named by a hash of its symbols. So equal substrings are parsed alike but for a few
symbols at their borders, wherever they stand; a text's borders stand for a fixed symbol.

The fingerprint is the ``COARSE`` least names of level 3 (some 25 characters a phrase) and the
``FINE`` least of level 2. Likeness is the Jaccard estimate of two bottom-k sets: of level 3 if both
texts have ``LEAST`` phrases there, else of level 2.

Defined results: null text counts as empty; the empty text has the fingerprint ``:``, likeness 1 to
itself and 0 to others; rows without a doc_id come last, in falling order of a hash of their texts, and rows of one
doc_id in order of their texts; a single document is its own next; an empty table gives an empty result; other columns are
ignored.

Scale: texts are shuffled once, into ranges of bounded size of doc_id (or, without one, of that hash; a range
holds one doc_id's or one hash's rows at least); a range also gets the first
row of the range that follows, so every row meets its successor in a streamed pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_as_table, null_safe_ranges
from .pieces import blocks

LEVELS = 3
COARSE, FINE, LEAST = 48, 16, 8
RANGE_CHARS = 16_000_000
BLOCK_CHARS = 1_000_000
_BORDER = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _toss_table() -> np.ndarray:
    """Label of (left, own) for labels below 256."""
    left, own = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
    low = (left ^ own) & -(left ^ own)
    place = np.bitwise_count(np.maximum(low, 1) - 1).astype(np.int64)
    return (2 * place + ((own & low) > 0)).astype(np.uint8).ravel()


_TOSS = _toss_table()


def _level(names: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parse the symbols of all texts (text k is names[bounds[k]:bounds[k + 1]]) one level up."""
    n = len(names)
    if not n:
        return names, bounds
    first = np.zeros(n + 1, bool)
    first[bounds[:-1]] = True  # an empty text marks the start of the next one, or the end
    first = first[:n]
    # runs of one symbol become one symbol
    start = first.copy()
    start[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(start)
    if len(at) < n:
        length = np.diff(at, append=n)
        symbols = names[at]
        many = length > 1
        symbols[many] = _mix(symbols[many] ^ length[many].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        bounds, first = np.searchsorted(at, bounds), first[at]
    else:
        symbols = names
    m = len(symbols)
    left = np.empty(m, np.uint64)
    left[1:] = symbols[:-1]
    left[first] = _BORDER
    differ = symbols ^ left
    low = differ & (~differ + np.uint64(1))
    label = (np.bitwise_count(low - np.uint64(1)) * np.uint8(2) + ((symbols & low) > 0)).astype(np.uint8)
    beside = np.empty(m, np.uint8)
    for _ in range(3):
        beside[1:] = label[:-1]
        beside[first] = 255
        label = _TOSS[beside.astype(np.uint16) << np.uint16(8) | label]
    # phrases start at local minima; a border is higher than all
    cut = first.copy()
    inner = np.empty(m, np.uint8)
    inner[:-1] = label[1:]
    inner[np.flatnonzero(first)[1:] - 1] = 255
    inner[-1] = 255
    beside[1:] = label[:-1]
    beside[first] = 0
    cut |= (label < beside) & (label < inner)
    at = np.flatnonzero(cut)
    length = np.diff(at, append=m)
    place = np.arange(m, dtype=np.int64) - np.repeat(at, length)
    named = np.add.reduceat(_mix(symbols + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), at)
    return _mix(named + length.astype(np.uint64)), np.searchsorted(at, bounds)


def phrases(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Names and bounds of levels 1 to LEVELS of all texts."""
    bounds = np.cumsum([0, *map(len, texts)])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    names, out = _mix(codes.astype(np.uint64) + np.uint64(1)), []
    for _ in range(LEVELS):
        names, bounds = _level(names, bounds)
        out.append((names, bounds))
    return out


def sketches(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """Per text: least names of level 3 and of level 2 (32 bits), and whether level 3 has enough."""
    levels = phrases(texts)

    def least(names: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
        low = (names >> np.uint64(32)).astype(np.uint64)
        text = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(bounds))
        both = np.unique(text << np.uint64(32) | low)
        at = np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
        values = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return [values[a:min(b, a + k)] for a, b in zip(at[:-1], at[1:], strict=True)]
    coarse, fine = least(*levels[-1], COARSE), least(*levels[-2], FINE)
    return [(c, f, len(c) >= LEAST) for c, f in zip(coarse, fine, strict=True)]


def as_text(sketch: tuple[np.ndarray, np.ndarray, bool]) -> str:
    return f"{sketch[0].astype('>u4').tobytes().hex()}:{sketch[1].astype('>u4').tobytes().hex()}"


def likeness(a: tuple, b: tuple) -> float:
    """Jaccard estimate of two sketches, 0 to 1."""
    x, y, k = (a[0], b[0], COARSE) if a[2] and b[2] else (a[1], b[1], FINE)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.concatenate([x, y])
    both.sort()
    union = both[np.concatenate([[True], both[1:] != both[:-1]])][:k]
    twice = both[1:][both[1:] == both[:-1]]
    return float(np.searchsorted(twice, union[-1], side="right") / len(union))


_OUT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _stream(alone: bool, names: list[str], types: list[pa.DataType]):
    """Rows of one range in order (doc_id, text, ghost) -> fingerprints; the row after the last is the
    first ghost, or, if the range is ``alone``, the first row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (doc_id, text) not yet given out: the last row waits for its successor
        head = None

        def give(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            """All rows but the last, each with the one after it."""
            for a, b in blocks([t for _, t in rows[:-1]], BLOCK_CHARS):
                part = [t for _, t in rows[a:b + 1]]
                edited = [t[:len(t) - len(t) // 2] + after[:len(t) // 2] for t, after in zip(part, part[1:], strict=False)]
                own, new = sketches(part), sketches(edited)
                cols = [[i for i, _ in rows[a:b]], [len(t) for t in part[:-1]],
                        [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                        [as_text(s) for s in own[:-1]], [as_text(s) for s in new],
                        [likeness(s, e) for s, e in zip(own, new, strict=False)],
                        [likeness(s, e) for s, e in zip(own, own[1:], strict=False)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        ended = False
        for batch in batches:
            if ended:
                continue
            ids, texts, ghosts = (batch.column(k).to_pylist() for k in range(3))
            for i, t, ghost in zip(ids, texts, ghosts, strict=True):
                if ended:
                    break
                held.append((i, t or ""))
                if head is None:
                    head = held[0]
                ended = ghost
            if len(held) > 1:
                yield from give(held)
                held = held[-1:]
        if held and not ended and alone:
            yield from give([held[0], head])
    return run


def fingerprint(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_chars, the edited text's hash, both fingerprints, and the
    likenesses to the edited text and to the next document in descending doc_id."""
    tie = F.when(F.col("doc_id").cast("long").isNull(), F.xxhash64("text")).alias("_tie")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), tie)
    facts = keep_as_table(rows.select("doc_id", "_tie", (F.coalesce(F.length("text"), F.lit(0)) + 100).cast("long").alias("n")), "parse-facts")
    n, of = null_safe_ranges(facts, "doc_id", "_tie", "n", range_chars)
    if n > 1:
        heads = facts.groupBy(of("doc_id", "_tie").alias("at")).agg(F.max("doc_id").alias("id"), F.max("_tie").alias("tie")).collect()  # one a range
        head = F.coalesce(F.col("doc_id").isin([r.id for r in heads if r.id is not None]), F.lit(False))
        if ties := [r.tie for r in heads if r.id is None]:
            head |= F.coalesce(F.col("_tie").isin(ties), F.lit(False))
        at = rows.withColumn("_at", of("doc_id", "_tie"))
        both = F.array(F.struct(F.col("_at").alias("at"), F.lit(False).alias("ghost")),
                       F.struct(((F.col("_at") + 1) % n).alias("at"), F.lit(True).alias("ghost")))
        placed = (at.withColumn("_to", F.explode(F.when(head, both).otherwise(F.slice(both, 1, 1))))
                  .select("doc_id", "_tie", "text", F.col("_to.ghost").alias("ghost"), F.col("_to.at").alias("at")))
    else:
        placed = rows.select("doc_id", "_tie", "text", F.lit(False).alias("ghost"), F.lit(0).alias("at"))
    names = ["doc_id", *[f.split()[0] for f in _OUT.split(", ")]]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return (placed.repartitionById(n, F.col("at"))
            .sortWithinPartitions("ghost", F.col("doc_id").desc_nulls_last(), F.col("_tie").desc(), F.col("text").asc_nulls_first())
            .select("doc_id", "text", "ghost").mapInArrow(_stream(n == 1, names, types), f"doc_id long, {_OUT}"))
