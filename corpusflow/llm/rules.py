"""Quality rules: a threshold table compiled into one Spark projection (DataFrame functions only).

Every rule of the table bounds a ratio of two counts of a text: ``least <= 100 * value / base <= most``,
compared as whole numbers (``100 * value`` with ``least * base``), so no rounding decides. ``compiled``
turns the table into columns of one projection: the names of the rules that a text fails. The
counts are themselves column expressions: words and their characters, symbols, words that hold a
letter, stop words, lines, repeated lines, bullet and ellipsis lines, and words inside three-word
windows that the text holds twice or more.

Defined results: a null text has no word and no line; a text with fewer than ``LEAST_WORDS`` words fails; a
rule whose base is 0 passes; repeated rows are judged each; an empty table gives an empty result;
other columns are ignored by ``judge`` and returned by ``keep``, whatever their names.

Scale: one narrow projection over one scan, no shuffle, no state between rows; a row's arrays grow
with its own text. Windows are compared by a 64-bit hash of their three words within one text, and
sorted only for texts in which two of them agree.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Blank, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
#: From a letter to the end of its word: one match for each word that holds a letter.
LETTER_WORD = r"\p{L}[^\x20\x09-\x0D]*"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
#: Common function words of the four languages.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "was", "on", "with", "be", "as", "by", "this", "are", "at", "from",
    "der", "die", "und", "den", "von", "zu", "das", "sich", "mit", "auf", "des", "für", "ist", "nicht", "im", "dem", "ein", "eine", "als", "auch",
    "de", "la", "le", "et", "les", "en", "un", "du", "une", "que", "pour", "est", "qui", "dans", "par", "pas", "au", "sur", "avec", "ce",
    "el", "y", "los", "se", "del", "las", "por", "no", "con", "su", "una", "es", "para", "al", "lo", "como", "más", "o", "pero", "sus",
)


class Rule(NamedTuple):
    """One row of the threshold table: ``least <= 100 * value / base <= most`` (None: open)."""
    name: str
    value: str
    base: str
    least: int | None
    most: int | None


#: The threshold table. Values and bases are counts of ``counts``.
RULES = (
    Rule("word_length", "word_chars", "n_words", 300, 1000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("letters", "n_letter_words", "n_words", 80, None),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_letter_words", "n_stop_words", "n_lines", "n_dup_lines",
          "n_bullet_lines", "n_ellipsis_lines", "n_repeat_words")


def _size(array: Column) -> Column:
    return F.size(array).cast("long")


def _bare(line: Column) -> Column:
    """A line without separators at its ends; what is left holds a word or nothing."""
    return F.btrim(line, F.lit(SEPARATORS))


def counts(texts: DataFrame, text: str) -> DataFrame:
    """``texts`` with ``_words``, ``_lines``, ``_windows`` (working arrays) and the columns of COUNTS,
    each with ``_q_`` before its name."""
    held = F.coalesce(F.col(text), F.lit(""))
    split = texts.withColumns({
        "_words": F.filter(F.split(held, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""),
        "_lines": F.filter(F.split(held, "\n", -1), lambda x: _bare(x) != "")})
    # windows as (hash, place); the last two words begin none
    words = F.col("_words")
    hashed = split.withColumn("_windows", F.slice(
        F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
        F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))))
    windows = F.col("_windows")
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    sorted_ = hashed.withColumn("_sorted", F.when(F.size(F.array_distinct(windows)) == F.size(windows), none).otherwise(placed))
    s = F.col("_sorted")
    same = lambda x, other: F.coalesce(x["h"] == F.get(s, other)["h"], F.lit(False))
    twice = sorted_.withColumn("_places", F.sort_array(F.transform(
        F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])))
    # a window covers three words, or as many as there are before the next repeated window
    p = F.col("_places")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
                          F.lit(0).cast("long"), lambda a, b: a + b)
    lines = F.col("_lines")
    made = {
        "n_words": _size(words),
        "word_chars": F.length(F.translate(held, SEPARATORS, "")).cast("long"),
        "n_symbols": F.regexp_count(held, F.lit(SYMBOLS)).cast("long"),
        "n_letter_words": F.regexp_count(held, F.lit(LETTER_WORD)).cast("long"),
        "n_stop_words": _size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))),
        "n_lines": _size(lines),
        "n_dup_lines": _size(lines) - _size(F.array_distinct(lines)),
        "n_bullet_lines": _size(F.filter(lines, lambda x: F.substring(_bare(x), 1, 1).isin("-", "*", "•"))),
        "n_ellipsis_lines": _size(F.filter(lines, lambda x: _bare(x).endswith("...") | _bare(x).endswith("…"))),
        "n_repeat_words": covered,
    }
    # a condition that is always true but not deterministic: without it the planner would copy these expressions
    # into every filter on the counts, and the arrays would be made again for each of their elements
    here = F.monotonically_increasing_id() >= 0
    return twice.withColumns({f"_q_{k}": F.when(here, v) for k, v in made.items()})


def compiled(rules: tuple[Rule, ...], prefix: str = "_q_") -> Column:
    """The table as one column: the names of the rules that a row fails, in the table's order."""
    names = []
    for r in rules:
        if r.value not in COUNTS or r.base not in COUNTS:
            raise ValueError(f"rule {r.name} names an unknown count")
        share, base = F.col(prefix + r.value) * 100, F.col(prefix + r.base)
        bad = F.lit(False)
        if r.least is not None:
            bad |= share < base * r.least
        if r.most is not None:
            bad |= share > base * r.most
        names.append(F.when(bad & (base > 0), F.lit(r.name)))
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")


def rules_of(table: DataFrame, most: int = 1_000) -> tuple[Rule, ...]:
    """The threshold table from a DataFrame (name, value, base, least, most), by name; at most ``most``
    rows, since each becomes an expression."""
    rows = table.select(*Rule._fields).orderBy("name").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a threshold table of more than {most} rows")
    return tuple(Rule(*r) for r in rows)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id, the counts, ``base_failed``, ``failed`` (rules of the table) and ``kept``."""
    rows = counts(docs.select("doc_id", F.col("text").alias("_text")), "_text")
    words, repeated = F.col("_q_n_words"), F.col("_q_n_repeat_words")
    base = (words < LEAST_WORDS) | (repeated * 100 > words * MOST_REPEATED)
    return (rows.withColumns({"base_failed": base, "failed": compiled(rules)})
            .select("doc_id", *[F.col(f"_q_{c}").alias(c) for c in COUNTS], "base_failed", "failed",
                    (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept")))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    rows = counts(docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text")), "_text")
    words, repeated = F.col("_q_n_words"), F.col("_q_n_repeat_words")
    good = (words >= LEAST_WORDS) & (repeated * 100 <= words * MOST_REPEATED) & (F.size(compiled(rules)) == 0)
    return rows.filter(good).select("_row.*")


def _oracle_rule(r: Rule) -> str:
    tests = [f"{r.value} * 100 < {r.base} * {r.least}"] * (r.least is not None) + [f"{r.value} * 100 > {r.base} * {r.most}"] * (r.most is not None)
    return f"({r.base} > 0 AND ({' OR '.join(tests)}))"


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT row, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i
      FROM (SELECT row, regexp_extract_all(t, '{WORD}') AS ws FROM d)),
g AS (SELECT row, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY row ORDER BY i)),
r AS (SELECT row, i, count(*) OVER (PARTITION BY row, w, w2, w3) > 1 AS twice FROM g WHERE w3 IS NOT NULL),
p AS (SELECT row, count(DISTINCT i + k)::BIGINT AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE twice GROUP BY row),
a AS (SELECT row, count(*)::BIGINT AS n_words, sum(length(w))::BIGINT AS word_chars,
      count(*) FILTER (regexp_matches(w, '\p{{L}}'))::BIGINT AS n_letter_words,
      count(*) FILTER (lower(w) IN ({', '.join(f"'{w}'" for w in STOP_WORDS)}))::BIGINT AS n_stop_words FROM w GROUP BY row),
l AS (SELECT row, regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS b, x
      FROM (SELECT row, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{WORD}')),
m AS (SELECT row, count(*)::BIGINT AS n_lines, (count(*) - count(DISTINCT x))::BIGINT AS n_dup_lines,
      count(*) FILTER (b[1] IN ('-', '*', '•'))::BIGINT AS n_bullet_lines,
      count(*) FILTER (b LIKE '%...' OR b LIKE '%…')::BIGINT AS n_ellipsis_lines FROM l GROUP BY row),
c AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
      len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols, coalesce(n_letter_words, 0) AS n_letter_words,
      coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
      coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines, coalesce(p.n, 0) AS n_repeat_words
      FROM d LEFT JOIN a USING (row) LEFT JOIN m USING (row) LEFT JOIN p USING (row)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEATED} AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({' OR '.join(_oracle_rule(r) for r in RULES)}) AS kept
FROM b
"""
