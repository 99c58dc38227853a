"""Registered tokenisation and packing queries (and their oracles)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import packing as P
from ..operators import pairs as PR
from ..operators import tokens as K
from ..session import materialize
from ..sources import fixtures as fx
from . import oracle_fixtures as ofx
from .catalog import query
from .queries_corpus import all_chunks, fixed_ts

W = ofx.with_ctes
VOCAB_SIZE = 2000
MAX_LENGTH = 256   # a short window, so that many pairs have several


def _s(c) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.concat_ws(" ", col.cast("array<string>"))


def vocab(spark, sf) -> DataFrame:
    return K.build_vocab(fx.read_table(spark, sf, "documents"), "text", VOCAB_SIZE)


TOKENIZED_SQL = W(ofx.TURN_PAIRS, ofx.vocab(VOCAB_SIZE), ofx.tokenized(MAX_LENGTH))


@query("build_vocab", W(ofx.vocab(VOCAB_SIZE)) + " SELECT token, id FROM vocab")
def q_build_vocab(spark, sf):
    return vocab(spark, sf)


ENCODE_SQL = W(ofx.TURN_PAIRS, ofx.vocab(VOCAB_SIZE), ofx.encode("enc", "turn_pairs", "pair_id", "input_text")) + """
SELECT k AS pair_id, array_to_string(ids, ' ') AS ids, len(ids)::BIGINT AS n_tokens FROM enc"""


@query("encode", ENCODE_SQL)
def q_encode(spark, sf):
    enc = K.encoder_from_vocab(vocab(spark, sf))
    e = K.encode_columns(fx.turn_pairs(spark, sf), {"input_text": "ids"}, enc)
    return e.select("pair_id", _s("ids").alias("ids"), F.size("ids").cast("bigint").alias("n_tokens"))


@query("encode_join", ENCODE_SQL)
def q_encode_join(spark, sf):
    e = K.encode_column_join(fx.turn_pairs(spark, sf), "input_text", "pair_id", vocab(spark, sf))
    return e.select("pair_id", _s("ids").alias("ids"), F.size("ids").cast("bigint").alias("n_tokens"))


# Unpadded rows as the reference's loader script makes them: ids of the
# input, labels = ids of the output (text_target), mask of ones.
RAW_SQL = W(ofx.TURN_PAIRS, ofx.vocab(VOCAB_SIZE),
            ofx.encode("enc_in", "turn_pairs", "pair_id", "input_text"),
            ofx.encode("enc_out", "turn_pairs", "pair_id", "output_text")) + """,
raw AS (
  SELECT i.k AS pair_id, i.ids AS input_ids, list_resize([]::INTEGER[], len(i.ids), 1) AS attention_mask,
         o.ids AS labels
  FROM enc_in i JOIN enc_out o ON i.k = o.k)"""


def raw_turns(spark, sf) -> DataFrame:
    enc = K.encoder_from_vocab(vocab(spark, sf))
    e = K.encode_columns(fx.turn_pairs(spark, sf), {"input_text": "input_ids", "output_text": "labels"}, enc)
    return e.select("pair_id", "input_ids", F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"),
                    "labels")


@query("longest", RAW_SQL + " SELECT coalesce(max(len(input_ids)), 0)::BIGINT AS max_len FROM raw")
def q_longest(spark, sf):
    return K.longest(raw_turns(spark, sf)).select(F.col("max_len").cast("bigint").alias("max_len"))


@query("pad_to_longest", RAW_SQL + """,
m AS (SELECT max(len(input_ids)) AS max_len FROM raw)
SELECT pair_id, array_to_string(list_resize(input_ids, max_len, 0), ' ') AS input_ids,
       array_to_string(list_resize(attention_mask, max_len, 0), ' ') AS attention_mask,
       array_to_string(CASE WHEN len(labels) < max_len THEN list_resize(labels, max_len, -100) ELSE labels END, ' ')
         AS labels
FROM raw, m""")
def q_pad_to_longest(spark, sf):
    p = K.pad_to_longest(raw_turns(spark, sf))
    return p.select("pair_id", _s("input_ids").alias("input_ids"), _s("attention_mask").alias("attention_mask"),
                    _s("labels").alias("labels"))


@query("repair_nulls", RAW_SQL + """
SELECT pair_id,
       array_to_string(list_transform(list_zip(input_ids, range(len(input_ids))),
                                      lambda x: CASE WHEN x[2] % 3 = 2 THEN 0 ELSE x[1] END), ' ') AS input_ids,
       array_to_string(list_transform(list_zip(attention_mask, range(len(attention_mask))),
                                      lambda x: CASE WHEN x[2] % 3 = 2 THEN 0 ELSE x[1] END), ' ') AS attention_mask,
       array_to_string(list_transform(list_zip(labels, range(len(labels))),
                                      lambda x: CASE WHEN x[2] % 3 = 2 THEN -100 ELSE x[1] END), ' ') AS labels
FROM raw""")
def q_repair_nulls(spark, sf):
    raw = raw_turns(spark, sf)
    holes = raw.select("pair_id", *[
        F.transform(c, lambda x, i: F.when(i % 3 == 2, F.lit(None)).otherwise(x)).alias(c)
        for c in ("input_ids", "attention_mask", "labels")])  # every third element null
    r = K.repair_nulls(holes)
    return r.select("pair_id", _s("input_ids").alias("input_ids"), _s("attention_mask").alias("attention_mask"),
                    _s("labels").alias("labels"))


# ---------------------------------------------------------------------------
# packing
# ---------------------------------------------------------------------------

DOC_SIZES_SQL = f"""
doc_sizes AS (
  SELECT doc_id, len(regexp_extract_all(text, '{ofx.TOKEN_PAT}')) AS token_count FROM documents)
"""


def doc_sizes(spark, sf) -> DataFrame:
    d = fx.read_table(spark, sf, "documents")
    return d.select("doc_id", F.size(K.tokens(F.col("text"))).alias("token_count"))


@query("pack_batches", W(DOC_SIZES_SQL, ofx.packed("doc_sizes", "doc_id", "token_count")) +
       " SELECT doc_id, token_count::BIGINT AS token_count, batch_id FROM packed")
def q_pack_batches(spark, sf):
    p = P.pack_batches(doc_sizes(spark, sf), id_col="doc_id")
    return p.select("doc_id", F.col("token_count").cast("bigint").alias("token_count"), "batch_id")


# the walk in the given order: by doc_id, longest first nowhere
IN_ORDER_SQL = ofx.packed("doc_sizes", "doc_id", "token_count").replace("ORDER BY token_count DESC, doc_id", "ORDER BY doc_id")


@query("pack_batches_in_order", W(DOC_SIZES_SQL, IN_ORDER_SQL) +
       " SELECT doc_id, token_count::BIGINT AS token_count, batch_id FROM packed")
def q_pack_batches_in_order(spark, sf):
    p = P.pack_batches_in_order(doc_sizes(spark, sf), "doc_id", id_col="doc_id")
    return p.select("doc_id", "token_count", "batch_id")


@query("batch_stats", W(DOC_SIZES_SQL, ofx.packed("doc_sizes", "doc_id", "token_count")) + """,
sizes AS (SELECT batch_id, count(*) AS n FROM packed GROUP BY batch_id)
SELECT count(*)::BIGINT AS total_batches, coalesce(round(avg(n), 6), 0.0) AS avg_batch_size,
       coalesce(min(n), 0)::BIGINT AS min_batch_size, coalesce(max(n), 0)::BIGINT AS max_batch_size FROM sizes""")
def q_batch_stats(spark, sf):
    return P.batch_stats(P.pack_batches(doc_sizes(spark, sf), id_col="doc_id"))


# ---------------------------------------------------------------------------
# the corpus pairs (the reference's own tokenisation input), full window
# ---------------------------------------------------------------------------

@query("tokenize_windows", TOKENIZED_SQL + f""",
n AS (SELECT pair_id, in_len AS n_in, ids FROM (
  SELECT a.k AS pair_id, len(i.ids) AS in_len, a.ids FROM enc_all a JOIN enc_in i ON a.k = i.k)),
w AS (SELECT *, unnest(range(greatest(1, (len(ids) + {MAX_LENGTH} - 1) // {MAX_LENGTH}))) AS window_no FROM n),
c AS (SELECT *, list_slice(ids, window_no * {MAX_LENGTH} + 1, (window_no + 1) * {MAX_LENGTH}) AS part,
      least(greatest(n_in - window_no * {MAX_LENGTH}, 0), {MAX_LENGTH}) AS masked FROM w)
SELECT pair_id, window_no::BIGINT AS window_no, len(part)::BIGINT AS token_count,
       array_to_string(list_resize(part, {MAX_LENGTH}, 0), ' ') AS input_ids,
       array_to_string(list_resize(list_concat(list_resize([]::INTEGER[], least(masked, len(part)), -100),
                                               list_slice(part, masked + 1, len(part))), {MAX_LENGTH}, -100), ' ') AS labels
FROM c""")
def q_tokenize_windows(spark, sf):
    t = K.tokenize_pairs(fx.turn_pairs(spark, sf), K.encoder_from_vocab(vocab(spark, sf)), max_length=MAX_LENGTH, windows=True)
    return t.select("pair_id", F.col("window_no").cast("bigint").alias("window_no"), F.col("token_count").cast("bigint").alias("token_count"),
                    _s("input_ids").alias("input_ids"), _s("labels").alias("labels"))


CORPUS_VOCAB = 32000
WINDOW_SUMS = ["n_pairs", "n_windows", "total_tokens", "label_tokens", "id_place_sum", "unknown"]
WINDOW_SUMS_DDL = "pair_type string, " + ", ".join(f"{c} long" for c in WINDOW_SUMS)


def _window_sums(batches):
    """Arrow batches of padded windows in, their sums by pair type out (places count from 1 in each window)."""
    import numpy as np

    def count(marks):   # of each row: bits are counted faster than bytes
        return np.bitwise_count(np.packbits(marks, axis=1)).sum(axis=1)
    held: list = []     # numbers of each window; added up for many batches at once
    for b in batches:
        ids, real, labels = (b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) for c in ("input_ids", "attention_mask", "labels"))
        held.append((b.column("pair_type"), b.column("window_no").to_numpy() == 0, b.column("token_count").to_numpy(), count(labels != K.IGNORE_INDEX),
                     np.einsum("ij,j->i", ids * real, np.arange(1, ids.shape[1] + 1)), count((ids == K.UNK_ID) & (real == 1))))
        if len(held) == 64:
            yield _added_up(held)
            held = []
    if held:
        yield _added_up(held)


def _added_up(held: list):
    import numpy as np
    import pyarrow as pa
    kinds, *numbers = zip(*held, strict=True)
    kind = pa.concat_arrays(kinds).dictionary_encode(null_encoding="encode")
    of, n = kind.indices.to_numpy(), len(kind.dictionary)
    new, tokens, labels, places, unknown = (np.concatenate(x) for x in numbers)
    # weights are doubles: these sums are far below 2^53
    sums = [np.bincount(of, x, n).astype(np.int64) for x in (new, np.ones(len(of)), tokens, labels, places, unknown)]
    return pa.RecordBatch.from_arrays([kind.dictionary, *map(pa.array, sums)], names=["pair_type", *WINDOW_SUMS])


@query("tokenize_corpus", W(ofx.JAVA, ofx.DOC_TREE, ofx.TREE_CHUNKS, ofx.ALL_CHUNKS, ofx.pairs_of("all_chunks"),
                            ofx.vocab(CORPUS_VOCAB, "SELECT input_text AS text FROM pairs UNION ALL SELECT output_text FROM pairs")) + f""",
toks AS (
  SELECT pair_type, regexp_extract_all(input_text || chr(10) || chr(10) || 'EXPLANATION:' || chr(10) || output_text, '{ofx.TOKEN_PAT}') AS t,
         len(regexp_extract_all(input_text, '{ofx.TOKEN_PAT}')) AS n_in FROM pairs),
counted AS (
  SELECT pair_type, count(*)::BIGINT AS n_pairs, sum((len(t) + {K.DEFAULT_MAX_LENGTH - 1}) // {K.DEFAULT_MAX_LENGTH})::BIGINT AS n_windows,
         sum(len(t))::BIGINT AS total_tokens, sum(len(t) - n_in)::BIGINT AS label_tokens FROM toks GROUP BY pair_type),
ids AS (
  SELECT pair_type, sum(coalesce(v.id, 1) * ((pos - 1) % {K.DEFAULT_MAX_LENGTH} + 1))::BIGINT AS id_place_sum, count(*) FILTER (v.id IS NULL)::BIGINT AS unknown
  FROM (SELECT pair_type, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM toks) x LEFT JOIN vocab v ON x.token = v.token GROUP BY pair_type)
SELECT * FROM counted JOIN ids USING (pair_type)""")
def q_tokenize_corpus(spark, sf):
    # written: the vocabulary and the ids read the same pairs
    ps = materialize(PR.generate_pairs(all_chunks(spark, sf), fixed_ts()).select("pair_id", "pair_type", "input_text", "output_text"), "corpus-pairs")
    enc = K.encoder_from_vocab(K.build_vocab(ps, ["input_text", "output_text"], CORPUS_VOCAB))
    t = K.tokenize_pairs(ps, enc, max_length=K.DEFAULT_MAX_LENGTH, carry=["pair_type"], windows=True, then=(_window_sums, WINDOW_SUMS_DDL))
    return t.groupBy("pair_type").agg(*[F.sum(c).alias(c) for c in WINDOW_SUMS])


# ---------------------------------------------------------------------------
# whole turn pairs: every token in some window, the vocabulary of the pairs themselves. The queries
# of the same names without "" cut at MAX_LENGTH, as their SQL (and the reference) does.
# ---------------------------------------------------------------------------

WINDOWS_SQL = W(ofx.TURN_PAIRS, ofx.vocab(CORPUS_VOCAB, "SELECT input_text AS text FROM turn_pairs UNION ALL SELECT output_text FROM turn_pairs"),
                ofx.tokenized_windows(MAX_LENGTH))
PACKED_WINDOWS_SQL = WINDOWS_SQL + "," + ofx.packed("windows", "window_id", "token_count").strip()
PAIR_TOTALS_SQL = """pair_totals AS (
  SELECT pair_id, sum(token_count) AS token_count,
         bool_and(list_bool_and(list_transform(labels, lambda x: x = -100))) AS masked FROM windows GROUP BY pair_id)"""


def turn_windows(spark, sf) -> DataFrame:
    ps = fx.turn_pairs(spark, sf)
    texts = ps.select(F.explode(F.array("input_text", "output_text")).alias("text"))
    enc = K.encoder_from_vocab(K.build_vocab(texts, "text", CORPUS_VOCAB))
    t = K.tokenize_pairs(ps, enc, max_length=MAX_LENGTH, windows=True)
    return t.withColumn("window_id", F.concat_ws("#", "pair_id", F.col("window_no").cast("string")))


@query("tokenize_pairs", WINDOWS_SQL + """
SELECT pair_id, window_no, token_count::BIGINT AS token_count, original_length::BIGINT AS original_length,
       array_to_string(input_ids, ' ') AS input_ids, array_to_string(attention_mask, ' ') AS attention_mask,
       array_to_string(labels, ' ') AS labels FROM windows""")
def q_tokenize_pairs(spark, sf):
    return turn_windows(spark, sf).select(
        "pair_id", *[F.col(c).cast("bigint").alias(c) for c in ("window_no", "token_count", "original_length")],
        *[_s(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query("token_stats", WINDOWS_SQL + "," + PAIR_TOTALS_SQL + """
SELECT count(*)::BIGINT AS total_pairs, coalesce(sum(token_count), 0)::BIGINT AS total_tokens,
       coalesce(round(avg(token_count), 6), 0.0) AS avg_tokens_per_pair,
       coalesce(max(token_count), 0)::BIGINT AS max_tokens, coalesce(min(token_count), 0)::BIGINT AS min_tokens,
       count(*) FILTER (WHERE masked)::BIGINT AS fully_masked FROM pair_totals""")
def q_token_stats(spark, sf):
    return K.token_stats(turn_windows(spark, sf))


@query("training_arrays", WINDOWS_SQL + """
SELECT array_to_string(input_ids, ' ') AS input_ids, array_to_string(attention_mask, ' ') AS attention_mask,
       array_to_string(labels, ' ') AS labels FROM windows""")
def q_training_arrays(spark, sf):
    t = K.training_arrays(turn_windows(spark, sf))
    return t.select(*[_s(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query("collate", PACKED_WINDOWS_SQL + """
SELECT p.batch_id, count(*)::BIGINT AS n_rows, string_agg(p.window_id, ' ' ORDER BY p.token_count DESC, p.window_id) AS window_ids,
       sum(p.token_count)::BIGINT AS n_tokens, max(len(w.input_ids))::BIGINT AS width,
       sha256(string_agg(array_to_string(w.input_ids, ' ') || '/' || array_to_string(w.attention_mask, ' ') || '/' || array_to_string(w.labels, ' '), ';'
                         ORDER BY p.token_count DESC, p.window_id)) AS arrays_sha
FROM packed p JOIN windows w ON w.window_id = p.window_id GROUP BY p.batch_id""")
def q_collate(spark, sf):
    t = turn_windows(spark, sf)
    c = P.collate(t, P.pack_batches(t, id_col="window_id"), id_col="window_id")
    return c.select("batch_id", F.size("window_ids").cast("bigint").alias("n_rows"), F.array_join("window_ids", " ").alias("window_ids"),
                    F.aggregate(F.flatten("attention_mask"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_tokens"),
                    F.array_max(F.transform("input_ids", F.size)).cast("bigint").alias("width"),
                    F.sha2(F.array_join(F.zip_with(
                        F.zip_with("input_ids", "attention_mask", lambda i, m: F.concat_ws("/", _s(i), _s(m))),
                        "labels", lambda x, y: F.concat_ws("/", x, _s(y))), ";"), 256).alias("arrays_sha"))


@query("tokenize_report", PACKED_WINDOWS_SQL + "," + PAIR_TOTALS_SQL + """,
sizes AS (SELECT batch_id, count(*) AS n FROM packed GROUP BY batch_id),
ts AS (SELECT count(*)::BIGINT AS total_pairs, coalesce(sum(token_count), 0)::BIGINT AS total_tokens,
              coalesce(round(avg(token_count), 6), 0.0) AS avg_tokens_per_pair FROM pair_totals),
bs AS (SELECT count(*)::BIGINT AS total_batches, coalesce(round(avg(n), 6), 0.0) AS avg_batch_size FROM sizes)
SELECT * FROM ts, bs""")
def q_tokenize_report(spark, sf):
    t = turn_windows(spark, sf)
    st = K.token_stats(t).select("total_pairs", "total_tokens", "avg_tokens_per_pair")
    bs = P.batch_stats(P.pack_batches(t, id_col="window_id")).select("total_batches", "avg_batch_size")
    return st.crossJoin(bs)  # two one-row aggregates
