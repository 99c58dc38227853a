"""Tokenisation and packing: masks, padding, oversize pairs, exact greedy batches."""

import random
from collections import Counter

from pyspark.sql import functions as F

from corpusflow.operators import packing as P
from corpusflow.operators import tokens as K


def sequential(sizes, max_tokens, max_seq):
    """The reference's greedy fold over (id, size) sorted by size desc, id."""
    order = sorted(sizes, key=lambda x: (-x[1], x[0]))
    out, batch, n, tok = {}, -1, 0, 0
    for i, s in order:
        if batch < 0 or n >= max_seq or tok + s > max_tokens:
            batch, n, tok = batch + 1, 0, 0
        out[i] = batch
        n, tok = n + 1, tok + s
    return out


def test_pack_equals_sequential_fold(spark):
    rnd = random.Random(7)
    for max_tokens, max_seq, top in [(2048, 16, 1024), (100, 4, 150), (50, 3, 40)]:
        sizes = [(i, rnd.choice([0, 1, 2, 5, 33, rnd.randint(0, top)])) for i in range(700)]
        df = spark.createDataFrame(sizes, "pair_id long, token_count long")
        got = {r.pair_id: r.batch_id for r in P.pack_batches(df, max_tokens=max_tokens,
                                                             max_sequences=max_seq, num_partitions=5).collect()}
        assert got == sequential(sizes, max_tokens, max_seq)


def test_limits_and_oversize_alone(spark):
    sizes = [(0, 5000), (1, 3000), (2, 10), (3, 10), (4, 10)]
    df = spark.createDataFrame(sizes, "pair_id long, token_count long")
    packed = P.pack_batches(df, max_tokens=2048, max_sequences=2)
    per = {r.batch_id: (r.n, r.t) for r in packed.groupBy("batch_id").agg(
        F.count("*").alias("n"), F.sum("token_count").alias("t")).collect()}
    assert per[0] == (1, 5000) and per[1] == (1, 3000)
    assert all(n <= 2 and (t <= 2048 or n == 1) for n, t in per.values())
    st = P.batch_stats(packed).first()
    assert (st.total_batches, st.min_batch_size, st.max_batch_size) == (4, 1, 2)


def tiny_encoder():
    vocab = {"<pad>": 0, "<unk>": 1, "<eos>": 2, "a": 3, "b": 4, "EXPLANATION": 5, ":": 6}
    return K.VocabEncoder(vocab)


def test_tokenize_pair_masks_and_pads(spark):
    pairs = spark.createDataFrame([("p", "a b", "b a"), ("q", None, "x")], "pair_id string, input_text string, "
                                  "output_text string")
    t = K.tokenize_pairs(pairs, tiny_encoder(), max_length=10).collect()
    assert len(t) == 1          # a row with a missing side is dropped
    r = t[0]
    # "a b\n\nEXPLANATION:\nb a" -> a b EXPLANATION : b a
    assert r.input_ids == [3, 4, 5, 6, 4, 3, 0, 0, 0, 0]
    assert r.attention_mask == [1] * 6 + [0] * 4
    assert r.labels == [-100, -100, 5, 6, 4, 3] + [-100] * 4
    assert (r.token_count, r.original_length) == (6, len("a b\n\nEXPLANATION:\nb a"))
    masked = K.tokenize_pairs(pairs, tiny_encoder(), max_length=10, mask_header=True).first()
    assert masked.labels[:4] == [-100] * 4


def test_oversize_input_is_fully_masked(spark):
    pairs = spark.createDataFrame([("p", " ".join(["a"] * 20), "b")], "pair_id string, input_text string, "
                                  "output_text string")
    t = K.tokenize_pairs(pairs, tiny_encoder(), max_length=8)
    r = t.first()
    assert len(r.input_ids) == 8 and r.labels == [-100] * 8
    assert K.token_stats(t).first().fully_masked == 1


def test_pad_to_longest_and_repair(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 1, 1], [7, 8, 9, 10, 11]), ([4], [1], [5])],
                               "input_ids array<int>, attention_mask array<int>, labels array<int>")
    out = sorted(K.pad_to_longest(df).collect(), key=lambda r: len(r.labels))
    assert out[0].input_ids == [4, 0, 0] and out[0].labels == [5, -100, -100]
    assert out[1].labels == [7, 8, 9, 10, 11]       # labels may stay longer than ids
    holes = spark.createDataFrame([([1, None], [None, 1], [None, 3])],
                                  "input_ids array<int>, attention_mask array<int>, labels array<int>")
    r = K.repair_nulls(holes).first()
    assert (r.input_ids, r.attention_mask, r.labels) == ([1, 0], [0, 1], [-100, 3])


def test_vocab_specials_first(spark):
    texts = spark.createDataFrame([("b b a",), ("b c",)], "text string")
    v = {r.token: r.id for r in K.build_vocab(texts, vocab_size=5).collect()}
    assert v == {"<pad>": 0, "<unk>": 1, "<eos>": 2, "b": 3, "a": 4}


def test_decomposed_encoding_equals_whole_text(spark):
    """ids(input + header + output) == ids(input) + ids(header) + ids(output) for
    the built-in rule: the fast path must equal encoding the combined text."""
    from tests.conftest import SF_SMALL
    from corpusflow.sources import fixtures as fx
    turns = fx.turn_pairs(spark, SF_SMALL)
    vocab = K.build_vocab(fx.read_table(spark, SF_SMALL, "documents"), vocab_size=500)
    fast = K.encoder_from_vocab(vocab)

    class Wrapped:  # any other encoder object takes the generic path
        def __init__(self, inner):
            self.inner = inner

        def encode_batch(self, texts):
            return self.inner.encode_batch(texts)

    for mask_header in (False, True):
        a = K.tokenize_pairs(turns, fast, max_length=64, mask_header=mask_header)
        b = K.tokenize_pairs(turns, Wrapped(fast), max_length=64, mask_header=mask_header)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def in_order(rows, max_tokens, max_seq):
    out, batch, n, tok = {}, -1, 0, 0
    for i, s in rows:
        if batch < 0 or n >= max_seq or tok + s > max_tokens:
            batch, n, tok = batch + 1, 0, 0
        out[i] = batch
        n, tok = n + 1, tok + s
    return out


def test_pack_does_not_depend_on_exchange_reuse(spark):
    rnd = random.Random(8)
    sizes = [(i, rnd.randint(0, 3000)) for i in range(900)]
    df = spark.createDataFrame(sizes, "pair_id long, token_count long").repartition(7)
    want = sequential(sizes, 2048, 16)
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            assert {r.pair_id: r.batch_id for r in P.pack_batches(df, num_partitions=6).collect()} == want
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")


def test_pack_in_given_order_equals_sequential_fold(spark):
    rnd = random.Random(9)
    for n, top, parts in [(600, 400, 7), (300, 3000, 40), (40, 5, 60), (0, 5, 3)]:
        rows = [(i, rnd.randint(0, top)) for i in range(n)]
        rnd.shuffle(rows)
        df = spark.createDataFrame([(k, i, s) for k, (i, s) in enumerate(rows)], "k long, pair_id long, token_count long").repartition(5)
        got = {r.pair_id: r.batch_id for r in P.pack_batches_in_order(df, "k", num_partitions=parts).collect()}
        assert got == in_order(rows, 2048, 16)


def test_windows_lose_no_token(spark):
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice("ab") for _ in range(n))
    rows = [("p", text(20), text(7)), ("q", "a", "b"), ("r", "", ""), ("s", text(6), "")]
    pairs = spark.createDataFrame(rows, "pair_id string, input_text string, output_text string")
    enc = tiny_encoder()
    got = K.tokenize_pairs(pairs, enc, max_length=8, windows=True).orderBy("pair_id", "window_no").collect()
    for key, a, b in rows:
        mine = [r for r in got if r.pair_id == key]
        want = enc.encode_batch([a + K.EXPLANATION_HEADER + b])[0]
        assert [i for r in mine for i in r.input_ids[:r.token_count]] == want
        labels = [i for r in mine for i in r.labels[:r.token_count]]
        n_in = len(enc.encode_batch([a])[0])
        assert labels == [-100] * n_in + want[n_in:]
        assert [r.window_no for r in mine] == list(range(len(mine))) and len(mine) == -(-len(want) // 8)


def test_texts_go_to_python_as_strings_and_split_as_by_the_pattern(spark, monkeypatch):
    """Lists sent to Python cost the square of a batch's rows, so texts are sent, and split as the pattern does."""
    texts = ["", None, " ", "a", "a_b-1 c", "\x0b\x0cx\t\ny\r", "a\x1cb\x00c\x7f", "été x", "  a b", "日本 語x", "\U0001F600\U0001F600", "()", "a" * 50, "  é  "]
    rng = random.Random(5)
    texts += ["".join(rng.choice("ab_1 \t\n\x0b\x1f.(é́日 　\U0001F600") for _ in range(rng.randrange(12))) for _ in range(200)]
    monkeypatch.setattr(K, "SPLIT_BYTES", 64)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    want = {r.id: r.t for r in df.select("id", K.tokens(F.col("text")).alias("t")).collect()}
    counts = Counter(t for v in want.values() for t in v or [])
    vocab = {r.token: r.id for r in K.build_vocab(df, "text", 40).collect()}
    best = sorted((t for t in counts if t not in K.SPECIALS), key=lambda t: (-counts[t], t.encode()))[:37]
    assert vocab == {t: k for k, t in enumerate([*K.SPECIALS, *best])}
    encoded = K.encode_columns(df, {"text": "ids"}, K.VocabEncoder(vocab))
    assert {r.id: r.ids for r in encoded.collect()} == {k: None if v is None else [vocab.get(t, K.UNK_ID) for t in v] for k, v in want.items()}
    sent = encoded._jdf.queryExecution().analyzed().child().schema()
    assert [f.dataType().typeName() for f in sent.fields()] == ["integer", "string", "string"]
