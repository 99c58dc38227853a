"""Tokenisation as Spark jobs.

No pretrained vocabulary is available offline, so the tokenizer is a
vocabulary table built from the corpus (K1): words and single symbols, ids
by frequency. Both split texts by bytes, whole Arrow columns at once (texts beyond ASCII by the pattern, in the JVM).
Encoding (K2) looks up the distinct tokens of a block of texts in the vocabulary, broadcast once (size bounded by
``vocab_size``), so no token is shuffled and none is a Python object; a pure-JVM path (posexplode + join) is available too.
Masking, padding and truncation (K3) are native array expressions.
"""

from __future__ import annotations

import pickle
import uuid
from collections import OrderedDict

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

# The label ignore index and the text joining input and output.
IGNORE_INDEX = -100
EXPLANATION_HEADER = "\n\nEXPLANATION:\n"
DEFAULT_MAX_LENGTH = 1024
SPECIALS = ["<pad>", "<unk>", "<eos>"]
PAD_ID, UNK_ID = 0, 1

# A token is a run of letters/digits/underscore or one other non-space
# character. Whitespace is spelled out so Java, RE2 and Python agree.
_WS = r" \t\n\x0B\f\r"
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + _WS + "]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0)


def _spelled(text: Column) -> Column:
    """The text for ``_block_tokens``: itself if it is ASCII, else its tokens with blanks between (no token holds one).
    A string, not a list: Spark sizes its Arrow batches row by row, which for lists takes the square of a batch's rows."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.array_join(tokens(text), " "))


#: TOKEN_PATTERN over ASCII: 0 white space, 1 part of a word, 2 a token of its own.
_KINDS = bytes(0 if chr(c) in " \t\n\x0b\f\r" else 1 if chr(c).isalnum() or c == ord("_") else 2 for c in range(128)) + bytes([1]) * 128
_BLANKS = bytes(c for c in range(128) if not _KINDS[c])
#: Bytes of texts that are split at once (one row at least).
SPLIT_BYTES = 1 << 21


def _tokens_of(texts):
    """Spelled texts -> (their tokens, one after the other; how many are each text's). Without its white space, the
    column's bytes are the tokens' bytes."""
    import numpy as np
    import pyarrow as pa
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = data[at[0]:at[-1]].to_pybytes() if data is not None else b""
    at = at - at[0]
    kinds, ascii = np.frombuffer(data.translate(_KINDS), np.uint8), data.isascii()
    if not ascii:
        data = np.frombuffer(data, np.uint8)
        split = np.zeros(len(texts), bool)      # texts whose tokens the JVM has found
        split[np.searchsorted(at, np.flatnonzero(data > 127), side="right") - 1] = True
        kinds = np.where(np.repeat(split, np.diff(at)), data != ord(" "), kinds)
    word, some = kinds == 1, kinds != 0
    first = some.copy()
    on = word[1:] & word[:-1]                   # a word goes on from the byte before, in the same text
    on[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))] - 1] = False
    first[1:] &= ~on
    counts = np.zeros(len(texts), np.int64)
    if len(full := np.flatnonzero(at[1:] > at[:-1])):
        counts[full] = np.add.reduceat(first, at[full], dtype=np.int64)
    # bytes to leave out are faster left out by bytes.translate than by an array
    marks = np.frombuffer((some.view(np.uint8) + first).tobytes().translate(None, b"\0"), np.uint8)
    starts = np.append(np.flatnonzero(marks == 2), len(marks))
    kept = data.translate(None, _BLANKS) if ascii else data[some]
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(kept)), counts


def _block_tokens(texts):
    """``_tokens_of`` for blocks of a column's rows."""
    import numpy as np
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in row_blocks(sizes.tolist(), SPLIT_BYTES):
        yield _tokens_of(texts.slice(a, b - a))


def _count_tokens(batches):
    """K1: how often each token is met in a block of texts."""
    import pyarrow as pa
    import pyarrow.compute as pc
    for batch in batches:
        for column in batch.columns:
            for found, _ in _block_tokens(column):
                found = pc.value_counts(found)
                yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["token", "n"])


def build_vocab(texts: DataFrame, column: str | list[str] = "text", vocab_size: int = 32000,
                specials: list[str] | None = None) -> DataFrame:
    """K1: (token, id) for the specials and the most frequent tokens of a column, or of several together.

    Tasks count a block of texts at a time and Spark adds the counts up; the top-N is a
    TakeOrderedAndProject, so only N rows reach the numbering step.
    """
    specials = SPECIALS if specials is None else specials
    n = max(vocab_size - len(specials), 0)
    columns = [column] if isinstance(column, str) else column
    counts = (texts.select(*[_spelled(F.col(c)).alias(f"text{k}") for k, c in enumerate(columns)]).mapInArrow(_count_tokens, "token string, n long")
              .groupBy("token").agg(F.sum("n").alias("freq")))
    top = counts.where(~F.col("token").isin(specials)).orderBy(F.desc("freq"), "token").limit(n)
    w = Window.orderBy(F.desc("freq"), "token")  # over the N kept rows only
    ranked = top.select("token", (F.row_number().over(w) + len(specials) - 1).cast("int").alias("id"))
    spark = texts.sparkSession
    fixed = spark.createDataFrame([(s, i) for i, s in enumerate(specials)], "token string, id int")
    return fixed.unionByName(ranked)


class VocabEncoder:
    """Encoder over a vocabulary dict; the same token rule as ``tokens``."""

    def __init__(self, vocab: dict[str, int], unk_id: int = UNK_ID):
        import regex
        self.vocab = vocab
        self.unk_id = unk_id
        self._pattern = regex.compile(TOKEN_PATTERN)

    def encode_batch(self, texts: list[str | None]) -> list[list[int] | None]:
        """Ids of a few texts on the driver; columns go through ``encode_columns``."""
        get, unk, find = self.vocab.get, self.unk_id, self._pattern.findall
        return [None if t is None else [get(tok, unk) for tok in find(t)] for t in texts]


def encoder_from_vocab(vocab: DataFrame, unk_id: int = UNK_ID) -> VocabEncoder:
    """Collect a vocabulary table (bounded by its build size) into an encoder."""
    return VocabEncoder({r["token"]: int(r["id"]) for r in vocab.collect()}, unk_id)


#: Encoders of this worker, the last few used: a reused worker does not unpickle one for every task.
_ENCODERS: OrderedDict[str, object] = OrderedDict()
_MOST_ENCODERS = 4


def _encoder(token: str, sent):
    if token not in _ENCODERS:
        _ENCODERS[token] = pickle.loads(sent.value)
    _ENCODERS.move_to_end(token)
    while len(_ENCODERS) > _MOST_ENCODERS:
        _ENCODERS.popitem(last=False)
    return _ENCODERS[token]


#: Bytes of texts that a user's encoder is given at once (one row at least): only they and their ids are Python objects.
ENCODE_BYTES = 1 << 20


def row_blocks(sizes: list[int], most: int):
    """(first, end) of runs of rows of at most ``most`` together, or of one row."""
    a, n = 0, 0
    for k, size in enumerate(sizes):
        if n and n + size > most:
            yield a, k
            a, n = k, 0
        n += size
    if a < len(sizes):
        yield a, len(sizes)


def _look_up(texts, known, ids, unk: int):
    """Spelled texts -> lists of ids: a block's distinct tokens are looked up once, and the lists are rebuilt from their
    lengths."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    of = np.append(ids, np.int32(unk))                  # -1: the last, unknown
    flat, lengths = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for found, counts in _block_tokens(texts):
        coded = found.dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
        flat.append(of[place][coded.indices.to_numpy(zero_copy_only=False)])
        lengths.append(counts)
    ends = np.cumsum(np.concatenate(lengths)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat), pa.int32()), mask=texts.is_null())


def _by_vocabulary(df: DataFrame, columns: list[str], encoder: VocabEncoder, keep: list[str], make, schema: T.StructType) -> DataFrame:
    """Tasks split and look up whole columns at once; ``make`` gets batches of (kept columns, a column's lists of ids each)
    and gives those of ``schema``."""
    names = [f"_text{k}" for k in range(len(columns))]
    split = df.select(*keep, *[_spelled(F.col(c)).alias(n) for c, n in zip(columns, names, strict=True)])
    order = sorted(encoder.vocab)
    sent = df.sparkSession.sparkContext.broadcast(pickle.dumps((order, [encoder.vocab[t] for t in order])))
    unk, token = encoder.unk_id, uuid.uuid4().hex

    def run(batches):
        import numpy as np
        import pyarrow as pa
        texts, numbers = _encoder(token, sent)
        known, ids = pa.array(texts, pa.large_string()), np.array(numbers, np.int32)
        return make((batch.columns[:len(keep)], [_look_up(batch.column(len(keep) + k), known, ids, unk) for k in range(len(names))])
                    for batch in batches)
    return split.mapInArrow(run, schema)


def _encode_by_vocabulary(df: DataFrame, columns: dict[str, str], encoder: VocabEncoder, keep: list[str]) -> DataFrame:
    """K2 for a vocabulary."""
    out = list(columns.values())
    # no id is null, which spares array functions a look at each
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(o, T.ArrayType(T.IntegerType(), False)) for o in out])

    def make(found):
        import pyarrow as pa
        for kept, ids in found:
            yield pa.RecordBatch.from_arrays([*kept, *ids], names=keep + out)
    return _by_vocabulary(df, list(columns), encoder, keep, make, schema)


def encode_columns(df: DataFrame, columns: dict[str, str], encoder, keep: list[str] | None = None) -> DataFrame:
    """Add ``out = ids of in`` for each (in -> out) with an object
    that has ``encode_batch``; the encoder is broadcast once per executor. A ``VocabEncoder`` is
    looked up by columns instead, without a Python step per token.
    ``keep`` limits the columns sent back from Python (default: all)."""
    keep = list(df.columns) if keep is None else list(keep)
    if type(encoder) is VocabEncoder:
        return _encode_by_vocabulary(df, columns, encoder, keep)
    spark = df.sparkSession
    # cloudpickle so encoders defined in notebooks or functions travel by value
    bc = spark.sparkContext.broadcast(cloudpickle.dumps(encoder))
    token = uuid.uuid4().hex
    out_fields = [T.StructField(o, T.ArrayType(T.IntegerType())) for o in columns.values()]
    schema = T.StructType([df.schema[c] for c in keep] + out_fields)
    sources, outs = list(columns), list(columns.values())
    sent = [*keep, *[c for c in sources if c not in keep]]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        enc = _encoder(token, bc)  # once per reused Python worker
        kind = pa.list_(pa.int32())
        for batch in batches:
            sizes = sum(pc.fill_null(pc.binary_length(batch.column(sent.index(c))), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in sources)
            for a, b in row_blocks(sizes.tolist(), ENCODE_BYTES):
                part = batch.slice(a, b - a)
                found = [[x.astype(np.int32) if isinstance(x, np.ndarray) else x for x in enc.encode_batch(part.column(sent.index(c)).to_pylist())] for c in sources]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], *[pa.array(x, kind) for x in found]], names=keep + outs)

    return df.select(*sent).mapInArrow(run, schema)


def encode_column_join(df: DataFrame, column: str, key: str, vocab: DataFrame,
                       out: str = "ids", unk_id: int = UNK_ID) -> DataFrame:
    """K2, JVM-only path: posexplode, join on the vocabulary (the planner broadcasts it while it is
    small), ordered regroup per row. Shuffles every token; prefer
    ``encode_columns`` beyond ~1e8 tokens."""
    exploded = df.select(key, F.posexplode(tokens(F.col(column))).alias("pos", "token"))
    looked = exploded.join(vocab, "token", "left")
    regrouped = looked.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(unk_id)).alias("id")))).alias("_p"))
    ids = regrouped.select(key, F.transform("_p", lambda p: p["id"]).alias(out))
    return df.join(ids, key, "left").withColumn(
        out, F.coalesce(F.col(out), F.array().cast(T.ArrayType(T.IntegerType()))))


# ---------------------------------------------------------------------------
# Combining, masking, padding (native array expressions)
# ---------------------------------------------------------------------------

def combine(input_text: Column, output_text: Column) -> Column:
    """X24."""
    return F.concat(input_text, F.lit(EXPLANATION_HEADER), output_text)


def _repeat(value: int, n: Column) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(n, F.lit(0)).cast("int"))


def mask_labels(combined_ids: Column, input_len: Column) -> Column:
    """Ignore index over the input, then the rest of the combined ids."""
    return F.concat(_repeat(IGNORE_INDEX, input_len),
                    F.slice(combined_ids, (input_len + 1).cast("int"), F.greatest(F.size(combined_ids), F.lit(1))))


def pad_or_truncate(ids: Column, labels: Column, max_length: int, pad_id: int = PAD_ID) -> dict[str, Column]:
    """Pad ids / mask / labels to ``max_length`` or cut them."""
    n = F.size(ids)
    short = n < max_length
    pad = F.lit(max_length) - n
    return {
        "input_ids": F.when(short, F.concat(ids, _repeat(pad_id, pad))).otherwise(F.slice(ids, 1, max_length)),
        "attention_mask": F.when(short, F.concat(_repeat(1, n), _repeat(0, pad)))
        .otherwise(_repeat(1, F.lit(max_length))),
        "labels": F.when(short, F.concat(labels, _repeat(IGNORE_INDEX, pad))).otherwise(F.slice(labels, 1, max_length)),
    }


#: Places of windows (of each of their arrays) that a task holds at once (one window at least).
WINDOW_PLACES = 1 << 18


def _spread(starts, counts):
    """The places starts[k], starts[k] + 1, ..., counts[k] of them, of all k in order."""
    import numpy as np
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _made_windows(found, header: list[int], max_length: int, pad_id: int, mask_header: bool, windows: bool, names: list[str]):
    """K3 by columns: batches of (key, carried columns and original length, [ids of inputs, ids of outputs]) in, rows of
    ``tokenize_pairs`` out, a bounded number of places at a time."""
    import numpy as np
    import pyarrow as pa

    def flat(lists):
        ends = lists.offsets.to_numpy().astype(np.int64)
        return lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]], np.diff(ends)

    step = max(WINDOW_PLACES // max_length, 1)
    ends = pa.array(np.arange(step + 1) * max_length, pa.int32())

    def padded(width: int, fill: int, at, values):
        array = np.full(width * max_length, fill, np.int32)
        array[at] = values
        return pa.ListArray.from_arrays(ends[:width + 1], pa.array(array))
    for kept, (inputs, outputs) in found:
        (ins, n_in), (outs, n_out) = flat(inputs), flat(outputs)
        total = n_in + len(header) + n_out
        first = np.cumsum(total) - total            # a pair's tokens: its input's, the header's, its output's
        tokens = np.empty(total.sum(), np.int32)
        tokens[_spread(first, n_in)] = ins
        for k, token in enumerate(header):
            tokens[first + n_in + k] = token
        tokens[_spread(first + n_in + len(header), n_out)] = outs
        masked = n_in + len(header) * mask_header
        each = np.maximum(-(-total // max_length), 1) if windows else np.ones(len(total), np.int64)
        pair = np.repeat(np.arange(len(each)), each)
        number = _spread(np.zeros(len(each), np.int64), each)
        before = number * max_length                # the pair's tokens in earlier windows
        count = np.minimum(total[pair] - before, max_length)
        unlabelled = np.clip(masked[pair] - before, 0, count)
        before += first[pair]
        # a block makes the arrays only, since each call of Arrow costs as much as some windows
        taken = pa.array(pair)
        of_windows = [*(c.take(taken) for c in kept[:-1]), *([pa.array(number, pa.int32())] if windows else []), pa.array(count, pa.int32()), kept[-1].take(taken)]
        for a in range(0, len(pair), step):
            n = count[a:a + step]
            left = np.arange(len(n)) * max_length
            at = _spread(left, n)
            ids = tokens[before[a]:before[a] + len(at)] if windows else tokens[_spread(before[a:a + step], n)]
            labelled = at >= np.repeat(left + unlabelled[a:a + step], n)
            arrays = [padded(len(n), pad_id, at, ids), padded(len(n), 0, at, 1), padded(len(n), IGNORE_INDEX, at[labelled], ids[labelled])]
            others = [c.slice(a, len(n)) for c in of_windows]
            yield pa.RecordBatch.from_arrays([*others[:-2], *arrays, *others[-2:]], names=names)


def tokenize_pairs(pairs: DataFrame, encoder, max_length: int = DEFAULT_MAX_LENGTH,
                   pad_id: int = PAD_ID, mask_header: bool = False,
                   key: str = "pair_id", carry: list[str] | None = None, windows: bool = False,
                   then: tuple | None = None) -> DataFrame:
    """K3: combined text, input-masked labels, pad/truncate, counts.

    A pair beyond ``max_length`` tokens is cut like the reference's, or, with ``windows``, gives
    further rows: ``window_no`` 0, 1, ... of ``max_length`` tokens each, so that no token is lost.

    Rows with a missing input or output are dropped (the reference skips a
    pair whose tokenisation raises). ``mask_header`` also masks the
    EXPLANATION header (decision 12; off by default like the reference).
    ``carry`` columns are passed through unchanged.

    ``then``: a function as for ``mapInArrow`` and its schema, for callers who need less than all rows. It gets Arrow
    batches of these rows, and only what it gives is returned. With a ``VocabEncoder`` the task that has the ids makes the
    padded rows too and hands them over, so that they are never rows of Spark, which copies arrays place by place.
    """
    carry = list(carry or [])
    if then is not None and type(encoder) is not VocabEncoder:
        return tokenize_pairs(pairs, encoder, max_length, pad_id, mask_header, key, carry, windows).mapInArrow(*then)
    base = pairs.where(F.col("input_text").isNotNull() & F.col("output_text").isNotNull()).select(
        key, *carry, "input_text", "output_text",
        (F.length("input_text") + len(EXPLANATION_HEADER) + F.length("output_text")).cast("int")
        .alias("original_length"))
    keep = [key, *carry, "original_length"]   # texts are not sent back from Python
    if isinstance(encoder, VocabEncoder):
        # The token rule never crosses whitespace, and the header is fenced by
        # newlines, so ids(combined) = ids(input) + ids(header) + ids(output):
        # each text is encoded once.
        header_ids = encoder.encode_batch([EXPLANATION_HEADER])[0]
        if then is not None:
            names = [key, *carry, *["window_no"] * windows, "input_ids", "attention_mask", "labels", "token_count", "original_length"]
            return _by_vocabulary(base, ["input_text", "output_text"], encoder, keep, lambda ids: then[0](
                _made_windows(ids, header_ids, max_length, pad_id, mask_header, windows, names)), then[1])
        header = F.array(*[F.lit(i) for i in header_ids]).cast("array<int>")
        enc = encode_columns(base, {"input_text": "_in_ids", "output_text": "_out_ids"}, encoder, keep)
        enc = enc.withColumn("_all_ids", F.concat("_in_ids", header, "_out_ids"))
        if mask_header:
            enc = enc.withColumn("_in_ids", F.concat("_in_ids", header))
    else:
        base = base.withColumn("_combined", combine(F.col("input_text"), F.col("output_text")))
        prompt = "input_text"
        if mask_header:
            base = base.withColumn("_prompt", F.concat(F.col("input_text"), F.lit(EXPLANATION_HEADER)))
            prompt = "_prompt"
        enc = encode_columns(base, {prompt: "_in_ids", "_combined": "_all_ids"}, encoder, keep)
    number = []
    first = F.lit(0)
    if windows:
        number, first = ["window_no"], F.col("window_no") * max_length
        last = F.greatest(F.ceil(F.size("_all_ids") / max_length).cast("int") - 1, F.lit(0))
        enc = enc.withColumn("window_no", F.explode(F.sequence(F.lit(0), last)))
    in_len = F.least(F.greatest(F.size("_in_ids") - first, F.lit(0)), F.lit(max_length))
    comb = F.slice(F.col("_all_ids"), first + 1, max_length)
    staged = enc.select(key, *carry, *number, comb.alias("_comb"), in_len.alias("_in_len"), "original_length")
    padded = pad_or_truncate(F.col("_comb"), mask_labels(F.col("_comb"), F.col("_in_len")), max_length, pad_id)
    return staged.select(
        key, *carry, *number, padded["input_ids"].alias("input_ids"), padded["attention_mask"].alias("attention_mask"),
        padded["labels"].alias("labels"), F.size("_comb").cast("int").alias("token_count"),
        "original_length")


def token_stats(tokenized: DataFrame, key: str = "pair_id") -> DataFrame:
    """A5: count, sum, avg, max, min of token counts (zeros when empty), and
    rows whose labels are all masked (an input filling the window). Windows of one pair
    (a ``window_no`` column) count as that pair, with all its tokens."""
    t = F.col("token_count")
    rows = tokenized.withColumn("_masked", F.size(F.array_remove("labels", IGNORE_INDEX)) == 0)
    if "window_no" in tokenized.columns:
        rows = rows.groupBy(key).agg(F.sum(t).alias("token_count"), F.bool_and("_masked").alias("_masked"))
    return rows.agg(
        F.count(F.lit(1)).alias("total_pairs"),
        F.coalesce(F.sum(t), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.coalesce(F.round(F.avg(t), 6), F.lit(0.0)).alias("avg_tokens_per_pair"),
        F.coalesce(F.max(t), F.lit(0)).cast("bigint").alias("max_tokens"),
        F.coalesce(F.min(t), F.lit(0)).cast("bigint").alias("min_tokens"),
        F.count_if("_masked").alias("fully_masked"),
    )


def longest(df: DataFrame, column: str = "input_ids") -> DataFrame:
    """The global max length (one row; a partial aggregate)."""
    return df.agg(F.coalesce(F.max(F.size(column)), F.lit(0)).alias("max_len"))


def pad_to_longest(df: DataFrame, pad_id: int = PAD_ID) -> DataFrame:
    """Pad ids (pad id) and mask (0) to the global max id length; labels
    to the same length with the ignore index (they may already be longer). The rows are written
    once, so that what made them does not run again for the maximum."""
    df = materialize(df, "pad-rows")
    max_len = F.lit(longest(df).first()["max_len"])  # one scalar
    pad = max_len - F.size("input_ids")
    lab_pad = max_len - F.size("labels")
    return df.select(
        *[c for c in df.columns if c not in ("input_ids", "attention_mask", "labels")],
        F.concat("input_ids", _repeat(pad_id, pad)).alias("input_ids"),
        F.concat("attention_mask", _repeat(0, pad)).alias("attention_mask"),
        F.concat("labels", _repeat(IGNORE_INDEX, lab_pad)).alias("labels"))


def repair_nulls(df: DataFrame, pad_id: int = PAD_ID) -> DataFrame:
    """Null ids -> pad id, null mask -> 0, null labels -> ignore index."""
    return df.withColumns({
        "input_ids": F.transform("input_ids", lambda x: F.coalesce(x, F.lit(pad_id))),
        "attention_mask": F.transform("attention_mask", lambda x: F.coalesce(x, F.lit(0))),
        "labels": F.transform("labels", lambda x: F.coalesce(x, F.lit(IGNORE_INDEX))),
    })


def training_arrays(tokenized: DataFrame) -> DataFrame:
    """The three columns a trainer loads."""
    return tokenized.select("input_ids", "attention_mask", "labels")


def write_tokenized(tokenized: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Tokenised pairs sink (Parquet, or JSON Lines like the reference)."""
    tokenized.write.mode("overwrite").format(fmt).save(path)


def read_training_arrays(spark: SparkSession, train: str, eval_path: str | None = None,
                         fmt: str = "parquet") -> tuple[DataFrame, DataFrame | None]:
    """Load train (and optional eval) arrays, keeping the three columns."""
    tr = training_arrays(spark.read.format(fmt).load(train))
    ev = training_arrays(spark.read.format(fmt).load(eval_path)) if eval_path else None
    return tr, ev
