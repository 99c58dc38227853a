"""Padded windows are made where the ids are: the same rows as by columns, none of them sent to Spark when only sums are wanted."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusflow.operators import tokens as K
from corpusflow.plans import queries_tokens as Q
from tests.conftest import SF_SMALL

VOCAB = {"<pad>": 0, "<unk>": 1, "<eos>": 2, "a": 3, "b": 4, "EXPLANATION": 5, ":": 6, "é": 7}
SCHEMA = ("pair_id string, pair_type string, {}input_ids array<int>, attention_mask array<int>, labels array<int>, "
          "token_count int, original_length int")


def odd_pairs(spark):
    rnd = random.Random(11)
    text = lambda n: " ".join(rnd.choice(["a", "b", "é", "zz", "."]) for _ in range(n))
    rows = [(f"p{k}", rnd.choice(["x", "y", None]), text(rnd.choice([0, 1, 3, 6, 8, 40])), text(rnd.choice([0, 1, 2, 8, 31]))) for k in range(80)]
    rows += [("n1", "x", None, "a"), ("n2", "x", "a", None), ("e", "y", "", "")]
    return spark.createDataFrame(rows, "pair_id string, pair_type string, input_text string, output_text string").repartition(3)


def test_rows_made_in_tasks_equal_those_by_columns(spark):
    pairs, enc = odd_pairs(spark), K.VocabEncoder(VOCAB)
    for length, mask_header, windows in [(8, False, True), (8, True, True), (8, False, False), (5, True, False), (64, False, True), (1, True, True)]:
        same = {"max_length": length, "mask_header": mask_header, "windows": windows, "carry": ["pair_type"], "pad_id": 9}
        want = K.tokenize_pairs(pairs, enc, **same)
        got = K.tokenize_pairs(pairs, enc, **same, then=(lambda batches: batches, SCHEMA.format("window_no int, " * windows)))
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_other_encoders_hand_their_rows_over_too(spark):
    class Other:
        def encode_batch(self, texts):
            return K.VocabEncoder(VOCAB).encode_batch(texts)
    pairs = odd_pairs(spark)
    sums = [K.tokenize_pairs(pairs, enc, max_length=8, carry=["pair_type"], windows=True, then=(Q._window_sums, Q.WINDOW_SUMS_DDL))
            .groupBy("pair_type").sum(*Q.WINDOW_SUMS).collect() for enc in (K.VocabEncoder(VOCAB), Other())]
    assert sorted(map(str, sums[0])) == sorted(map(str, sums[1])) and len(sums[0]) == 3


def test_sums_are_those_of_the_rows(spark):
    pairs, enc = odd_pairs(spark), K.VocabEncoder(VOCAB)
    want: dict = {}
    for r in K.tokenize_pairs(pairs, enc, max_length=8, carry=["pair_type"], windows=True).collect():
        real = r.input_ids[:r.token_count]
        want.setdefault(r.pair_type, Counter()).update(
            n_pairs=r.window_no == 0, n_windows=1, total_tokens=r.token_count, label_tokens=sum(x != K.IGNORE_INDEX for x in r.labels),
            id_place_sum=sum(i * k for k, i in enumerate(real, 1)), unknown=real.count(K.UNK_ID))
    got = K.tokenize_pairs(pairs, enc, max_length=8, carry=["pair_type"], windows=True, then=(Q._window_sums, Q.WINDOW_SUMS_DDL)).collect()
    found: dict = {}
    for r in got:
        found.setdefault(r.pair_type, Counter()).update({c: r[c] for c in Q.WINDOW_SUMS})
    assert found == want


@pytest.mark.parametrize("places", [1, 16, 1 << 10])
def test_a_task_holds_few_places_at_once(monkeypatch, places):
    monkeypatch.setattr(K, "WINDOW_PLACES", places)
    lists = pa.array([[3] * 30, [], [4] * 7], pa.list_(pa.int32()))
    batches = list(K._made_windows([([pa.array(["p", "q", "r"]), pa.array([1, 2, 3], pa.int32())], [lists, lists])], [5, 6], 8, 0, False, True,
                                   ["pair_id", "window_no", "input_ids", "attention_mask", "labels", "token_count", "original_length"]))
    assert max(b.num_rows for b in batches) <= max(places // 8, 1)
    ids = np.concatenate([b["input_ids"].flatten().to_numpy()[b["attention_mask"].flatten().to_numpy() == 1] for b in batches])
    assert ids.tolist() == [3] * 30 + [5, 6] + [3] * 30 + [5, 6] + [4] * 7 + [5, 6] + [4] * 7
    assert [n for b in batches for n in b["window_no"].to_pylist()] == [*range(8), 0, 0, 1]


def test_corpus_windows_are_never_rows_of_spark(spark):
    plan = Q.q_tokenize_corpus(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "array_repeat" not in plan and "explode" not in plan


def test_vocabulary_of_two_columns_is_that_of_all_their_texts(spark):
    pairs = odd_pairs(spark)
    both = pairs.selectExpr("explode(array(input_text, output_text)) AS text")
    assert sorted(K.build_vocab(pairs, ["input_text", "output_text"], 6).collect()) == sorted(K.build_vocab(both, "text", 6).collect())


def test_rows_of_blanks_and_empty_rows_between_split_right():
    texts = ["", "a b", " \t\n", "", "a.b", "x", "", "  ", "y_1 (z"]
    for column in (texts, [*texts, "é"], ["é", *texts]):
        found, counts = K._tokens_of(pa.array(["skipped", *column, "skipped"]).slice(1, len(column)))
        want = [K.VocabEncoder({})._pattern.findall(t) for t in column]
        assert found.to_pylist() == [t for w in want for t in w] and counts.tolist() == [len(w) for w in want]
