import random

import numpy as np
import pytest

from corpusflow.llm import minhash

from . import brute


def corpus(seed=5):
    """Chains of edits around the threshold, copies, groups of near copies, shared passages, odd rows."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéxyz") for _ in range(rnd.randrange(2, 7)))
    passage, out = [word() for _ in range(60)], []
    for _ in range(25):
        words = [word() for _ in range(rnd.choice([6, 20, 90, 200]))]
        for _ in range(rnd.choice([1, 2, 8])):
            out.append(" ".join(words))
            words = list(words)
            for _ in range(rnd.randrange(3)):
                words[rnd.randrange(len(words))] = word()
    base = [word() for _ in range(120)]
    for _ in range(60):
        words = list(base)
        words[rnd.randrange(120)] = word()
        out.append(" ".join(words).upper() if rnd.random() < 0.3 else "  ".join(words) + "\n")
    out += [" ".join([*passage, *[word() for _ in range(30)]]) for _ in range(40)]
    out += [None, "", " \t", "one two", "ONE  two", "one two three four", out[0], out[0]]
    rnd.shuffle(out)
    return [(k, t) for k, t in enumerate(out)] + [(3, out[3]), (3, "another text under an old number"), (None, out[5]), (None, "lonely words without any number")]


def test_components_equal_brute_force(spark):
    rows = corpus()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()])) == sorted(map(str, brute.near_duplicates(rows)))


def test_one_row_of_each_group_stays(spark):
    rows = [(k, t) for k, t in corpus(6) if k is not None]
    docs = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "doc_id long, text string, bucket int, node string").repartition(4)
    out = minhash.deduplicate(docs)
    assert out.columns == docs.columns
    want = brute.near_duplicates(rows)
    groups = {c for (_, n, c, _) in want if n}
    kept = [r for r in out.collect() if brute.shingles(r.text)]
    # row 3's texts are two groups with one least doc_id
    assert {r.doc_id for r in kept} == groups
    sets = [brute.shingles(r.text) for r in kept]
    assert len(set(sets)) == len(sets)
    assert sum(not brute.shingles(r.text) for r in out.collect()) == sum(not n for _, n, _, _ in want)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    one, two = minhash.signatures([a, b])
    assert (one == two).mean() == pytest.approx(1500 / 2500, abs=0.08)
    alone = minhash.signatures([b])[0]
    assert (alone == two).all()


def test_words_are_split_and_lowered_as_stated():
    same = ["A b\tc\x0bd\x0ce\rf", "a  B c d e\nf ", " a b c d e f"]
    sets = minhash.shingle_sets(same)
    assert all((s == sets[0]).all() and len(s) == 2 for s in sets)
    assert len(minhash.shingle_sets(["a b   É é"])[0]) == 1
    assert (minhash.shingle_sets(["É x"])[0] != minhash.shingle_sets(["é x"])[0]).all()


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = minhash.near_duplicates(odd_docs)
    assert sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()])) == sorted(map(str, brute.near_duplicates(rows)))
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.deduplicate(no_docs).count() == 0
    out = minhash.deduplicate(odd_docs)
    assert out.columns == odd_docs.columns and out.filter("doc_id = 1").count() == 1
