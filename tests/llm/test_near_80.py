"""Near-duplicates at the similarity asked for."""

import pytest

from corpusflow.llm import minhash

from . import brute
from .test_minhash import corpus


def groups(rows, similarity):
    """(doc_id, component_id) of all pairs compared."""
    sets = [brute.shingles(t) for _, t in rows]
    linked = [(j, k) for k, s in enumerate(sets) for j in range(k) if s and sets[j]
              and 100 * len(s & sets[j]) >= similarity * len(s | sets[j])]
    return [(i, c) for (i, _), c in zip(rows, brute.components([i for i, _ in rows], linked), strict=True)]


def test_bands_follow_from_similarity():
    assert minhash.banding(85) == (7, 48)
    for similarity in range(5, 101):
        rows, bands = minhash.banding(similarity)
        assert (1 - (similarity / 100) ** rows) ** bands <= 1e-8 and rows * bands <= minhash.COORDINATES
    for similarity in (-1, 0, 1, 101):
        with pytest.raises(ValueError):
            minhash.banding(similarity)


@pytest.mark.parametrize("similarity", [80, 50])
def test_components_equal_brute_force(spark, similarity):
    rows = corpus(8)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), similarity)
    assert sorted(map(str, [(r.doc_id, r.component_id) for r in got.collect()])) == sorted(map(str, groups(rows, similarity)))


def test_edited_copies_go_at_80(spark):
    words = [f"w{k}" for k in range(90)]
    edited = [*words[:-9], *(f"x{k}" for k in range(9))]  # 77 of 95 shingles in common
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[:60]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in minhash.deduplicate(docs, 80).collect()}
    assert kept == {i for i, c in groups(rows, 80) if i == c} == {1, 3}
