from collections import defaultdict

import pytest

from corpusflow.llm import mixing


def water(sizes, weights):
    """Targets by the textbook loop."""
    total, clamped = sum(sizes.values()), {}
    while True:
        rest, open_ = total - sum(clamped.values()), [s for s in sizes if s not in clamped]
        share = {s: weights[s] * rest / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s] or not sizes[s]]
        if not over:
            return {**clamped, **share}
        clamped |= {s: 3 * sizes[s] for s in over}


def test_targets_and_taken(spark):
    rows = [(k, "w " * (1 + k % 7), f"s{k % 5}" if k % 5 else None) for k in range(400)] + [(1000 + k, "a b", "s0") for k in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = water(sizes, {s: k % 3 + 1 for k, s in enumerate(names)})
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 7 for s in names)


def test_reruns_agree_whatever_the_partitions(spark, odd_docs):
    one = sorted(map(str, mixing.mix(odd_docs).drop("order").collect()))
    assert one == sorted(map(str, mixing.mix(odd_docs.repartition(7)).drop("order").collect()))
    assert len(one) == odd_docs.count()


def test_apply_repeats_rows_and_keeps_columns(odd_docs, no_docs):
    out = mixing.apply_mix(odd_docs)
    assert out.schema == odd_docs.schema
    copies = defaultdict(set)
    for r in mixing.mix(odd_docs).collect():
        copies[r.doc_id].add(r.copies)
    seen = defaultdict(int)
    for r in out.collect():
        seen[r.doc_id] += 1
    assert all(seen[i] in copies[i] for i in copies if i != 1)
    assert mixing.apply_mix(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
