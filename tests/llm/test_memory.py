"""Workers keep neither time nor memory of what is done."""

import time

from corpusflow.llm import pieces


def _resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_a_tasks_end_gives_its_heap_back():
    held = []

    def run(batches):
        texts = [bytes(2000) for _ in range(100_000)]
        held.extend((texts[0], texts[-1]))    # what stays lies at the ends of the heap
        yield from batches
        texts.clear()
    before = _resident()
    for _ in pieces.then_released(run)([1]):
        assert _resident() - before > 100 << 20
    assert _resident() - before < 40 << 20


def test_a_lookup_costs_its_words_and_not_the_store():
    store = pieces.WordStore(1_000_000)
    store.now = {str(k): b"" for k in range(200_000)}
    store.before = {f"a{k}": b"" for k in range(200_000)}
    t = time.perf_counter()
    for _ in range(500):
        assert sorted(store.missing({"1", "a1", "new"})) == ["new"]
    assert time.perf_counter() - t < 0.5
    assert "a1" in store.now
