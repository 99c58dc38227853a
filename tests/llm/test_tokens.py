import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from corpusflow.llm import pieces, transducer, viterbi

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\n x", "   é  ", "日本語テスト 漢字", "\U0001F600 hi \x00\x01", "a\tb", "▁▁x", " " * 15, " " * 31 + "x",
       " " * 40 + "the", "<s></s><unk>", "=" * 1000 + "-" * 777, "a" * 70, "ab" * 1000, "\r\n  \r\nx", "  日 ", "    \U0001F600", "naïve café ﬁ", "<0x41>",
       "thequickbrownfox" * 300]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def table():
    return pieces.load(PATH)


def random_texts():
    rnd = random.Random(1)
    return ["".join(rnd.choice(a) for _ in range(rnd.choice([3, 10, 80, 500]))) for a in ("ab", "=-", "on e", "a1/ ", "aé日 ▁\n", "thesnao r") for _ in range(60)]


def test_ids_and_texts_equal_the_library(library, table):
    enc = viterbi.Encoder(pieces.load(vocabulary()))
    texts = ODD + random_texts()
    for text, ids, want in zip(texts, enc.encode(texts), library.encode(texts), strict=True):
        assert ids.tolist() == want
        assert viterbi.decoded(table, ids) == library.decode(want)


def test_counts_equal_the_library(library, table):
    machine = transducer.Transducer(table)
    texts = ODD + random_texts()
    want = [len(x) for x in library.encode(texts)]
    assert machine.counts(texts) == want
    machine.reset()
    machine.store = pieces.WordStore(10)  # stores that overflow change nothing
    assert [machine.counts([t])[0] for t in texts] == want


def test_long_units_without_a_synchronising_border(library, table):
    machine = transducer.Transducer(table)
    transducer_rounds, transducer.ROUNDS = transducer.ROUNDS, 0  # walk the chunks one by one
    try:
        assert machine.counts(["=" * 1001, "onhaer" * 90]) == [len(x) for x in library.encode(["=" * 1001, "onhaer" * 90])]
    finally:
        transducer.ROUNDS = transducer_rounds


def test_stable_pairs_by_brute_force(table):
    rank = {t: k for k, t in enumerate(table.text)}

    def merged(s):
        parts = list(s)
        while found := [(rank[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in rank]:
            k = min(found)[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3000, 3000), rng.integers(0, 3000, 3000)
    for x, y, ok in zip(a, b, table.stable(a, b), strict=True):
        assert ok == (merged(table.text[x] + table.text[y]) == [table.text[x], table.text[y]])


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"\x1a\x00")
    with pytest.raises(ValueError):
        pieces.load(str(tmp_path / "m"))


def test_operators_on_odd_rows(spark, odd_docs, no_docs, library):
    done = viterbi.decode(viterbi.encode(odd_docs.withColumn("token_ids", odd_docs.size), PATH), PATH)
    assert done.columns == [*odd_docs.columns, "token_ids", "decoded"]
    for r in done.collect():
        assert r.token_ids == (None if r.text is None else library.encode(r.text)) and r.decoded == r.text
    for r in transducer.count(odd_docs, PATH).join(odd_docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.n_tokens == len(library.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode())
        assert r.over_limit == (r.n_tokens > 4096)
    assert viterbi.encode(no_docs, PATH).count() == 0 and transducer.count(no_docs, PATH).count() == 0


def test_store_is_left_behind_only_when_asked(spark):
    """Same ids with and without the store; the encoder itself forgets and goes on."""
    from corpusflow.llm import pieces, viterbi
    from corpusflow.llm.queries import vocabulary
    docs = spark.createDataFrame([(k, f"word{k % 7} and größe {k} def f(x): return x") for k in range(60)], "doc_id long, text string").repartition(3)
    ids = [{r.doc_id: r.token_ids for r in viterbi.encode(docs, vocabulary(), keep_store=keep).collect()} for keep in (True, False, False)]
    assert ids[0] == ids[1] == ids[2]
    enc = viterbi.Encoder(pieces.load(vocabulary()))
    first = enc.encode(["some words"])[0].tolist()
    enc.forget()
    assert not enc.store.now and not enc.known.n and enc.encode(["some words"])[0].tolist() == first
