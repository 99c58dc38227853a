"""Units of any length, wide ids, and archives read by many tasks."""

import base64
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from corpusflow.llm import parsing, pieces, transducer, viterbi, warc
from corpusflow.llm.common import key_ranges

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return viterbi.Encoder(pieces.load(PATH)), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_unbroken_runs_equal_the_library(both):
    encoder, library = both
    rng = random.Random(4)
    texts = ["a" * 5_000, "ab" * 3_000, "é日\U0001F600" * 900, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40_000)),
             base64.b64encode(rng.randbytes(30_000)).decode(), "the" * 700, "    " + "x9" * 600, "word " * 3 + "=" * 3_000 + " end",
             "".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(2_000)), "p" * 512, "p" * 513, " " * 600 + "q" * 600]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text), text[:20]
    assert not any(len(w) > viterbi.LONG for w in encoder.store.now)


def test_windows_without_a_common_piece_are_encoded_whole(both, monkeypatch):
    encoder, library = both
    monkeypatch.setattr(viterbi, "LONG", 24)
    monkeypatch.setattr(viterbi, "OVERLAP", 1)
    text = "incomprehensibilities" * 9 + "notwithstanding" * 5
    assert encoder.encode([text])[0].tolist() == library.encode(text)


def test_a_million_characters_in_seconds(both):
    encoder, library = both
    text = base64.b64encode(random.Random(1).randbytes(750_000)).decode()
    t = time.perf_counter()
    ids = encoder.encode([text])[0]
    assert time.perf_counter() - t < 60
    assert ids.tolist() == library.encode(text)


WIDE = [-2**63, -5, 0, 7, 2**62, 2**63 - 1]


def test_wide_ids(spark):
    df = spark.createDataFrame([(i, f"text {i} " * 30, f"<p>{i}</p>" * 40) for i in WIDE], "doc_id long, text string, html string").repartition(3)
    weighed = df.selectExpr("doc_id", "1L as w")
    bounds = key_ranges(weighed, "doc_id", "w", 1)
    assert bounds == sorted(bounds) and len(bounds) == len(WIDE)
    got = parsing.fingerprint(df).collect()
    assert sorted(r.doc_id for r in got) == WIDE
    root = warc.fresh_root(spark)
    warc.write(df.selectExpr("doc_id as page_id", "'u' as url", "html"), root)
    assert sorted(r.page_id for r in warc.read(spark, root).collect()) == WIDE


def test_archives_are_read_by_many_tasks(spark):
    pages = spark.range(400).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(cast(id as string), 400) as html")
    root = warc.fresh_root(spark)
    manifest = warc.write(pages, root, shard_bytes=20_000)
    read = warc.read(spark, root)
    files = manifest.count()
    assert files > 8 and read.rdd.getNumPartitions() == files and read.count() == 400


def test_chunk_maps_compose_in_any_tree(both, monkeypatch):
    _, library = both
    machine = transducer.Transducer(pieces.load(PATH))
    rng = random.Random(8)
    units = ["onhaer" * 90, "=" * 1001, "a" * 65, "é日\U0001F600" * 300, *("".join(rng.choice(a) for _ in range(rng.randrange(70, 3_000)))
             for a in ("=-", "ab", "thesnaor", "0123456789", "é日a=") for _ in range(8))]
    want = [len(x) - len(library.encode("\n")) for x in library.encode(["\n" + u for u in units])]
    for chunk, guess, rounds in ((64, 32, 16), (64, 32, 0), (7, 0, 0), (3, 2, 1), (64, 0, 2)):
        for name, value in (("CHUNK", chunk), ("GUESS", guess), ("ROUNDS", rounds)):
            monkeypatch.setattr(transducer, name, value)
        assert machine.count_long(units).tolist() == want
        assert [machine.count_long([u])[0] for u in units[:6]] == want[:6]


def test_chunk_maps_gain_one_entry_a_level_at_most(both, monkeypatch):
    machine = transducer.Transducer(pieces.load(PATH))
    monkeypatch.setattr(transducer, "GUESS", 0)
    monkeypatch.setattr(transducer, "ROUNDS", 0)
    codes = np.array([ord(c) for c in "=-" * 4_001 + "=" * 9_999], np.int64)
    starts = np.arange(0, len(codes), 7)
    maps = transducer.ChunkMaps(machine, codes, starts, np.minimum(7, len(codes) - starts), starts)
    upto = maps.scan()
    assert maps.runs <= len(starts) * len(maps.maps)
    # the scan's value at every chunk is that of a walk from the start
    state, total = np.zeros(1, np.int64), 0
    for a, n in list(zip(starts.tolist(), upto.tolist(), strict=True))[:600]:
        state, more = machine.run(codes, np.array([a]), np.array([min(7, len(codes) - a)]), state)
        total += int(more[0])
        assert total == n


def test_counts_of_a_million_characters(both):
    _, library = both
    machine = transducer.Transducer(pieces.load(PATH))
    texts = [base64.b64encode(random.Random(1).randbytes(750_000)).decode(), "=" * 1_000_000]
    assert machine.counts(texts) == [len(library.encode(t)) for t in texts]
