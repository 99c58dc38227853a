"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Words of equal length advance together, one position a step. Rolling hashes of all their substrings
probe the sorted keys of the pieces (a substring whose key is no piece's beginning is not grown any
further); at each position the candidates' scores are compared by a vectorised maximum, which also
stores the back pointer. The vocabulary is one of merges in order (BPE), for which the sum of piece
scores would not give the library's segmentation: a candidate counts only if it is stable beside the
piece before it, and then exactly one does, the one that the library's merges end with. (Ids equal
``SentencePieceProcessor.encode`` of the same model; tests compare them.)

Blanks are marked and one is put in front; characters outside the vocabulary become byte pieces.
Decoding joins the pieces, turns marks into blanks, drops the first, and replaces invalid UTF-8.

Defined results: null text encodes and decodes as null text with no ids; empty text has no ids; a
text that holds the mark character itself decodes with a blank in its place, as the library does;
repeated rows are encoded each; other columns pass through, and one of
the result's name is replaced.

Scale: narrow, no shuffle. The vocabulary's tables (a few MB) are broadcast. A task holds one block of texts and a bounded store of encoded words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .pieces import SPACE, Pieces, WordStore, blank_run, cuts_word, prepared, send, text_blocks, then_released
from .transducer import Table

BLOCK_BYTES = 1_000_000
STORE_WORDS = 150_000
BLOCK_ROWS = 500
CELLS = 200_000  # characters of equally long words that advance together
STORE_PAIRS = 260_000
LONG = 512  # characters; a longer unit is encoded in windows of this length
OVERLAP = 128
_B = np.uint64(0x9E3779B97F4A7C15)
_TWO = SPACE * 2


class Encoder:
    """Words -> ids, for one vocabulary."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        starts: dict[str, int] = {}
        for k, t in enumerate(pieces.text):
            for n in range(1, len(t) + 1):
                starts.setdefault(t[:n], -1)
            starts[t] = k
        keys = self._keys(list(starts))
        order = np.argsort(keys)
        self.keys, self.piece = keys[order], np.array(list(starts.values()), np.int64)[order]
        grows = {t[:n] for t in pieces.text for n in range(1, len(t))}
        self.grows = np.array([t in grows for t in starts])[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("substring keys collide; take another multiplier")
        # a character's key is its code plus one: its place, and -1 for all beyond the last that a piece holds
        single = np.array([ord(t) for t in starts if len(t) == 1], np.int64)
        self.of_char = np.full(int(single.max(initial=0)) + 2, -1, np.int64)
        self.of_char[single] = self._probe(single.astype(np.uint64) + np.uint64(1))
        self.known = Table()
        self.store = WordStore(STORE_WORDS)
        self.unit = re.compile(cuts_word(pieces))

    def forget(self) -> None:
        """Empty stores of words and pairs."""
        self.known, self.store = Table(), WordStore(STORE_WORDS)

    @staticmethod
    def _keys(texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.uint64)
        for k, t in enumerate(texts):
            h = 0
            for c in t:
                h = (h * int(_B) + ord(c) + 1) & (1 << 64) - 1
            out[k] = h
        return out

    def _probe(self, keys: np.ndarray) -> np.ndarray:
        """Place in the sorted keys, or -1."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``Pieces.stable`` with a bounded store of pairs met before."""
        n = np.int64(len(self.p.text) + 1)
        key = a.astype(np.int64) * n + b
        at = self.known.find(key)
        new = at < 0
        if new.any():
            fresh = np.unique(key[new])
            if self.known.n + len(fresh) > STORE_PAIRS and self.known.n:
                self.known = Table()
                return self._stable(a, b)
            answer = np.zeros((len(fresh), 2), np.int32)
            answer[:, 0] = self.p.stable(fresh // n, fresh % n)
            self.known.add(fresh, answer)
            at = self.known.find(key)
        return self.known.values[at, 0] > 0

    def segment(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points of equally long words (n x length) -> (back pointers, last pieces), each
        n x (length + 1): length and number of the piece that ends at a position."""
        n, size = chars.shape
        codes = chars.astype(np.uint64) + np.uint64(1)
        most = min(self.p.longest, size)
        found = []  # by length: piece number of each substring, or -1
        state = None
        for span in range(1, most + 1):
            if span == 1:
                key = codes
                at = self.of_char[np.minimum(chars, len(self.of_char) - 1)]
            else:
                key = state[0][:, :-1] * _B + codes[:, span - 1:]
                at = np.full(key.shape, -1, np.int64)
                alive = np.flatnonzero(state[1][:, :-1])
                at.reshape(-1)[alive] = self._probe(key.reshape(-1)[alive])
            hit = at >= 0
            piece = np.where(hit, self.piece[at], -1).astype(np.int32)
            if span == 1:
                piece[piece < 0] = self.p.unknown
            found.append(piece)
            state = key, hit & self.grows[at]
            if not state[1].any():
                break
        back = np.zeros((n, size + 1), np.int8)
        last = np.full((n, size + 1), -1, np.int64)
        for end in range(1, size + 1):
            rows, spans, before, pieces = [], [], [], []
            for span in range(1, min(end, len(found)) + 1):
                piece = found[span - 1][:, end - span]
                r = np.flatnonzero(piece >= 0)
                rows.append(r)
                spans.append(np.full(len(r), span, np.int8))
                before.append(last[r, end - span])
                pieces.append(piece[r])
            rows, spans, before, pieces = map(np.concatenate, (rows, spans, before, pieces))
            score = before < 0
            inner = np.flatnonzero(~score)
            score[inner] = self._stable(before[inner], pieces[inner])
            best = np.zeros(n, np.int8)  # maximum over candidates: stable ones score 1
            np.maximum.at(best, rows[score], spans[score])
            take = score & (best[rows] == spans)
            back[rows[take], end] = spans[take]
            last[rows[take], end] = pieces[take]
        return back, last

    def _ids(self, pieces: np.ndarray, chars: np.ndarray) -> bytes:
        out = self.p.ids[pieces]
        if (out >= 0).all():
            return out.tobytes()
        parts = []
        for i, c in zip(out, chars, strict=True):
            parts.append(np.array([i], np.int32) if i >= 0 else self.p.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))])
        return np.concatenate(parts).tobytes()

    def encode_words(self, words: list[str]) -> None:
        """Put the ids of ``words`` (each a unit of ``cuts_word``) into the store."""
        by_size: dict[int, list[str]] = {}
        for w in words:
            if w[-1] == SPACE:     # blanks only
                self.store.now[w] = self._blanks(len(w))
                continue
            size = len(w)
            if w[:2] == _TWO:
                size = len(w.lstrip(SPACE)) + 1
            if size in by_size:
                by_size[size].append(w)
            else:
                by_size[size] = [w]
        for size, group in by_size.items():
            step = max(1, CELLS // size)
            for a in range(0, len(group), step):
                part = group[a:a + step]
                units = [w if len(w) == size else w[-size:] for w in part]
                chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size)
                back, last = self.segment(chars)
                self._store(part, chars, back, last)

    def _blanks(self, n: int) -> bytes:
        return np.array([self.p.blank_ids[k] for k in blank_run(n, self.p)], np.int32).tobytes()

    @staticmethod
    def _walk(back: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words walked back together: their pieces and the pieces' first characters, -1 before them."""
        n, size = back.shape[0], back.shape[1] - 1
        at = np.full(n, size, np.int64)
        cols = []
        rows = np.arange(n)
        while (at > 0).any():
            go = at > 0
            piece = np.where(go, last[rows, at], -1)
            step = np.where(go, back[rows, at], 0)
            at = at - step
            cols.append((piece, at.copy()))
        return np.stack([c[0] for c in cols[::-1]], 1), np.stack([c[1] for c in cols[::-1]], 1)

    def _with_blanks(self, word: str, got: bytes, first: int) -> bytes:
        """Ids of a word whose blanks but the last are not in ``got``; ``first`` is its first piece."""
        blanks = len(word) - len(word.lstrip(SPACE))
        if blanks <= 1:
            return got
        # blanks merge last: the one before the word stays with them if the word left it alone
        return self._blanks(blanks) + got[4:] if first == self.p.index.get(SPACE) else self._blanks(blanks - 1) + got

    def _store(self, words: list[str], chars: np.ndarray, back: np.ndarray, last: np.ndarray) -> None:
        pieces, starts = self._walk(back, last)
        counts = (pieces >= 0).sum(1)
        flat = pieces[pieces >= 0]
        ids = self.p.ids[flat]
        ends = np.cumsum(counts)    # every word has a piece
        plain = np.add.reduceat(ids < 0, np.concatenate([[0], ends[:-1]])) == 0
        data = ids.astype(np.int32).tobytes()
        now, a = self.store.now, 0
        for k, (w, b, whole) in enumerate(zip(words, ends.tolist(), plain.tolist(), strict=True)):
            got = data[4 * a:4 * b] if whole else self._ids(flat[a:b], chars[k, starts[k][pieces[k] >= 0]])
            now[w] = self._with_blanks(w, got, flat[a]) if w[:2] == _TWO else got
            a = b

    def long_word(self, word: str) -> bytes:
        """Ids of a unit of any length. Overlapping windows advance together. A piece that two neighbouring
        windows both have joins them: beside it the one's pieces before and the other's behind are
        stable, so the joined pieces are the unit's. Windows without one are encoded as one."""
        body = word.lstrip(SPACE)
        unit = word[-(len(body) + (len(body) < len(word))):] if body else ""
        if not unit:
            return self._blanks(len(word))
        chars = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = len(chars)
        begins = np.append(np.arange(0, size - LONG, LONG - OVERLAP), size - LONG) if size > LONG else np.zeros(1, np.int64)
        found, step = [], max(1, CELLS // LONG)
        for k in range(0, len(begins), step):
            grid = chars[begins[k:k + step, None] + np.arange(min(LONG, size))]
            pieces, starts = self._walk(*self.segment(grid))
            found += [(p[p >= 0], s[p >= 0] + g) for p, s, g in zip(pieces, starts, begins[k:k + step], strict=True)]
        pieces, starts = [found[0][0]], [found[0][1]]
        for p, s in found[1:]:
            # (first character, piece) names a place; the piece gives its end
            both = np.intersect1d(starts[-1] * np.int64(1 << 31) + pieces[-1], s * np.int64(1 << 31) + p)
            if not len(both):
                whole, where = self._walk(*self.segment(chars[None, :]))
                pieces, starts = [whole[0][whole[0] >= 0]], [where[0][whole[0] >= 0]]
                break
            first = both[0] >> 31
            keep = starts[-1] <= first
            pieces[-1], starts[-1] = pieces[-1][keep], starts[-1][keep]
            pieces.append(p[s > first])
            starts.append(s[s > first])
        flat, where = np.concatenate(pieces), np.concatenate(starts)
        return self._with_blanks(word, self._ids(flat, chars[where]), flat[0])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        units = [self.unit.findall(prepared(t)) for t in texts]
        distinct = set().union(*units)
        # long units are not kept: the store is bounded by words
        long = {u: self.long_word(u) for u in distinct if len(u) > LONG}
        if new := self.store.missing(distinct - long.keys()):
            self.encode_words(new)
        get = self.store.now.__getitem__
        if long:
            get = lambda u: long[u] if u in long else self.store.now[u]
        return [np.frombuffer(b"".join(map(get, u)), np.int32) for u in units]


def decoded(pieces: Pieces, ids: np.ndarray) -> str:
    """Text of ids."""
    return _text(b"".join(map(pieces.decoded.__getitem__, ids.tolist())))


def _text(joined: bytes) -> str:
    """Text of joined pieces. The blank that encoding put in front goes."""
    text = joined.decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, pieces) -> Encoder:
    """One encoder, with its store of words, per process and vocabulary. ``pieces`` makes the tables."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(pieces())
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "token_ids", keep_store: bool = True) -> DataFrame:
    """``docs`` with ``out``: the ids of column ``text`` (null for null). Without ``keep_store`` a task leaves its
    words and pairs behind at its end, so that its worker has the memory for other stages."""
    docs = docs.drop(out)
    names, sent = docs.columns, send(docs.sparkSession, path)
    arrow = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, lambda: sent.value)
        for batch in batches:
            column = batch.column(at)
            for a, b, texts in text_blocks(column, BLOCK_BYTES):
                ids = enc.encode(texts)
                sizes = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(ids), pa.int32()),
                                                 mask=column.slice(a, b - a).is_null())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, lists], names=[*names, out])
        if not keep_store:
            enc.forget()
    return docs.mapInArrow(then_released(run), arrow)


def decode(encoded: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out``: the text of column ``ids`` (null for null)."""
    encoded = encoded.drop(out)
    names, sent = encoded.columns, send(encoded.sparkSession, path)
    arrow = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(sent.value.decoded, pa.binary())
        for batch in batches:
            col = batch.column(at)
            starts, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
            live = col.is_valid().to_numpy(zero_copy_only=False)
            for a in range(0, len(col), BLOCK_ROWS):
                b = min(a + BLOCK_ROWS, len(col))
                # the pieces' bytes, one after the other, and where each begins
                joined = table.take(pa.array(flat[starts[a]:starts[b]]))
                begins = np.frombuffer(joined.buffers()[1], np.int32)[starts[a:b + 1] - starts[a]].tolist() if len(joined) else [0] * (b - a + 1)
                data = memoryview(joined.buffers()[2] or b"")
                texts = [_text(bytes(data[x:y])) if ok else None for x, y, ok in zip(begins[:-1], begins[1:], live[a:b], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(texts, pa.string())], names=[*names, out])
    return encoded.mapInArrow(run, arrow)
