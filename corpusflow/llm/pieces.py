"""Tables of a SentencePiece BPE vocabulary, shared by the encoder (op 3) and the token counter (op 5).

A merge-order vocabulary tokenises a text in the one way in which every adjacent pair of pieces is
*stable*: encoding the two pieces' joined text gives the two pieces back. ``Pieces.stable`` decides
that for whole arrays of pairs, by taking both pieces apart along their common border, latest merge
first, and asking at each step whether the two border parts would have merged before.
"""

from __future__ import annotations

import ctypes
import gc
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = "▁"
_NEVER = np.int64(1) << 40


def _fields(data: bytes):
    """(number, value) of the fields of a protobuf message."""
    def varint(i):
        value = shift = 0
        while True:
            byte = data[i]
            i, value, shift = i + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, i
    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n, i = (8, i) if key & 7 == 1 else (4, i) if key & 7 == 5 else varint(i)
            value, i = data[i:i + n], i + n
        yield key >> 3, value


@dataclass
class Pieces:
    """Pieces in merge order; ``ids`` are the model's. Index ``unknown`` stands for any character
    that no piece holds; such characters are written as bytes."""

    text: list[str]
    ids: np.ndarray
    byte_ids: np.ndarray
    left: np.ndarray
    right: np.ndarray
    born: np.ndarray
    pair_key: np.ndarray
    pair_to: np.ndarray
    index: dict[str, int]
    longest: int
    blanks: list[list[int]]
    blank_ids: dict[int, int]
    max_id: int
    decoded: list[bytes] = field(default_factory=list)

    @property
    def unknown(self) -> int:
        return len(self.text)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece that a and b merge into, or -1."""
        key = a * np.int64(len(self.text) + 1) + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_to[at], -1)

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of pieces: do they stay as they are side by side?"""
        a, b = a.astype(np.int64), b.astype(np.int64)
        out = np.ones(len(a), bool)
        left_until, right_until = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        rows = np.arange(len(a))
        while len(rows):
            to = self.merged(a, b)
            # the merge across comes first: before the left part goes into its own (it is further
            # left, so it wins a tie) and not after the right part does
            clash = (to >= 0) & (to < left_until) & (to <= right_until)
            out[rows[clash]] = False
            take_left = self.born[a] > self.born[b]
            go = ~clash & ((self.born[a] >= 0) | (self.born[b] >= 0))
            rows, a, b, take_left = rows[go], a[go], b[go], take_left[go]
            left_until = np.where(take_left, self.born[a], left_until[go])
            right_until = np.where(take_left, right_until[go], self.born[b])
            a, b = np.where(take_left, self.right[a], a), np.where(take_left, b, self.left[b])
        return out


def _halves(text: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The last merge of a piece; None if its text is not encoded as the piece itself."""
    parts, last = list(text), None
    while len(parts) > 1:
        found = [(rank[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in rank]
        if not found:
            return None
        k = min(found)[1]
        last = (parts[k], parts[k + 1])
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
    return last


def _blank_merges(n: int, sizes: set[int]) -> list[int]:
    """Pieces of n blanks if all runs in ``sizes`` rank alike, so that the leftmost merge goes first."""
    parts = [1] * n
    while (k := next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in sizes), None)) is not None:
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
    return parts


def load(path: str) -> Pieces:
    """Read a BPE ``.model`` file with identity normalisation and byte fallback. Other kinds of
    models are refused, as are vocabularies outside the rules that the operators rely on."""
    with open(path, "rb") as f:
        model = list(_fields(f.read()))
    trainer = {k: v for n, v in model if n == 2 for k, v in _fields(v)}
    normal = {k: v for n, v in model if n == 3 for k, v in _fields(v)}
    if trainer.get(3) != 2 or not trainer.get(35) or normal.get(1) != b"identity" or normal.get(2) or \
            normal.get(3, 1) != 1 or normal.get(4, 1) != 0 or normal.get(5, 1) != 1:
        raise ValueError("not a byte-fallback BPE model with identity normalisation and a dummy prefix")
    texts, scores, kinds = [], [], []
    for n, v in model:
        if n == 1:
            piece = dict(_fields(v))
            texts.append(piece[1].decode())
            scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
            kinds.append(piece.get(3, 1))
    if 4 in kinds or 5 in kinds:
        raise ValueError("user-defined and unused pieces are not supported")
    normal_ids = [i for i, k in enumerate(kinds) if k == 1]
    runs = {texts[i] for i in normal_ids if len(texts[i]) > 1 and not texts[i].strip(SPACE)}
    longest_space = max(map(len, runs), default=1)
    words = [i for i in normal_ids if texts[i] not in runs]
    tails = [_blank_merges(n, {len(r) for r in runs}) for n in range(4 * longest_space + 1)]
    if any(SPACE in texts[i][1:] for i in words) or \
            any(t != tails[longest_space] * (n // longest_space) + tails[n % longest_space] for n, t in enumerate(tails)) or \
            len({scores[i] for i in normal_ids if texts[i] in runs}) > 1 or \
            max((scores[i] for i in normal_ids if texts[i] in runs), default=-1e30) >= min(scores[i] for i in words if len(texts[i]) > 1):
        raise ValueError("blanks inside pieces, or runs of blanks that do not merge last from the left")
    words.sort(key=lambda i: -scores[i])
    missing = sorted({c for i in words for c in texts[i]} - {texts[i] for i in words})
    text = [texts[i] for i in words] + missing
    index = {t: k for k, t in enumerate(text)}
    rank = {texts[i]: k for k, i in enumerate(words)}
    n = len(text)
    left, right, born = (np.full(n + 1, -1, np.int64) for _ in range(3))
    for k, t in enumerate(text):
        if len(t) > 1:
            halves = _halves(t, rank)
            if halves is None or any(len(h) > 1 and index[h] > k for h in halves):
                raise ValueError(f"piece {t!r} is not made by merges in order")
            left[k], right[k], born[k] = index[halves[0]], index[halves[1]], k
    pairs = sorted((index[t[:c]] * (n + 1) + index[t[c:]], k) for k, t in enumerate(text) for c in range(1, len(t))
                   if t[:c] in index and t[c:] in index)
    byte_ids = np.zeros(256, np.int32)
    for i, k in enumerate(kinds):
        if k == 6:
            byte_ids[int(texts[i][3:5], 16)] = i
    ids = np.array([*words, *[-1] * (len(missing) + 1)], np.int32)
    decoded = [b"" if k in (2, 3) else bytes([int(t[3:5], 16)]) if k == 6 else t.encode() for t, k in zip(texts, kinds, strict=True)]
    return Pieces(text, ids, byte_ids, left, right, born, np.array([p[0] for p in pairs], np.int64),
                  np.array([p[1] for p in pairs], np.int64), index, max(map(len, text)), tails[:longest_space + 1],
                  {len(texts[i]): i for i in normal_ids if not texts[i].strip(SPACE)}, len(texts), decoded)


_SENT: dict[tuple[str, str], object] = {}


def send(spark, path: str):
    """Broadcast of the vocabulary at ``path`` (a few MB, whatever the data), one per application:
    executors need no copy of the file."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SENT:
        _SENT[key] = spark.sparkContext.broadcast(load(path))
    return _SENT[key]


class WordStore:
    """Bounded store of results per word: when it is full, words not met since it was last full go."""

    def __init__(self, most: int):
        self.most, self.now, self.before = most, {}, {}

    def missing(self, words: set[str]) -> list[str]:
        """Words without a result; those found in the older half move to the newer."""
        if len(self.now) + len(words) > self.most and self.now:
            self.now, self.before = {}, self.now
        # the words are gone through, not the store
        out = []
        for w in words.difference(self.now):
            if w in self.before:
                self.now[w] = self.before[w]
            else:
                out.append(w)
        return out


def blocks(texts: list, most: int):
    """Ranges of rows of at most ``most`` characters together (or one row)."""
    a, n = 0, 0
    for k, t in enumerate(texts):
        size = len(t or "")
        if n and n + size > most:
            yield a, k
            a, n = k, 0
        n += size
    if a < len(texts):
        yield a, len(texts)


def text_blocks(column, most: int):
    """(first row, end row, texts) of runs of rows of an Arrow string column with at most ``most`` bytes
    together (or one row), so that only one run at a time becomes Python strings. Null is ''."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + most, side="right")) - 1)
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]
        a = b


def _trim() -> None:
    """What this process holds unused goes back to the machine: Arrow's pool, and the C library's heap (where it is
    glibc, which otherwise keeps what lies below anything that is still used)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def then_released(run):
    """``run``, a task over Arrow batches, and at its end the memory that it no longer uses goes back to the machine: a
    worker that is used again, for other stages, does not carry it along."""
    def released(batches):
        try:
            yield from run(batches)
        finally:
            _trim()
    return released


def cuts_word(pieces: Pieces) -> str:
    """Pattern of the units that can be tokenised alone: no piece reaches across their borders."""
    apart = "".join(sorted(c for c in "\n\t\r" if c not in pieces.index))
    return f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" + (f"|[{apart}]" if apart else "")


def prepared(text: str) -> str:
    """The text as the vocabulary sees it: blanks marked, one put in front."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def blank_run(n: int, pieces: Pieces) -> list[int]:
    """Lengths of the pieces of n blanks that stand alone."""
    most = len(pieces.blanks) - 1
    return pieces.blanks[most] * (n // most) + pieces.blanks[n % most]
