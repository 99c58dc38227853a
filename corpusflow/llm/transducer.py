"""Token counts from a finite-state tokenizer.

A merge-order vocabulary is compiled into a deterministic transducer. A state holds, for each place
where a piece may still be growing, the trie node reached since, the piece that ends there, and how
many tokens fewer that place has than the present one; a transition reads one character and is
annotated with the tokens that the prefix's encoding gains (which may be negative: the sum
telescopes to the count of the whole). States are made when a text first needs them. A text falls
into units that no piece reaches across, so a unit starts in the start state; all units of a block
step together. Units longer than CHUNK characters are cut into chunks, and a chunk is a map from the state
that it is entered in to its exit and the tokens gained. A map is kept for the entry states that can matter: a
guess (the state after the characters just before the chunk), then what the maps to its left lead to. The maps of
all chunks of all long units of a block are composed by a parallel prefix scan: the up-sweep joins neighbouring
segments two by two, all pairs of a level at once, and looks up (or adds) the right map's value at the left map's
exit; the down-sweep gives each chunk the state in which it is really entered and the tokens before it. A unit's
first chunk maps every entry to what the start state gives, so units need no scans of their own: their counts are
differences of the scan. Runs of chunks that are equal share one map. A level adds one entry state at most for each
chunk, so a text of n characters costs O(n log n) steps even where no border synchronises.

Counts equal ``len(SentencePieceProcessor.encode(text))`` of the same model; tests compare them.

Defined results: null text counts as empty; empty text has 0 tokens; repeated rows are counted each;
other columns are ignored.

Scale: narrow, no shuffle; the vocabulary's tables (a few MB) are broadcast; states, transitions and
stored words are bounded per Python worker (they are dropped and made anew when the bound is met).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import SPACE, Pieces, WordStore, blank_run, cuts_word, prepared, send, text_blocks

BLOCK_BYTES = 4_000_000
STORE_WORDS = 300_000
MOST_STATES = 300_000
CHUNK, GUESS, ROUNDS = 64, 32, 16


class Table:
    """Open-addressing hash table of int64 keys to two int32 values, probed by whole arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros((1 << bits, 2), np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        at, mask = self._slot(keys), (1 << self.bits) - 1
        met = self.keys[at]
        todo = np.flatnonzero((met != keys) & (met >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            met[todo] = self.keys[at[todo]]
            todo = todo[(met[todo] != keys[todo]) & (met[todo] >= 0)]
        return np.where(met == keys, at, -1)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the table."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old, kept = self.keys >= 0, (self.keys, self.values)
            while 2 * (self.n + len(keys)) > 1 << self.bits:
                self.bits += 1
            self.keys, self.values, self.n = np.full(1 << self.bits, -1, np.int64), np.zeros((1 << self.bits, 2), np.int32), 0
            self.add(kept[0][old], kept[1][old])
        at, mask, left = self._slot(keys), (1 << self.bits) - 1, np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            placed = free[self.keys[at[free]] == keys[free]]
            self.values[at[placed]] = values[placed]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & mask
        self.n += len(keys)


_ZERO = 1 << 15


def _entry(node: int, before: int, behind: int) -> int:
    """A place where a piece may be growing: trie node, piece that ends there (-1 for none), and the
    tokens by which its count falls behind the present one's."""
    return node << 40 | before + 1 << 16 | behind + _ZERO


class Transducer:
    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for k, t in enumerate(pieces.text):
            node = 0
            for c in t:
                self.inner[node] = True
                node = self.child.setdefault(node << 21 | ord(c), len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[node] = k
        self.store = WordStore(STORE_WORDS)
        self.unit = re.compile(cuts_word(pieces))
        self.reset()

    def reset(self) -> None:
        """Only the start state: nothing read, no piece before."""
        start = (_entry(0, -1, 0),)
        self.states, self.number, self.moves = [start], {start: 0}, Table()
        self.pairs: dict[int, bool] = {}

    def _compile(self, keys: np.ndarray) -> None:
        """Make the transitions (state, character) in ``keys``."""
        grown, unknown = [], set()
        child_of, token, pairs, many = self.child.get, self.token, self.pairs, len(self.p.text) + 1
        for key in keys.tolist():
            c, steps = key & 0x1FFFFF, []
            for entry in self.states[key >> 21]:
                if (child := child_of(entry >> 40 << 21 | c)) is not None:
                    tok, before = token[child], (entry >> 16 & 0xFFFFFF) - 1
                    pair = before * many + tok if tok >= 0 and before >= 0 else -1 if tok >= 0 else -2
                    steps.append((child, entry & 0xFFFFFFFFFF, tok, pair))
                    if pair >= 0 and pair not in pairs:
                        unknown.add(pair)
            grown.append(steps)
        if unknown:
            ask = np.array(list(unknown), np.int64)
            pairs.update(zip(ask.tolist(), self.p.stable(ask // many, ask % many).tolist(), strict=True))
        values, inner, number, states = [], self.inner, self.number, self.states
        for key, steps in zip(keys.tolist(), grown, strict=True):
            last, gain = self.p.unknown, len(chr(key & 0x1FFFFF).encode("utf-8", "surrogatepass"))
            for _, rest, tok, pair in steps:
                if pair == -1 or pair >= 0 and pairs[pair]:
                    # the one piece that the prefix's encoding now ends with
                    last, gain = tok, (rest & 0xFFFF) - _ZERO + (1 if self.p.ids[tok] >= 0 else gain)
                    break
            state = (*[(n << 40 | rest) - gain for n, rest, _, _ in steps if inner[n]], _entry(0, last, 0))
            at = number.setdefault(state, len(states))
            if at == len(states):
                states.append(state)
            values.append((at, gain))
        self.moves.add(keys, np.array(values, np.int32))

    def run(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Step all ranges of ``codes`` together: (exit states, tokens gained)."""
        order = np.argsort(-sizes, kind="stable")
        at, state = starts[order], entry[order].astype(np.int64)
        gained = np.zeros(len(order), np.int64)
        live = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
        for step, n in enumerate(live.tolist()):
            keys = state[:n] << 21 | codes[at[:n] + step]
            slot = self.moves.find(keys)
            if (slot < 0).any():
                self._compile(np.unique(keys[slot < 0]))
                slot = self.moves.find(keys)
            got = self.moves.values[slot]
            state[:n] = got[:, 0]
            gained[:n] += got[:, 1]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], gained[back]

    def count_long(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit, by one scan over the chunks of all."""
        lengths = np.array([len(u) for u in units], np.int64)
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        chunks = -(-lengths // CHUNK)
        last = np.cumsum(chunks) - 1
        place = (np.arange(int(chunks.sum())) - np.repeat(last + 1 - chunks, chunks)) * CHUNK
        starts = np.repeat(np.cumsum(lengths) - lengths, chunks) + place
        sizes = np.minimum(CHUNK, np.repeat(lengths, chunks) - place)
        upto = ChunkMaps(self, codes, starts, sizes, place).scan()
        return np.diff(upto[last], prepend=0)

    def count_words(self, words: list[str]) -> None:
        """Put the counts of units into the store."""
        if len(self.states) > MOST_STATES:
            self.reset()
        plain = []
        for w in words:
            body = w.lstrip(SPACE)
            blanks = len(w) - len(body)
            if not body:
                self.store.now[w] = len(blank_run(blanks, self.p))
            else:
                plain.append((w, w[blanks - 1:] if blanks else w, blanks))
        short = [x for x in plain if len(x[1]) <= CHUNK]
        if short:
            sizes = np.array([len(u) for _, u, _ in short], np.int64)
            codes = np.frombuffer("".join(u for _, u, _ in short).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            _, tokens = self.run(codes, np.cumsum(sizes) - sizes, sizes, np.zeros(len(short), np.int64))
            for (w, u, blanks), n in zip(short, tokens.tolist(), strict=True):
                self.store.now[w] = n if blanks < 2 else n + self._more_blanks(u, blanks)
        long = [x for x in plain if len(x[1]) > CHUNK]
        if long:
            for (w, u, blanks), n in zip(long, self.count_long([u for _, u, _ in long]).tolist(), strict=True):
                self.store.now[w] = n if blanks < 2 else n + self._more_blanks(u, blanks)

    def _more_blanks(self, unit: str, blanks: int) -> int:
        """Tokens that the blanks before a marked word add to the word's own. Blanks merge last, so
        only the one next to the word can be in its first piece."""
        alone = self._alone(unit)
        return len(blank_run(blanks, self.p)) - 1 if alone else len(blank_run(blanks - 1, self.p))

    def _alone(self, unit: str) -> bool:
        """Is the mark a token of its own? Follow the unit's encoding back from its end."""
        state, last = 0, [-1]
        for c in unit:
            key = np.array([state << 21 | ord(c)], np.int64)
            if self.moves.find(key)[0] < 0:
                self._compile(key)
            state = int(self.moves.values[self.moves.find(key)[0], 0])
            last.append((self.states[state][-1] >> 16 & 0xFFFFFF) - 1)
        at = len(unit)
        while at > 1:
            at -= 1 if last[at] == self.p.unknown else len(self.p.text[last[at]])
        return at == 1

    def counts(self, texts: list[str]) -> list[int]:
        units = [self.unit.findall(prepared(t)) for t in texts]
        if new := self.store.missing(set().union(*units)):
            self.count_words(new)
        get = self.store.now.__getitem__
        return [sum(map(get, u)) for u in units]


class ChunkMaps:
    """Maps (entry state -> exit state, tokens gained) of runs of 2**level chunks, for all levels up to the
    whole. ``place`` is a chunk's distance from the start of its unit. Equal runs share one map: ``kind`` numbers a
    level's runs by content, ``halves`` are a kind's kinds one level below (-1 for none), or, for chunks, one
    of them."""

    def __init__(self, machine: Transducer, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, place: np.ndarray):
        self.machine, self.codes, self.starts, self.sizes, self.place = machine, codes, starts, sizes, place
        seen: dict[tuple[bool, bytes], int] = {}
        kind = np.array([seen.setdefault((first, codes[a:a + n].tobytes()), len(seen)) for first, a, n in
                         zip((place == 0).tolist(), starts.tolist(), sizes.tolist(), strict=True)], np.int64)
        self.kind, self.halves = [kind], [np.unique(kind, return_index=True)[1]]
        while len(kind) > 1:
            two = np.append(kind, -1)[:len(kind) + len(kind) % 2].reshape(-1, 2) + 1
            pairs, kind = np.unique(two[:, 0] * (len(self.halves[-1]) + 1) + two[:, 1], return_inverse=True)
            self.halves.append(np.stack(np.divmod(pairs, len(self.halves[-1]) + 1), axis=1) - 1)
            self.kind.append(kind)
        self.maps = [Table(4) for _ in self.kind]
        self.runs = 0

    def apply(self, level: int, kind: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the kinds' maps at ``entry``; what a map does not hold yet is composed of its
        halves' values (a chunk's: by running it) and added."""
        if level == 0:
            entry = np.where(self.place[self.halves[0][kind]] == 0, 0, entry)
        table, keys = self.maps[level], kind << 32 | entry
        slot = table.find(keys)
        if (slot < 0).any():
            new = np.unique(keys[slot < 0])
            parts, state = self.halves[level][new >> 32], new & 0xFFFFFFFF
            if level == 0:
                state, gain = self.machine.run(self.codes, self.starts[parts], self.sizes[parts], state)
                self.runs += len(parts)
            else:
                state, gain = self.apply(level - 1, parts[:, 0], state)
                two = parts[:, 1] >= 0
                state[two], more = self.apply(level - 1, parts[two, 1], state[two])
                gain[two] += more
            table.add(new, np.stack([state, gain], axis=1).astype(np.int32))
            slot = table.find(keys)
        got = table.values[slot].astype(np.int64)
        return got[:, 0], got[:, 1]

    def grow(self, entry: np.ndarray) -> None:
        """Chunks' maps for the guessed entries, then for the exits of the chunk before, while those change
        (ROUNDS times at most: what is missing then is added by the scan)."""
        kind = self.kind[0]
        leave, _ = self.apply(0, kind, entry)
        behind = np.arange(1, len(kind))
        for _ in range(ROUNDS):
            if not len(behind):
                return
            exits, _ = self.apply(0, kind[behind], leave[behind - 1])
            # only a chunk whose exit changed can lead to an entry that the next one's map lacks
            moved = (exits != leave[behind]) & (behind + 1 < len(kind))
            leave[behind] = exits
            behind = behind[moved] + 1

    def scan(self) -> np.ndarray:
        """Tokens up to the end of each chunk, over all units in their order."""
        ahead = np.minimum(self.place, GUESS)
        guess, _ = self.machine.run(self.codes, self.starts - ahead, ahead, np.zeros(len(ahead), np.int64))
        self.grow(guess)
        for level in range(1, len(self.kind)):
            self.apply(level, self.kind[level], guess[::1 << level])
        entry, tokens = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in range(len(self.kind) - 1, 0, -1):
            leave, gain = self.apply(level - 1, self.kind[level - 1][::2], entry)
            most = len(self.kind[level - 1])
            entry = np.stack([entry, leave], axis=1).ravel()[:most]
            tokens = np.stack([tokens, tokens + gain], axis=1).ravel()[:most]
        return tokens + self.apply(0, self.kind[0], entry)[1]


_MADE: dict[str, Transducer] = {}


def transducer(path: str, pieces) -> Transducer:
    """One transducer per process and vocabulary. ``pieces`` makes the tables."""
    if path not in _MADE:
        _MADE[path] = Transducer(pieces())
    return _MADE[path]


def count(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes (UTF-8), n_tokens, over_limit."""
    sent = send(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path, lambda: sent.value)
        for batch in batches:
            out: list[int] = []
            for _, _, texts in text_blocks(batch.column(2), BLOCK_BYTES):
                out += machine.counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return (rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
