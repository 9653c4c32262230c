"""Hierarchical multi-length packing of token sequences.

Each document's tokens are routed to tiers of context size: every full window goes out on its own, the rest
to the smallest tier that holds it. Each tier is packed into windows of its own length, the longest tier first: its
longest rest opens a window and the gap takes the largest rests that fit, of its tier and then of shorter ones; a gap
that no whole rest fits takes a piece of the shortest. What fills no window of its tier any more is closed at powers of
two, so nothing is padded there either. A step group holds a task's windows of one length, and every group of
every tier but the last as many tokens.

All of it runs inside the scan: a task packs the documents it reads, so nothing is shuffled and memory is
bounded by a batch and one document. Sequence ids are the task's number and a counter, the same in a rerun over the
same files.

Defined results: a null or empty text is the end token alone; a null id passes through; equal rows are packed
each on its own; no rows in, no rows out; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import column_bytes, long_id, worker_threads

WINDOW = 2048
TIERS = (2048, 1024, 512, 256)
#: Tokens of one step group.
STEP_TOKENS = 1 << 19
#: Word forms whose ids a worker keeps; beyond it they are forgotten and looked up anew.
KEPT_WORDS = 500_000
#: Texts whose words are held as objects at a time; a worker keeps the memory that the most of them took.
HELD_TEXTS = 1000
#: Bytes above which a word goes to the tokenizer itself: here every merge passes over the whole word.
LONG_WORD = 128
#: Rests that wait for a window; at most this many documents' ids are held beyond the batch.
POOL = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, tier int, step_group long"

#: The split of the word vocabulary's own pre-tokenizer, over lower-case text.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Forms whose lower case and canonical composition need no context: ASCII and precomposed Latin-1 letters.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")


class WordTokens:
    """Ids of white-space-separated words, many at a time.

    Text between white space is tokenised alike wherever it stands, so ids are kept by word. New words of plain
    characters are split and merged here for thousands of words at once; any other goes to the tokenizer itself.
    """

    def __init__(self, file: str, kept: int = KEPT_WORDS, held: int = HELD_TEXTS):
        import regex
        from tokenizers import Tokenizer

        worker_threads()
        self.kept, self.held = kept, held
        self.whole = Tokenizer.from_file(file)
        model = json.load(open(file, encoding="utf-8"))["model"]
        vocabulary, merges = model["vocab"], model["merges"]
        self.split = regex.compile(_SPLIT).findall
        shown = self._shown()
        self.inner = np.array([vocabulary[shown[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocabulary[shown[b] + model["end_of_word_suffix"]] for b in range(256)], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], dtype=np.uint64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs] + [0], dtype=np.int64)
        self.none = len(pairs)
        self._table(keys)
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    @staticmethod
    def _shown() -> dict[int, str]:
        """The printable stand-in of each byte in byte-level vocabularies: itself, or the next code point from 256."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        out, spare = {b: chr(b) for b in printable}, 256
        for b in range(256):
            if b not in out:
                out[b], spare = chr(spare), spare + 1
        return out

    def _table(self, keys: np.ndarray) -> None:
        self.bits = 19
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(1 << self.bits, self.none, dtype=np.int64)
        todo, rank, slot = keys, np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = np.zeros(len(todo), dtype=bool)
            put[first] = True
            put &= free
            self.keys[slot[put]], self.ranks[slot[put]] = todo[put], rank[put]
            todo, rank, slot = todo[~put], rank[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        slot = self._slot(keys)
        out = np.full(len(keys), self.none, dtype=np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def _merge(self, pieces: list[bytes]) -> None:
        """Byte-pair merges of pieces of one length in bytes at a time: the lowest rank first, the leftmost among equals."""
        by_length: dict[int, list[bytes]] = {}
        for piece in pieces:
            by_length.setdefault(len(piece), []).append(piece)
        for n, group in by_length.items():
            for at in range(0, len(group), 5_000):
                part = group[at : at + 5_000]
                raw = np.frombuffer(b"".join(part), dtype=np.uint8).reshape(len(part), n)
                ids = self.inner[raw]
                ids[:, -1] = self.last[raw[:, -1]]
                self.pieces.update(zip(part, self._merge_rows(ids), strict=True))

    def _merge_rows(self, ids: np.ndarray) -> list[bytes]:
        count, n = ids.shape
        length = np.full(count, n)
        live = np.arange(count)
        if n > 1:
            rank = np.full((count, n), self.none, dtype=np.int64)
            rank[:, :-1] = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(count, n - 1)
        columns = np.arange(n)
        while n > 1 and len(live):
            held = rank[live]
            at = held.argmin(axis=1)
            best = held[np.arange(len(live)), at]
            keep = best < self.none
            live, at, best = live[keep], at[keep], best[keep]
            if not len(live):
                break
            source = np.minimum(columns + (columns[None, :] > at[:, None]), n - 1)
            row = np.take_along_axis(ids[live], source, axis=1)
            ranks = np.take_along_axis(rank[live], source, axis=1)
            row[np.arange(len(live)), at] = self.merged[best]
            length[live] -= 1
            ranks[:, -1] = self.none
            for shift in (-1, 0):
                left = at + shift
                ok = np.flatnonzero((left >= 0) & (left + 1 < length[live]))
                gone = np.flatnonzero((left >= 0) & (left + 1 >= length[live]))
                ranks[ok, left[ok]] = self._rank(row[ok, left[ok]], row[ok, left[ok] + 1])
                ranks[gone, left[gone]] = self.none
            ids[live], rank[live] = row, ranks
        packed, width = ids.astype("<u4").tobytes(), 4 * n
        return [packed[i * width : i * width + 4 * k] for i, k in enumerate(length.tolist())]

    def _learn(self, words: list[bytes]) -> None:
        if len(self.words) > self.kept:
            self.words.clear()
        if len(self.pieces) > self.kept:
            self.pieces.clear()
        one, more, other = [], [], []  # words of one piece, of several, and those for the tokenizer itself
        for w in words:
            if len(w) > LONG_WORD:
                other.append((w, w.decode("utf-8", "replace")))
            elif w.isalpha():  # ASCII letters
                one.append((w, w.lower()))
            elif w[:-1].isalpha() and w[-1] < 128:
                more.append((w, (w[:-1].lower(), w[-1:])))
            else:
                text = w.decode("utf-8", "replace")
                if not _PLAIN.fullmatch(text) or "<|" in text:
                    other.append((w, text))
                elif text.isalpha():
                    one.append((w, text.lower().encode()))
                elif text[:-1].isalpha():
                    more.append((w, (text[:-1].lower().encode(), text[-1:].lower().encode())))
                else:
                    more.append((w, [x.encode() for x in self.split(text.lower())]))
        known = self.pieces
        fresh = {p for _, p in one if p not in known}
        fresh.update(p for _, parts in more for p in parts if p not in known)
        self._merge([*fresh])
        for w, p in one:
            self.words[w] = known[p]
        for w, parts in more:
            self.words[w] = b"".join([known[p] for p in parts])
        if other:
            for (w, _), e in zip(other, self.whole.encode_batch_fast([t for _, t in other], add_special_tokens=False), strict=True):
                self.words[w] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian ids of each text."""
        for at in range(0, len(texts), self.held):
            split = [t.split() for t in texts[at : at + self.held]]
            seen = set().union(*split)
            if len(self.words) + len(seen) > self.kept:
                self.words = {w: self.words[w] for w in seen if w in self.words}
            self._learn([*seen - self.words.keys()])
            get = self.words.__getitem__
            for words in split:
                yield b"".join(map(get, words))


class Windows:
    """Packs rests of documents into windows and numbers the sequences."""

    def __init__(self, task: int, window: int = WINDOW, tiers: tuple[int, ...] = TIERS, pool: int = POOL):
        self.window, self.tiers, self.most = window, sorted({*(t for t in tiers if t < window), window}), pool
        self.next, self.task = task << 32, task
        self.sequences: dict[int, int] = {}  # by length
        self.rests: dict[int, list[tuple]] = {t: [] for t in self.tiers}  # by tier and length: (length, order, doc_id, start, ids, total)
        self.waiting, self.held = 0, 0  # rests and their tokens
        self.order, self.out = 0, []

    def _sequence(self, pieces: list, length: int) -> None:
        tier = next(t for t in self.tiers if t >= length)
        before = self.sequences.get(length, 0)
        self.sequences[length] = before + 1
        group = (self.task << 32) + (length.bit_length() << 24) + before * length // STEP_TOKENS
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, zlib.crc32(ids), total, self.next, at, length, tier, group))
            at += n
        self.next += 1

    def add(self, doc_id: object, ids: bytes) -> None:
        total, size = len(ids) // 4, self.window * 4
        full = len(ids) // size
        for k in range(full):
            self._sequence([(doc_id, k * self.window, ids[k * size : (k + 1) * size], total)], self.window)
        if len(ids) % size:
            self._rest(doc_id, full * self.window, ids[full * size :], total)
        if self.waiting > self.most:
            self._pack(self.most // 2)

    def _rest(self, doc_id: object, start: int, ids: bytes, total: int) -> None:
        n = len(ids) // 4
        tier = next(t for t in self.tiers if t >= n)
        bisect.insort(self.rests[tier], (n, self.order, doc_id, start, ids, total), key=lambda r: r[:2])
        self.order, self.waiting, self.held = self.order + 1, self.waiting + 1, self.held + n

    def _take(self, tier: int, place: int) -> tuple:
        rest = self.rests[tier].pop(place)
        self.waiting, self.held = self.waiting - 1, self.held - rest[0]
        return rest

    def _pack(self, left: int) -> None:
        """Closes full windows of each tier, the longest first, until so many rests are left."""
        for tier in reversed(self.tiers):
            while self.waiting > left and self.rests[tier] and self.held >= tier:
                self._window(tier)

    def _window(self, tier: int) -> None:
        """One full window of the tier, opened by its longest rest."""
        first = self._take(tier, -1)
        pieces, room = [first], tier - first[0]
        for t in reversed(self.tiers):  # longer rests first, each as large as still fits
            while t <= tier and room and (k := bisect.bisect_right(self.rests[t], room, key=lambda r: r[0])):
                pieces.append(self._take(t, k - 1))
                room -= pieces[-1][0]
        if room:  # every rest is longer than the gap: a piece of the shortest closes it
            _, _, doc_id, start, ids, total = self._take(next(t for t in self.tiers if self.rests[t]), 0)
            pieces.append((room, 0, doc_id, start, ids[: room * 4], total))
            self._rest(doc_id, start + room, ids[room * 4 :], total)
        self._sequence([(d, s, i, t) for _, _, d, s, i, t in pieces], tier)

    def close(self) -> None:
        self._pack(0)
        pieces = [[d, s, i, t] for tier in reversed(self.tiers) for _, _, d, s, i, t in reversed(self.rests[tier])]
        self.rests = {t: [] for t in self.tiers}
        self.waiting = self.held = 0
        left = sum(len(p[2]) // 4 for p in pieces)
        while left:
            length = 1 << (left.bit_length() - 1)
            left, room, taken = left - length, length, []
            while room:
                d, s, i, t = pieces[0]
                n = min(room, len(i) // 4)
                taken.append((d, s, i[: n * 4], t))
                room -= n
                if n * 4 == len(i):
                    pieces.pop(0)
                else:
                    pieces[0] = [d, s + n, i[n * 4 :], t]
            self._sequence(taken, length)

    def rows(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        columns = list(zip(*out, strict=True)) or [()] * 10
        kinds = [pa.int64()] * 8 + [pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, tiers: tuple[int, ...] = TIERS, kept: int = KEPT_WORDS, held: int = HELD_TEXTS) -> DataFrame:
    """One row a piece. ``tokenizer``: a tokenizer file that every worker can open. ``window`` is the longest tier.

    ``kept`` words keep their ids and ``held`` texts are split at a time: fewer take less of a worker's memory and more time, and give the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows = WordTokens(tokenizer, kept, held), Windows(TaskContext.get().partitionId(), window, tiers)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 2 * held):
                part = batch.slice(at, 2 * held)
                for key, ids in zip(part.column(0).to_pylist(), words.encode(column_bytes(part.column(1))), strict=True):
                    windows.add(key, ids + end)
                yield windows.rows()
        windows.close()
        yield windows.rows()

    return docs.select(long_id(docs, doc_id), docs[text].alias("text")).mapInArrow(run, SCHEMA)


