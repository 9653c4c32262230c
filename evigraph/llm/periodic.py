"""Runs: stretches of words that repeat with a smallest period, at least twice over, found exactly.

A run of period q and length n >= max(12, 2 q) holds, before its last q words, n - q >= max(6, q) words that stand again
q words later. Of blocks of 2 ** k words that begin at multiples of 2 ** k, one at least lies wholly in there if
2 ** (k + 1) - 1 <= n - q. So for every period one block size serves: blocks of B words for periods of 2 B - 1 to 4 B - 2,
and blocks of 4 (of 2 for period 6) for the shorter ones. An Aho-Corasick automaton whose keys are the word numbers of a
block finds where the blocks of one size stand in the text; each occurrence at a distance of that size's periods is a seed, extended in
both directions word by word to the longest stretch of that period. What also has a shorter period is dropped.

Every six words in a row of a run stand again in it, so texts are searched only where six words stand again somewhere.

Defined results: null, empty and short texts have no run; a null id has its runs too (and is not rearranged); rows with
equal ids are texts of their own; no rows in, no rows out; other columns are not looked at. A text is worked on whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from .common import column_bytes

#: Shortest run, and what a run holds at least before its last period.
LEAST, INNER = 12, 6
#: Words compared in the first step of an extension; each further step takes twice as many.
STEP = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_numbers(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    table: dict[bytes, int] = {}
    return np.array([table.setdefault(w, len(table)) for w in words], dtype=np.int64)


def repeated_stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """Longest stretches (begin, end) whose every word lies in six words that stand elsewhere in ``x`` too."""
    n = len(x) - INNER + 1
    if n < 2:
        return []
    codes = (x.astype(np.uint64) + np.uint64(1)) * _ODD
    grams = np.zeros(n, dtype=np.uint64)
    for k in range(INNER):
        grams = (grams ^ (grams >> np.uint64(29))) * _ODD + codes[k : k + n]
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return []
    again = np.zeros(n + 1, dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    depth = np.zeros(len(x) + 1, dtype=np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + INNER, -1)
    inside = np.concatenate([[0], (np.cumsum(depth[:-1]) > 0).astype(np.int8), [0]])
    edge = np.diff(inside)
    return [(int(a), int(b)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if b - a >= LEAST]


def _scales(n: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Block sizes, ascending, with the ranges of periods that they serve in a stretch of ``n`` words."""
    yield 2, [(6, 6)]
    yield 4, [(1, 5), (7, 14)]
    size = 8
    while 2 * size - 1 <= n // 2:
        yield size, [(2 * size - 1, 4 * size - 2)]
        size *= 2


def _seeds(x: tuple[int, ...], size: int, periods: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) where the aligned block at ``place`` stands again at a distance within ``periods``."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    number: dict[tuple[int, ...], int] = {}
    blocks = []
    for at in range(0, len(x) - size + 1, size):
        key = x[at : at + size]
        if key not in number:
            number[key] = len(number)
            automaton.add_word(key, number[key])
        blocks.append(number[key])
    automaton.make_automaton()
    found = np.array(list(automaton.iter(x)), dtype=np.int64).reshape(-1, 2)
    place = found[:, 0] - size + 1
    order = np.lexsort((place, found[:, 1]))
    keys = found[order, 1] * (len(x) + 1) + place[order]  # by block, then place
    own = np.array(blocks, dtype=np.int64) * (len(x) + 1)
    starts = np.arange(len(blocks), dtype=np.int64) * size
    begins, distances = [], []
    for low, high in periods:
        first = np.searchsorted(keys, own + np.minimum(starts + low, len(x)))
        last = np.searchsorted(keys, own + np.minimum(starts + high, len(x)), side="right")
        n = last - first
        at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begins.append(np.repeat(starts, n))
        distances.append(keys[at] - np.repeat(own, n) - begins[-1])
    return np.concatenate(begins), np.concatenate(distances)


def _extended(x: np.ndarray, place: int, q: int) -> tuple[int, int]:
    """The longest stretch around ``place`` in which words q apart are identical."""
    end, step = place + q, STEP
    while end < len(x):
        differ = x[end : end + step] != x[end - q : min(end + step, len(x)) - q]
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = end + len(differ), step * 2
    begin, step = place, STEP
    while begin > 0:
        low = max(0, begin - step)
        differ = (x[low:begin] != x[low + q : begin + q])[::-1]
        if differ.any():
            begin -= int(differ.argmax())
            break
        begin, step = low, step * 2
    return begin, end


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*out, q] if q > 1 else out


def stretch_runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one stretch of word numbers."""
    words, out = tuple(x.tolist()), []
    for size, periods in _scales(len(x)):
        place, distance = _seeds(words, size, periods)
        order = np.lexsort((place, distance))
        place, distance = place[order], distance[order]
        open_ = np.ones(len(place), dtype=bool)
        for begin, length, period in out:  # within a run of a divisor of the distance there is nothing new
            open_ &= ~((place >= begin) & (place + distance + size <= begin + length) & (distance % period == 0))
        covered, before = -1, 0
        for at, q in zip(place[open_].tolist(), distance[open_].tolist(), strict=True):
            if q == before and at < covered:
                continue
            begin, end = _extended(x, at, q)
            covered, before = end - q, q
            if end - begin < max(LEAST, 2 * q):
                continue
            if any((x[begin : end - q // p] == x[begin + q // p : end]).all() for p in _primes(q)):
                continue
            out.append((begin, end - begin, q))
    return out


def runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a text's word numbers, by start, then period."""
    out = []
    for begin, end in repeated_stretches(x):
        out += [(begin + start, length, q) for start, length, q in stretch_runs(x[begin:end])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay where each run keeps its first period only."""
    depth = np.zeros(n + 1, dtype=np.int64)
    for start, length, q in found:
        depth[start + q] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def rearranged(n: int, doc_id: object) -> np.ndarray | None:
    """Places of the words of a text that gets a period by the hash of its id, or None: one in ten, from word a with period p."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def run_digests(docs: DataFrame, arranged: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every row.

    ``arranged``: texts are rearranged first by the hash of their id (see ``rearranged``), which plants known periods.
    """

    def of(key: object, whole: bytes) -> tuple:
        words = whole.split()
        x = word_numbers(words)
        at = rearranged(len(words), key) if arranged else None
        if at is not None:
            x, words = x[at], [words[i] for i in at]
        found = runs(x)
        if found:
            stay = kept_words(len(words), found)
            words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
        start, length, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{a},{n},{p}\n" for a, n, p in found)
        return key, len(found), start, length, q, 1000 * length // q if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()

    columns = StructType([StructField("doc_id", docs.schema[doc_id].dataType), *StructType.fromDDL("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*map(of, batch.column(0).to_pylist(), column_bytes(batch.column(1))), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, pa.int64()) for r in rows[1:6]), *(pa.array(r, pa.string()) for r in rows[6:])], names=columns.names)

    return docs.select(doc_id, text).mapInArrow(run, columns)


def text_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, period) of every run of every row."""
    columns = StructType([StructField("doc_id", docs.schema[doc_id].dataType), *StructType.fromDDL("start long, length long, period long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [runs(word_numbers(t.split())) for t in column_bytes(batch.column(1))]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            if len(owner):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *(pa.array([r[k] for f in found for r in f], pa.int64()) for k in range(3))], names=columns.names)

    return docs.select(doc_id, text).mapInArrow(run, columns)


def collapsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``; texts with runs hold the first period of each only, words joined by a space. Other texts stay as they are."""

    def shorter(whole: bytes) -> str | None:
        words = whole.split()
        found = runs(word_numbers(words))
        return b" ".join(w for w, s in zip(words, kept_words(len(words), found).tolist(), strict=True) if s).decode() if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text)
            made = pa.array(list(map(shorter, column_bytes(batch.column(at)))), pa.string())
            yield batch.set_column(at, text, pc.coalesce(made, batch.column(at)))

    return docs.mapInArrow(run, docs.schema)
