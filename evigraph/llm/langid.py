"""Language identification of mixed text: script ranges, word scores, Viterbi with a switching penalty.

From labelled text: how often each language's letters fall in each script, and n-gram counts of its words (1 to 4
bytes of lower-case words with their ends). A word's script narrows its candidate languages; each candidate's score is
the log probability of the word's n-grams. The best sequence of languages over a text's words, where each change
costs a penalty, labels its spans; the language that labels most letters is the text's.

Defined results: null text, and text without a letter, is ``und`` with score 0; words without letters stand in no
span of their own; a null id is labelled, and held out is null; equal rows are labelled alike; without labelled rows
everything is ``und``; ties go to the language first in code-point order; no rows in, no rows out; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, cut, joined, mix64, small, text_steps, word_spans
from .labelled import unit_hash

UNKNOWN = "und"
BITS = 16
ORDERS = (1, 2, 3, 4)
#: At most about so many labelled documents of each language are learnt from, by a hash of the id.
MAX_DOCS = 10_000
#: Cost of a change of language between words, in natural log units.
SWITCH = 9.0
#: A language is a candidate for a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.01
#: A word's score is the sum of its n-gram scores times this: n-grams of one word overlap.
TEMPER = 0.5
#: First and last code point of blocks of letters, and their script (0 is Latin).
SCRIPTS = (
    (0x0041, 0x024F, 0), (0x1E00, 0x1EFF, 0), (0x0370, 0x03FF, 1), (0x1F00, 0x1FFF, 1), (0x0400, 0x052F, 2), (0x0530, 0x058F, 3),
    (0x0590, 0x05FF, 4), (0x0600, 0x077F, 5), (0x0900, 0x097F, 6), (0x0980, 0x09FF, 7), (0x0B80, 0x0BFF, 8), (0x0E00, 0x0E7F, 9),
    (0x10A0, 0x10FF, 10), (0x3040, 0x309F, 11), (0x30A0, 0x30FF, 12), (0x3400, 0x9FFF, 13), (0xAC00, 0xD7AF, 14), (0x1100, 0x11FF, 14), (0x20000, 0x323AF, 13),
)
OTHER = 15
#: No code point from here on is a letter.
POINTS = 0x32400
N_SCRIPTS = 16
#: Bytes of texts that Viterbi steps through together, the longest first; a longer text is a step of its own.
VITERBI_BYTES = 12_000_000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point up to the last letter: its script, -1 if it is no letter; and its lower case."""
    import unicodedata

    script = np.full(POINTS, -1, dtype=np.int8)
    lower = np.arange(POINTS, dtype=np.uint32)
    for point in range(POINTS):
        if 0xD800 <= point < 0xE000:
            continue
        char = chr(point)
        if unicodedata.category(char)[0] == "L":
            script[point] = OTHER
            small_ = char.lower()
            if len(small_) == 1:
                lower[point] = ord(small_)
    for first, last, number in SCRIPTS:
        part = script[first : last + 1]
        part[part >= 0] = number
    return script, lower


_held: list = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    if not _held:
        _held.extend(_tables())
    return _held[0], _held[1]


@dataclass
class Words:
    """The words of some texts that hold letters."""

    document: np.ndarray
    letters: np.ndarray
    script: np.ndarray  # of most of the word's letters
    word: np.ndarray  # of each n-gram
    bucket: np.ndarray


def read_words(texts: list[bytes]) -> Words:
    data, begins = joined(texts)
    lead = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    if int(lead.sum()) != len(points):  # not UTF-8: taken byte by byte
        points, lead = data.astype(np.uint32), np.ones(len(data), dtype=bool)
    scripts, lowers = _letters()
    low = np.minimum(points, POINTS - 1)
    script, points = scripts[low], np.where(points < POINTS, lowers[low], points)
    place = np.cumsum(lead) - 1  # of each byte: its code point
    starts, ends = word_spans(data)
    begin, end = place[starts], np.append(place, len(points))[ends]
    letter = script >= 0
    count = np.concatenate([[0], np.cumsum(letter)])
    held = np.flatnonzero(count[end] > count[begin])
    begin, end, document = begin[held], end[held], (np.searchsorted(begins, starts[held], side="right") - 1)
    letters = count[end] - count[begin]
    word_at = np.full(len(points) + 1, -1, dtype=np.int64)
    inside = np.zeros(len(points) + 1, dtype=np.int32)
    np.add.at(inside, begin, 1)
    np.add.at(inside, end, -1)
    member = np.cumsum(inside) > 0
    word_at[member] = np.repeat(np.arange(len(begin)), end - begin)
    # letters only, one space between words: what is between letters of a word ends an n-gram
    at = np.flatnonzero(letter)
    of = word_at[at]
    votes = np.bincount(of * N_SCRIPTS + script[at], minlength=len(begin) * N_SCRIPTS).reshape(-1, N_SCRIPTS) if len(begin) else np.zeros((0, N_SCRIPTS))
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)
    gaps = np.cumsum(fresh)
    line = np.zeros(len(at) + int(gaps[-1]) + 1 if len(at) else 1, dtype=np.uint64)
    owner = np.zeros(len(line), dtype=np.int64)
    slot = np.arange(len(at)) + gaps
    line[slot], owner[slot] = points[at], of
    owner[slot[fresh] - 1] = of[fresh]
    words, buckets = [], []
    for n in ORDERS:
        size = len(line) - n + 1
        if size <= 0:
            continue
        key, cut_ = np.full(size, np.uint64(n)), np.zeros(size, dtype=bool)
        for k in range(n):
            key = key * np.uint64(0x100000001B3) + line[k : size + k] + np.uint64(1)
            if 0 < k < n - 1:
                cut_ |= line[k : size + k] == 0
        if n == 1:
            cut_ = line[:size] == 0
        elif n == 2:
            cut_ = (line[:size] == 0) & (line[1:] == 0)
        ok = np.flatnonzero(~cut_)
        ok = ok[(line[ok] != 0) | (line[np.minimum(ok + 1, len(line) - 1)] != 0)]
        first = np.where(line[ok] != 0, ok, ok + 1)
        words.append(owner[np.minimum(first, len(owner) - 1)])
        buckets.append((mix64(key[ok]) >> np.uint64(64 - BITS)).astype(np.int64))
    return Words(document, letters, votes.argmax(1) if len(begin) else np.zeros(0, np.int64), np.concatenate(words) if words else np.zeros(0, np.int64), np.concatenate(buckets) if buckets else np.zeros(0, np.int64))


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket x language
    candidates: np.ndarray  # script x language

    def word_scores(self, words: Words) -> np.ndarray:
        total = np.zeros((len(words.document), len(self.languages)), dtype=np.float32)
        for k in range(len(self.languages)):
            total[:, k] = TEMPER * np.bincount(words.word, weights=self.scores[words.bucket, k], minlength=len(total))
        total[~self.candidates[words.script]] = -1e4
        return total

    def spans(self, texts: list[bytes], penalty: float = SWITCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every word with letters: its document, number of letters, language, and lead of that language over the next."""
        document, letters, score = [], [], []
        done = 0
        for _, part in text_steps(texts, texts):
            w = read_words(part)
            document.append(w.document + done)
            letters.append(w.letters)
            score.append(self.word_scores(w))
            done += len(part)
        if not document:
            return (np.zeros(0, np.int64),) * 4
        document, letters, score = np.concatenate(document), np.concatenate(letters), np.concatenate(score)
        path = viterbi(np.bincount(document, minlength=len(texts)), score, penalty)
        return document, letters, path, score

    def label(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        count = len(self.languages)
        if not count:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        document, letters, path, score = self.spans(texts)
        held = np.bincount(document * count + path, weights=letters, minlength=len(texts) * count).reshape(-1, count)
        best = held.argmax(1)
        total = held.sum(1)
        share = held.max(1) / np.maximum(total, 1)
        # how sure the words of the winning spans are of it: mean log odds to the runner-up, through a logistic
        own = path == best[document]
        sums = np.stack([np.bincount(document[own], weights=score[own, k], minlength=len(texts)) for k in range(count)], 1).astype(float)
        ahead = sums[np.arange(len(texts)), best]
        sums[np.arange(len(texts)), best] = -np.inf
        sure = 1 / (1 + np.exp(-np.clip(ahead - sums.max(1), 0, 500))) if count > 1 else np.ones(len(texts))
        names = [self.languages[b] if t else UNKNOWN for b, t in zip(best, total, strict=True)]
        return names, np.where(total > 0, share * sure, 0.0)


def viterbi(lengths: np.ndarray, score: np.ndarray, penalty: float) -> np.ndarray:
    """Best state of every word; all texts step together, those that have ended drop out."""
    count = score.shape[1]
    out = np.zeros(len(score), dtype=np.int64)
    if count == 1 or not len(score):
        return out
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # texts with so many words at least
    stay = np.zeros((len(score), count), dtype=bool)
    jump = np.zeros(len(score), dtype=np.int16)
    total = score[begins[: live[0]]].astype(np.float64)
    for t in range(1, sizes[0]):
        at = begins[: live[t]] + t
        total_ = total[: live[t]]
        best = total_.argmax(1)
        from_best = total_[np.arange(len(at)), best] - penalty
        keeps = total_ >= from_best[:, None]
        stay[at], jump[at] = keeps, best
        total[: live[t]] = np.where(keeps, total_, from_best[:, None]) + score[at]
    state = total.argmax(1)
    for t in range(sizes[0] - 1, -1, -1):
        at = begins[: live[t]] + t
        out[at] = state[: live[t]]
        if t:
            held = state[: live[t]]
            state[: live[t]] = np.where(stay[at, held], held, jump[at])
    return out


def fit(docs: DataFrame, keep: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = MAX_DOCS) -> Model:
    """From labelled rows under ``keep``: at most about ``max_docs`` a language."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(keep & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = cut(rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(max_docs)) / F.count("*")).alias("share")))
    chosen = rows.join(small(shares), "lang").filter(unit_hash(F.col("doc_id"), "lang") < F.col("share")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for langs, texts in text_steps(batch.column(0).to_pylist(), column_bytes(batch.column(1))):
                names = sorted(set(langs))
                of = np.array([names.index(x) for x in langs])
                w = read_words(texts)
                by = of[w.document]
                size = (1 << BITS) + N_SCRIPTS
                grams = np.bincount(by[w.word] * size + w.bucket, minlength=len(names) * size)
                grams += np.bincount(by * size + (1 << BITS) + w.script, weights=w.letters, minlength=len(names) * size).astype(np.int64)
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + grams[k * size : (k + 1) * size]
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "k", "n"])

    table = chosen.mapInArrow(run, "lang string, k int, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toArrow()  # at most one row a bucket and language
    names = table.column("lang").to_pylist()
    languages = sorted(set(names), key=lambda x: x.encode())
    counts = np.zeros(((1 << BITS) + N_SCRIPTS, len(languages)))
    index = {x: i for i, x in enumerate(languages)}
    counts[table.column("k").to_numpy(), [index[x] for x in names]] = table.column("n").to_numpy()
    grams, scripts = counts[: 1 << BITS] + 0.5, counts[1 << BITS :]
    scores = np.log(grams / grams.sum(0))
    candidates = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    candidates[~candidates.any(1)] = True
    return Model(languages, (scores - scores.mean(1, keepdims=True)).astype(np.float32) if languages else scores, candidates)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = column_bytes(batch.column(1))
            for at, texts in text_steps(range(len(whole)), whole, VITERBI_BYTES):
                part = batch.slice(at.start, len(at))
                names, scores = sent.value.label(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, lang_pred string, score double")


def language_spans(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, span, lang, words, letters): the spans of each text in order."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = column_bytes(batch.column(1))
            for at, texts in text_steps(range(len(whole)), whole, VITERBI_BYTES):
                part = batch.slice(at.start, len(at))
                document, letters, path, _ = sent.value.spans(texts)
                new = np.ones(len(path), dtype=bool)
                new[1:] = (document[1:] != document[:-1]) | (path[1:] != path[:-1])
                head = np.flatnonzero(new)
                of = document[head]
                number = np.arange(len(head)) - np.searchsorted(of, of)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(of)),
                        pa.array(number, pa.int64()),
                        pa.array([sent.value.languages[k] for k in path[head]], pa.string()),
                        pa.array(np.diff(np.append(head, len(path))), pa.int64()),
                        pa.array(np.add.reduceat(letters, head) if len(head) else [], pa.int64()),
                    ],
                    names=["doc_id", "span", "lang", "words", "letters"],
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, span long, lang string, words long, letters long")
