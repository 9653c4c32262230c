"""Quality classifier: regularised quadratic discriminant over statistics of documents.

Each text gives a fixed vector of statistics, brought to roughly normal shape. Class means and covariances are sums over
all labelled rows, added up by Spark; covariances are shrunk towards their own diagonal, and a little towards the pooled
one. A score is the posterior probability of label 1 from the Mahalanobis log-density difference, with Cholesky factors
computed once.

Defined results: null and empty texts have statistics of their own (no words) and a score; a null id is scored, and
held out is null; rows with equal ids are scored alike; without labels of both classes everything scores the
share of label 1; no rows in, no rows out; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, column_bytes, cut, joined, text_steps, word_spans
from .labelled import MAX_LABELS, training_labels

#: Shrinkage of a class covariance towards its diagonal and towards the pooled covariance.
TO_DIAGONAL, TO_POOLED = 0.1, 0.02
#: Added to each variance of a statistic, in units of its spread over all labelled rows.
FLOOR = 1e-3
STATISTICS = (
    "log_words", "word_length", "upper_words", "symbols", "marks", "bars", "digits", "repeat_next", "distinct",
    "log_lines", "line_words", "repeat_lines", "ends", "non_ascii", "punctuation", "short_words",
)
#: A share in a short text says little: shares are taken as if so many words, characters and lines of usual text stood
#: beside the text's own.
USUAL_WORDS, USUAL_CHARS, USUAL_LINES = 30.0, 150.0, 5.0
#: Of that usual text: mean length of words, share of distinct words, of words that end a sentence, of short words.
USUAL_LENGTH, USUAL_DISTINCT, USUAL_ENDS, USUAL_SHORT = 5.0, 0.8, 0.1, 0.35


def _bytes_in(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(chars)] = 1
    return out


_SYMBOL, _MARK, _BAR, _DIGIT, _STOP = _bytes_in(b"#*$%&<>"), _bytes_in(b"!"), _bytes_in(b"|"), _bytes_in(b"0123456789"), _bytes_in(b".!?")
_PUNCTUATION = _bytes_in(b",;:()\"'-")
_UPPER = _bytes_in(bytes(range(65, 91)))
_LOW = _bytes_in(bytes(range(97, 123)))


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS for each text."""
    data, begins = joined(texts)
    count = len(texts)
    starts, ends = word_spans(data)
    of = np.searchsorted(begins, starts, side="right") - 1
    words = np.bincount(of, minlength=count).astype(float)
    some = words + USUAL_WORDS
    chars = np.diff(begins) - 1.0 + USUAL_CHARS

    def per_doc(table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[data], begins[:-1]).astype(float) if count else np.zeros(0)

    def of_words(flag: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=flag, minlength=count)

    hashes = Rolling(data).of(starts, ends)
    same = np.zeros(len(starts), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    first = np.ones(len(starts), dtype=bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][first], minlength=count)
    ups = np.concatenate([[0], np.cumsum(_UPPER[data])])
    lows = np.concatenate([[0], np.cumsum(_LOW[data])])
    up, low = ups[ends] - ups[starts], lows[ends] - lows[starts]
    length = (ends - starts).astype(float)

    breaks = np.flatnonzero(data == 10)
    line_of = np.searchsorted(breaks, starts)  # of each word; lines with no word don't count
    new_line = np.ones(len(starts), dtype=bool)
    new_line[1:] = (line_of[1:] != line_of[:-1]) | (of[1:] != of[:-1])
    head = np.flatnonzero(new_line)
    lines = np.bincount(of[head], minlength=count).astype(float)
    if len(head):
        tail = np.append(head[1:], len(starts)) - 1
        line_hash = Rolling(data).of(starts[head], ends[tail])
        by = np.lexsort((line_hash, of[head]))
        again = np.zeros(len(head), dtype=bool)
        again[1:] = (line_hash[by][1:] == line_hash[by][:-1]) & (of[head][by][1:] == of[head][by][:-1])
        repeats = np.bincount(of[head][by][again], minlength=count)
    else:
        repeats = np.zeros(count)
    many = lines + USUAL_LINES
    root = np.sqrt
    return np.column_stack(
        [
            np.log(some),
            np.log1p((of_words(length) + USUAL_WORDS * USUAL_LENGTH) / some),
            root(of_words((up > 1) & (low == 0)) / some),
            root(per_doc(_SYMBOL) / chars),
            root(per_doc(_MARK) / chars),
            root(per_doc(_BAR) / chars),
            root(per_doc(_DIGIT) / chars),
            root(of_words(same) / some),
            (distinct + USUAL_WORDS * USUAL_DISTINCT) / some,
            np.log(many),
            np.log1p(words / many),
            root(repeats / many),
            root((of_words(_STOP[data[np.maximum(ends - 1, 0)]]) + USUAL_WORDS * USUAL_ENDS) / some),
            root(np.add.reduceat((data > 127).astype(np.int64), begins[:-1]) / chars) if count else np.zeros(0),
            root(per_doc(_PUNCTUATION) / chars),
            (of_words(length <= 3) + USUAL_WORDS * USUAL_SHORT) / some,
        ]
    )


@dataclass
class Model:
    prior: float
    means: np.ndarray | None = None  # of labels 0 and 1
    inverses: np.ndarray | None = None  # of the Cholesky factors
    logs: np.ndarray | None = None  # log determinants

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        density = [-0.5 * (((x - self.means[c]) @ self.inverses[c].T) ** 2).sum(1) - 0.5 * self.logs[c] for c in (0, 1)]
        z = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): the statistics as little-endian doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column_bytes(batch.column(1))
            rows = [r.tobytes() for _, part in text_steps(texts, texts) for r in statistics(part).astype("<f8")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "x"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, len(STATISTICS))


def fit(table: DataFrame, labels: DataFrame, label: str, keep: Column, max_labels: int = MAX_LABELS) -> Model:
    """From sums of 1, x and x x' by class over the labelled rows of ``table`` (doc_id, x)."""
    known = training_labels(labels, label, keep, max_labels)
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy()
            for c in (0, 1):
                part = x[y == c]
                sums[c] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
        c, k = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel(), pa.int32()), pa.array(k.ravel(), pa.int32()), pa.array(sums.ravel())], names=["c", "k", "v"])

    rows = table.join(known, "doc_id").select("x", "label").mapInArrow(run, "c int, k int, v double").groupBy("c", "k").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((2, 1 + d + d * d))
    for r in rows:
        sums[r.c, r.k] = r.v
    n = sums[:, 0]
    if n.min() < 2:
        return Model(float(n[1] / max(1, n.sum())))
    means = sums[:, 1 : 1 + d] / n[:, None]
    inner = [sums[c, 1 + d :].reshape(d, d) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (n[0] * inner[0] + n[1] * inner[1]) / n.sum()
    spread = np.maximum(np.diag(pooled) + n[0] * n[1] / n.sum() ** 2 * (means[0] - means[1]) ** 2, 1e-9)
    inverses, logs = [], []
    for c in (0, 1):
        shrunk = (1 - TO_DIAGONAL - TO_POOLED) * inner[c] + TO_DIAGONAL * np.diag(np.diag(inner[c])) + TO_POOLED * pooled + np.diag(FLOOR * spread)
        factor = np.linalg.cholesky(shrunk)
        inverses.append(np.linalg.inv(factor))
        logs.append(2 * np.log(np.diag(factor)).sum())
    return Model(float(n[1] / n.sum()), means, np.array(inverses), np.array(logs))


def score(table: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from (doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], names=["doc_id", "score"])

    return table.select("doc_id", "x").mapInArrow(run, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every document, learnt from the labelled rows under ``keep``."""
    table = cut(document_statistics(docs, doc_id, text))
    return score(table, fit(table, labels, label, keep))
