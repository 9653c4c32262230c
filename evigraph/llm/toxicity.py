"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

The n-grams (4 to 6 bytes of lower-case words with the spaces around them) that a text holds are hashed to buckets.
Counts of labelled documents by bucket and class give the log-count ratio r; the regression takes the MAX_FEATURES buckets
whose ratio is the most standard errors from 0, whatever that number of errors is. A logistic regression on presence times r gives weights, and a text's score is its probability. Texts
are read whole; counts are summed by bucket before they reach the driver, which sees a bounded number of buckets.

Defined results: null and empty texts hold no n-gram and score the intercept; a null id is scored, and held out is null;
rows with equal ids are scored alike; without labels of both classes everything scores the share of label 1 (0 if
none); no rows in, no rows out; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _WS, column_bytes, cut, distinct, joined, lowered, text_steps
from .labelled import MAX_LABELS, training_labels, unit_hash

BITS = 20
ORDERS = (4, 5, 6)
ALPHA = 1.0
#: Buckets that the model weighs: those whose log ratio is the most standard errors from 0.
MAX_FEATURES = 1 << 15
#: Labelled rows of each class that the regression takes, by a hash of the id.
MAX_FIT = 5_000
#: n-grams of all these rows together (4 bytes each on the driver); above it a share of the rows, by a hash.
MAX_ENTRIES = 10_000_000
RIDGE = 1e-3
MOST_STEPS = 200
_SPACE = np.array([32], dtype=np.uint8)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def text_grams(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every distinct n-gram, sorted; only of ``wanted`` buckets, if given."""
    data, starts = joined(texts)
    data = lowered(data)
    data = np.concatenate([_SPACE, np.where(_WS[data], np.uint8(32), data)])
    space, codes = data == 32, data.astype(np.uint64)
    found, packed, inner = [], codes, np.zeros(len(data), dtype=bool)
    for n in range(2, max(ORDERS) + 1):
        size = len(data) - n + 1
        if size <= 0:
            break
        packed = packed[:size] << np.uint64(8) | codes[n - 1 :]
        if n > 2:
            inner = inner[:size] | space[n - 2 : n - 2 + size]
        if n not in ORDERS:
            continue
        at = np.flatnonzero(~inner)
        bucket = ((packed[at] + np.uint64(n)) * _ODD[n % len(_ODD)]) >> np.uint64(64 - BITS)
        if wanted is not None:
            held = wanted[bucket]
            at, bucket = at[held], bucket[held]
        found.append((np.searchsorted(starts, at, side="right") - 1).clip(0).astype(np.uint64) << np.uint64(BITS) | bucket)
    keys = distinct(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # float32 of each bucket
    intercept: float
    prior: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(texts), self.prior)
        document, bucket = text_grams(texts, self.weights != 0)
        z = self.intercept + np.bincount(document, weights=self.weights[bucket].astype(float), minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _bucket_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n0, n1): documents of each label that hold each bucket, and in bucket 1 << BITS documents of each label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for part, texts in text_steps(labels, column_bytes(batch.column(0))):
                document, bucket = text_grams(texts)
                of = np.array(part)
                for label in set(part):
                    held = counts.setdefault(label, np.zeros((1 << BITS) + 1, dtype=np.int64))
                    held[:-1] += np.bincount(bucket[of[document] == label], minlength=1 << BITS)
                    held[-1] += int((of == label).sum())
        for label, held in counts.items():
            at = np.flatnonzero(held)
            for k in range(0, len(at), 100_000):
                i = at[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), label), pa.int32()), pa.array(i, pa.int32()), pa.array(held[i], pa.int64())], names=["label", "bucket", "n"])

    return cut(rows.mapInArrow(run, "label int, bucket int, n long").groupBy("bucket").agg(*(F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1))))


def _regression(indices: list[np.ndarray], y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on presence times scale, by accelerated gradient steps."""
    sizes = np.array([len(i) for i in indices])
    some = np.flatnonzero(sizes)
    begins = (np.cumsum(sizes) - sizes)[some]
    column = np.concatenate(indices) if indices else np.zeros(0, np.int32)
    value = scale[column].astype(np.float32)

    def by_row(entries: np.ndarray) -> np.ndarray:
        out = np.zeros(len(y))
        if len(some):
            out[some] = np.add.reduceat(entries, begins)
        return out

    row_square = by_row(value**2)
    step = 1 / (0.25 * (np.quantile(row_square, 0.99) + 1) / 4 + RIDGE)
    w, b = np.zeros(len(scale)), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    at_w, at_b, momentum = w, b, 1.0
    loss_before = np.inf
    for turn in range(MOST_STEPS):
        z = at_b + by_row(value * at_w.astype(np.float32)[column])
        loss = np.mean(np.logaddexp(0, z) - y * z) + RIDGE / 2 * (at_w @ at_w)
        if loss > loss_before + 1e-9:
            step, momentum, at_w, at_b, loss_before = step / 2, 1.0, w, b, np.inf
            continue
        if turn > 20 and loss_before - loss < 1e-5 * loss:
            break
        loss_before = loss
        rest = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(y)
        new_w = at_w - step * (np.bincount(column, weights=value * np.repeat(rest.astype(np.float32), sizes), minlength=len(scale)) + RIDGE * at_w)
        new_b = at_b - step * rest.sum()
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        at_w, at_b = new_w + (momentum - 1) / grown * (new_w - w), new_b + (momentum - 1) / grown * (new_b - b)
        w, b, momentum = new_w, new_b, grown
    return w, b


def fit(docs: DataFrame, labels: DataFrame, label: str, keep: Column, doc_id: str = "doc_id", text: str = "text", max_labels: int = MAX_LABELS, max_fit: int = MAX_FIT, max_entries: int = MAX_ENTRIES, max_features: int = MAX_FEATURES) -> Model:
    known = training_labels(labels, label, keep, max_labels, doc_id)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(known, "doc_id").select("text", "label", "doc_id")
    counts = _bucket_counts(rows)
    totals = counts.filter(F.col("bucket") == 1 << BITS).first()
    d0, d1 = (int(totals.n0), int(totals.n1)) if totals else (0, 0)
    prior = d1 / max(1, d0 + d1)
    if not d0 or not d1:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, prior)
    n0, n1 = F.col("n0") + ALPHA, F.col("n1") + ALPHA
    rated = counts.filter(F.col("bucket") < 1 << BITS).select("bucket", (F.log(n1 / (d1 + 2 * ALPHA)) - F.log(n0 / (d0 + 2 * ALPHA))).alias("ratio"), F.sqrt(1 / n1 + 1 / n0).alias("error"))
    strongest = rated.filter("ratio <> 0").orderBy(F.abs(F.col("ratio") / F.col("error")).desc(), "bucket").limit(max_features)
    table = strongest.select("bucket", "ratio").toArrow().sort_by("bucket")
    chosen, ratio = table.column("bucket").to_numpy(), table.column("ratio").to_numpy()
    if not len(chosen):
        return Model(np.zeros(1 << BITS, np.float32), 0.0, prior)
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)
    sent = docs.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = sent.value
        for batch in batches:
            whole = column_bytes(batch.column(0))
            for part, texts in text_steps(range(len(whole)), whole):
                document, bucket = text_grams(texts, where >= 0)
                index, ends = where[bucket], np.searchsorted(document, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(part.start, len(part)), pa.array([index[a:b].astype("<i4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), batch.column(2).slice(part.start, len(part))], names=["label", "held", "draw"])

    share = F.when(F.col("label") == 1, min(1.0, max_fit / d1)).otherwise(min(1.0, max_fit / d0))
    held_rows = cut(rows.filter(unit_hash(F.col("doc_id"), "fit") < share).select("text", "label", unit_hash(F.col("doc_id"), "entries").alias("draw")).mapInArrow(run, "label int, held binary, draw double"))
    entries = (held_rows.agg(F.sum(F.length("held"))).first()[0] or 0) // 4
    table = held_rows.filter(F.col("draw") < min(1.0, max_entries / max(1, entries))).select("label", "held").toArrow()
    if not table.num_rows:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, prior)
    y = table.column("label").to_numpy().astype(float)
    held = [np.frombuffer(x, dtype="<i4") for x in table.column("held").to_pylist()]
    del table
    w, b = _regression(held, y, ratio)
    for c, (total, used) in enumerate(((d0, (y == 0).sum()), (d1, (y == 1).sum()))):  # classes were drawn at different rates
        b += (1 if c else -1) * float(np.log(total / max(1, used)))
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[chosen] = w * ratio
    return Model(weights, b, prior)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every document."""
    return scored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model, "text")


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score", drop_text: bool = True) -> DataFrame:
    """The rows of ``docs`` with a score beside them (in place of a column of that name)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != name and not (drop_text and f.name == text)]
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if at is None:
                at = [batch.schema.names.index(f.name) for f in kept]
            texts = column_bytes(batch.column(place))
            scores = [sent.value.score(part) for _, part in text_steps(texts, texts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*(f.name for f in kept), name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*kept, StructField(name, DoubleType())]))
