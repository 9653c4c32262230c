"""Shared pieces of the training-data operators: checkpoints, hashing of byte buffers, Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..plans.iterate import cut as cut
from ..plans.iterate import tidied as tidied

#: Words everywhere in this package: runs of anything but space and the five ASCII controls 9-13.
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows of a side that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 50_000
#: Bytes of text that one vectorised step handles at once (a longer document is a step of its own).
STEP_BYTES = 1_500_000

_WS = np.zeros(256, dtype=bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a checkpointed side for broadcast if it has at most so many rows; else Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def long_id(docs: DataFrame, doc_id: str) -> Column:
    """The id as a long. Ids of other kinds are refused: they would be cut or fail row by row."""
    kind = docs.schema[doc_id].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"ids must be integers, {doc_id} is {kind.simpleString()}: number the rows first")
    return docs[doc_id].cast("long").alias("doc_id")


def id_text(column: str | Column) -> Column:
    return F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit(""))


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: what decides which rows are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (Stafford's variant 13)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(max(n, 1), base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if n > 4 * STEP_BYTES:
            return out[0], out[1]
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hashes of any substrings of one buffer, from sums of byte codes times powers of an odd base."""

    def __init__(self, data: np.ndarray):
        forward, self.back = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * forward[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space after each, and where each begins (and the end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_WS[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorts in place."""
    x.sort()
    fresh = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=fresh[1:])
    return x[fresh]


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def text_steps(ids: list, texts: list[bytes], most: int = STEP_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Consecutive slices of at most so many bytes, one document at least."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield ids[begin:i], texts[begin:i]
            begin, held = i, 0
        held += len(t) + 1
    if begin < len(texts):
        yield ids[begin:], texts[begin:]


def column_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8; null is empty."""
    return column.fill_null("").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups, runs of equal integers in the first ``keys`` columns; of so many rows at least but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if sum(b.num_rows for b in held) >= rows:
            same = np.ones(batch.num_rows, dtype=bool)
            for k in range(keys):
                same &= batch.column(k).to_numpy() == held[-1].column(k)[-1].as_py()
            goes_on = batch.num_rows if same.all() else int(np.argmin(same))
            if goes_on < batch.num_rows:
                yield pa.Table.from_batches([*held, batch.slice(0, goes_on)] if goes_on else held)
                held, batch = [], batch.slice(goes_on)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def seeded(*parts: object) -> int:
    """A 64-bit seed that is the same on every machine."""
    import hashlib

    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=8).digest(), "little")


def worker_threads() -> None:
    """Libraries in Python workers keep to the task's own core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")
