"""Repeated strings of a fixed length: column-wise construction over aligned collections of segments.

Whole documents have far too many columns to insert one symbol of each per round, and only prefixes up to LENGTH matter. So:

1. Every window of LENGTH bytes has an anchor, its leftmost GRAM-byte string of least hash, which depends on the window
   alone. Consecutive windows with one anchor form a range. Equal windows have equal anchors at equal places, so a
   range whose anchor stands nowhere else repeats nothing and goes; ranges of equal bytes are one class, all
   repeated. What is left are the classes that share an anchor with other bytes around it.
2. Those classes, aligned at the anchor, are a collection of short segments. Column by column from the right, one
   symbol of each segment is put in front: a stable sort by symbol turns the order of suffixes at one column into the
   next one's (the symbols read in the old order are that column of the Burrows-Wheeler transform), and common
   prefixes of neighbours grow by one or fall to 0, through range minima. A window is repeated where a neighbour shares
   LENGTH symbols or more. Columns of other offsets never compare equal, so they need no merging.
3. Groups of one anchor with more than HOT classes are not gathered: their windows are counted by 128-bit hash.

Segments are read from and written to Spark's sorted shuffle files, in sequence; a task holds one batch of groups.

Defined results: null text is empty; texts shorter than LENGTH repeat nothing; a null id passes through; equal rows
repeat each other; rows with equal ids are told apart by their texts; no rows in, no rows out; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, column_bytes, cut, long_id

LENGTH, GRAM = 200, 32
WINDOW = LENGTH - GRAM + 1
#: Most classes of one anchor that one task gathers.
HOT = 50_000
#: Classes that are sorted together, and bytes of a text that are hashed together.
BATCH, CHUNK = 12_000, 1_000_000
WIDTH = WINDOW - 1 + LENGTH
_U = np.uint64


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def ranges(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, anchor and anchor hash of each range of a text."""
    out = []
    for at in range(0, len(text) - LENGTH + 1, CHUNK):
        part = np.frombuffer(text[at : at + CHUNK + LENGTH - 1], dtype=np.uint8)
        starts = np.arange(len(part) - GRAM + 1)
        hashes = Rolling(part).of(starts, starts + GRAM)
        anchor = (_least(hashes & _U(0xFFFFFFFF00000000) | starts.astype(np.uint64), WINDOW) & _U(0xFFFFFFFF)).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(head[1:], len(anchor)) - 1
        out.append((head + at, last + at, anchor[head] + at, hashes[anchor[head]].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _occurrences(docs: DataFrame, whole: bool) -> DataFrame:
    """Anchor hashes of each text's ranges; if ``whole``, with place and a hash of the range's bytes."""
    kinds = "h long" if not whole else "h long, s long, doc_id long, t long, first int, last int, anchor int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, marks, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), column_bytes(batch.column(2))
            for begin in range(0, len(texts), 500):
                hs, ss, ids, ts, firsts, lasts, anchors = [], [], [], [], [], [], []
                for key, mark, text in zip(keys[begin : begin + 500], marks[begin : begin + 500], texts[begin : begin + 500], strict=True):
                    first, last, anchor, h = ranges(text)
                    hs.append(h)
                    if whole:
                        digest = xxhash.xxh3_64_intdigest
                        ss += [digest(text[a : b + LENGTH]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                        ids += [key] * len(h)
                        ts += [mark] * len(h)
                        firsts.append(first)
                        lasts.append(last)
                        anchors.append(anchor)
                columns = [pa.array(np.concatenate(hs), pa.int64())]
                if whole:
                    columns += [pa.array(np.array(ss, dtype=np.uint64).view(np.int64)), pa.array(ids, pa.int64()), pa.array(ts, pa.int64()), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (firsts, lasts, anchors))]
                yield pa.RecordBatch.from_arrays(columns, names=[k.split()[0] for k in kinds.split(", ")])

    return docs.select("doc_id", "t", "text").mapInArrow(run, kinds)


def column_sort(segments: list[bytes], before: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which windows of aligned segments stand in another segment of their group too.

    ``before``: bytes of each segment in front of the anchor; ``group``: non-decreasing. The result has a row for each
    segment and a column for each window start, WINDOW - 1 bytes in front of the anchor up to the anchor itself.
    """
    count = len(segments)
    symbols = np.full((count, WIDTH), 256, dtype=np.int16)
    sizes = np.array([len(s) for s in segments])
    row = np.repeat(np.arange(count), sizes)
    within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    symbols[row, within + (WINDOW - 1 - before)[row]] = np.frombuffer(b"".join(segments), dtype=np.uint8)
    symbols = np.ascontiguousarray(symbols.T)
    order = np.arange(count)
    common = np.zeros(count + 1, dtype=np.int32)
    repeated = np.zeros((WINDOW, count), dtype=bool)
    base = group.astype(np.int64) * 257
    for column in range(WIDTH - 1, -1, -1):
        key = (base + symbols[column])[order]
        step = np.argsort(key, kind="stable")
        sorted_key = key[step]
        same = np.zeros(count, dtype=bool)
        same[1:] = (sorted_key[1:] == sorted_key[:-1]) & (sorted_key[1:] % 257 != 256)
        at = np.flatnonzero(same)
        grown = np.zeros(count + 1, dtype=np.int32)
        if len(at):
            low, high = step[at - 1] + 1, step[at]
            next_to = low == high
            grown[at[next_to]] = common[high[next_to]] + 1
            far = np.flatnonzero(~next_to)
            if len(far):
                pairs = np.column_stack([low[far], high[far] + 1]).ravel()
                grown[at[far]] = np.minimum.reduceat(common, pairs)[::2] + 1
        order, common = order[step], grown
        if column < WINDOW:
            hit = common >= LENGTH
            repeated[column, order] = hit[:-1] | hit[1:]
    return repeated.T


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true values."""
    padded = np.zeros((flags.shape[0], flags.shape[1] + 2), dtype=np.int8)
    padded[:, 1:-1] = flags
    edge = np.diff(padded, axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


_SPAN = "doc_id long, t long, begin int, end int"


def _segments(borders: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of each class's first range: (h, n, doc_id, t, first, last, anchor, segment)."""
    per_doc = borders.groupBy(F.col("doc_id").alias("of"), F.col("t").alias("ot")).agg(F.collect_list(F.struct("h", "n", "first", "last", "anchor")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out: list[list] = [[] for _ in range(8)]
                for key, mark, text, held in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), column_bytes(part.column(2)), part.column(3).to_pylist(), strict=True):
                    for x in held:
                        for column, value in zip(out, (x["h"], x["n"], key, mark, x["first"], x["last"], x["anchor"], text[x["first"] : x["last"] + LENGTH]), strict=True):
                            column.append(value)
                kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["h", "n", "doc_id", "t", "first", "last", "anchor", "segment"])

    # equal rows have one text: the first of them is enough
    both = docs.join(per_doc, docs["doc_id"].eqNullSafe(F.col("of")) & (docs["t"] == F.col("ot"))).select("doc_id", "t", "text", "held")
    return both.mapInArrow(run, "h long, n long, doc_id long, t long, first int, last int, anchor int, segment binary")


def _sorted_groups(segments: DataFrame) -> DataFrame:
    """Repeated spans of classes that hold one range, by the column-wise construction."""

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        h, n, ids, marks, first, _, anchor, held = zip(*rows, strict=True)
        group = np.cumsum(np.concatenate([[0], np.diff(np.array(h, dtype=np.int64)) != 0]))
        before = np.array(anchor) - np.array(first)
        flags = column_sort(list(held), before, group)
        flags[np.array(n) > 1] = False
        row, a, b = _runs(flags)
        place = np.array(anchor)[row] - (WINDOW - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[r] for r in row], pa.int64()), pa.array([marks[r] for r in row], pa.int64()), pa.array((place + a).astype(np.int32)), pa.array((place + b + LENGTH).astype(np.int32))],
            names=["doc_id", "t", "begin", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(rows) >= BATCH and row[0] != rows[-1][0]:
                    yield spans(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield spans(rows)

    return segments.repartition("h").sortWithinPartitions("h").mapInArrow(run, _SPAN)


def _counted_windows(segments: DataFrame) -> DataFrame:
    """The same for groups too large to gather: every window by a 128-bit hash, counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, n, key, mark, first, last, _, held = row
                size = last - first + 1
                digests = [hashlib.blake2b(held[i : i + LENGTH], digest_size=16).digest() for i in range(size)]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([n] * size, pa.int64()), pa.array([key] * size, pa.int64()), pa.array([mark] * size, pa.int64()), pa.array(range(first, last + 1), pa.int32())], names=["w", "n", "doc_id", "t", "begin"])

    windows = segments.mapInArrow(run, "w binary, n long, doc_id long, t long, begin int")
    often = cut(windows.groupBy("w").agg(F.sum("n").alias("times")).filter(F.col("times") > 1).select("w"))
    return windows.filter(F.col("n") == 1).join(often, "w").select("doc_id", "t", "begin", (F.col("begin") + LENGTH).cast("int").alias("end"))


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    plain = docs.select(long_id(docs, doc_id), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return plain.withColumn("t", F.xxhash64("text"))


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, t, spans) of the texts that hold repeated strings; spans of bytes may touch and overlap. ``docs``: (doc_id, text, t)."""
    repeated = cut(_occurrences(docs, False).groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("h"))
    live = cut(_occurrences(docs, True).join(repeated, "h"))
    classes = cut(live.groupBy("h", "s").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "t", "first", "last", "anchor")).alias("at")))
    full = live.join(classes.filter(F.col("n") > 1).select("h", "s"), ["h", "s"]).select("doc_id", "t", F.col("first").alias("begin"), (F.col("last") + LENGTH).cast("int").alias("end"))
    shared = classes.groupBy("h").agg(F.count("*").alias("classes"), F.min("n").alias("least")).filter((F.col("classes") > 1) & (F.col("least") == 1)).select("h", "classes")
    borders = cut(classes.join(shared, "h").select("h", "classes", "n", "at.*"))
    found = cut(_sorted_groups(_segments(borders.filter(F.col("classes") <= hot), docs)))
    spans = full.unionByName(found)
    large = borders.filter(F.col("classes") > hot)
    if large.limit(1).count():
        spans = spans.unionByName(cut(_counted_windows(_segments(large, docs))))
    return cut(spans.groupBy("doc_id", "t").agg(F.collect_list(F.struct("begin", "end")).alias("spans")))


def union_of(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for a, b in sorted((s["begin"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, hot: int) -> DataFrame:
    spans = repeated_spans(docs, hot)
    found = spans.select(F.col("doc_id").alias("of"), F.col("t").alias("ot"), "spans")
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("of")) & (docs["t"] == F.col("ot")), "left").select("doc_id", "text", "spans")


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    if not runs:
        return text
    edges = [0, *(x for run in runs for x in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def removed_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for text_, spans in zip(column_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                runs = union_of(spans)
                kept = _kept(text_, runs)
                for column, value in zip(out, (len(text_), len(text_) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(_marked(docs, doc_id, text), hot).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, text, spans): what is left of each text (a character cut in half goes), and the maximal removed runs of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = column_bytes(batch.column(1)), [union_of(s) for s in batch.column(2).to_pylist()]
            kept = [_kept(t, r).decode("utf-8", "ignore") for t, r in zip(texts, spans, strict=True)]
            of = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array([[{"begin": a, "end": b} for a, b in r] for r in spans], of)], names=["doc_id", "text", "spans"])

    return _with_spans(_marked(docs, doc_id, text), hot).mapInArrow(run, "doc_id long, text string, spans array<struct<begin:int,end:int>>")
