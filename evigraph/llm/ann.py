"""Approximate nearest neighbours by cross-polytope hashing.

Equal vectors are one class first, with its smallest ids, so copies never meet each other. Unit vectors go through
pseudo-rotations (random signs and fast Hadamard transforms, three times) to the nearest signed axis; a few tables of
such cells are built, with a second hash when the classes are many, so that cells keep their size as the data grows.
How many tables is measured: on a bounded sample the true neighbours are known, and tables are added until enough of them
are met. Neighbours among all classes are nearer than those within a sample, so more of them are met.
Queries probe the nearest axes of each table; what a cell holds is reranked by exact distance in double precision.
Cells above a size are split, and their queries repeated for each part, so no cell has to fit one task. Queries whose
cells hold fewer ids than are asked for are compared with all vectors of their length, in blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id; equal (id, vector) rows count once; another vector under the query's own id is no candidate; vectors
of another length than the query's are none either; equal distances are ordered by id; fewer candidates give fewer
rows; no rows in, no rows out; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, seeded, small

#: Tables at first and at most; they double until RECALL of the neighbours within a sample is found.
TABLES, MOST_TABLES = 10, 160
RECALL = 0.95
#: Classes that the number of tables is measured on, and queries among them.
SAMPLE, SAMPLE_QUERIES = 8_000, 200
#: Axes that a query probes in each hash.
PROBES = 8
#: Classes that a cell is meant to hold; a part of a split cell holds at most about CELL_PART.
CELL, CELL_PART = 64, 4096
SEED = "cross-polytope-1"


def _rotated(x: np.ndarray, seed: int) -> np.ndarray:
    n = x.shape[1]
    random = np.random.default_rng(seed)
    for _ in range(3):
        x = x * random.choice(np.array([-1.0, 1.0], dtype=np.float32), n)
        h = 1
        while h < n:
            y = x.reshape(len(x), n // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
            h *= 2
        x /= np.sqrt(n, dtype=np.float32)
    return x


def axes_for(count: int, size: int) -> list[int]:
    """How many of a vector's ``size`` axes each hash keeps: powers of two whose signed axes make about count / CELL cells.

    A further hash needs more cells than a query probes of it, else it would split cells without leaving any out.
    """
    full = 1 << max(0, (size - 1).bit_length())
    out, cells = [], max(4, count // CELL)
    while cells > 1 and len(out) < 4:
        axes = min(full, 1 << max(0, (cells // 2).bit_length() - 1))
        if out and 2 * axes <= PROBES:
            break
        out.append(axes)
        cells //= 2 * axes
    return out or [1]


def tables_for(x: np.ndarray, axes: list[int], k: int, recall: float = RECALL) -> int:
    """The least number of tables, doubled from TABLES, in which so large a share of the ``k`` nearest among the rows of ``x`` are met."""
    queries = np.linspace(0, len(x) - 1, min(len(x), SAMPLE_QUERIES)).astype(int)
    tables = TABLES * len(axes)
    if len(x) <= k + 1:
        return tables
    d = ((x[queries] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * x[queries] @ x.T)
    d[np.arange(len(queries)), queries] = np.inf
    near = np.argpartition(d, k, axis=1)[:, :k]
    met, done = np.zeros(near.shape, dtype=bool), 0
    while True:
        own, probed = cells(x, axes, 1, tables, done), cells(x[queries], axes, PROBES, tables, done)
        probed = probed.reshape(len(queries), tables - done, -1)
        for t in range(tables - done):
            met |= (own[near, t][:, :, None] == probed[:, t][:, None, :]).any(axis=2)
        if met.mean() >= recall or tables >= MOST_TABLES:
            return tables
        tables, done = 2 * tables, tables


def cells(x: np.ndarray, axes: list[int], probes: int, tables: int, first: int = 0) -> np.ndarray:
    """For each vector and table the cells of its nearest ``probes`` signed axes per hash, best first in each."""
    full = 1 << max(0, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), full), dtype=np.float32)
    padded[:, : x.shape[1]] = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    out = []
    for table in range(first, tables):
        found = np.full((len(x), 1), table, dtype=np.int64)
        for k, kept in enumerate(axes):
            y = _rotated(padded, seeded(SEED, full, table, k))[:, :kept]
            signed = np.concatenate([y, -y], axis=1)
            best = np.argsort(-signed, axis=1, kind="stable")[:, : min(probes, 2 * kept)] if probes > 1 else signed.argmax(1)[:, None]
            found = (found[:, :, None] * (2 * kept) + best[:, None, :]).reshape(len(x), -1)
        out.append(found)
    return np.concatenate(out, axis=1)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a - offsets[0] : b - offsets[0]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def usable(vector: str) -> Column:
    return F.expr(f"`{vector}` IS NOT NULL AND NOT exists(`{vector}`, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(`{vector}`, x -> x <> 0)")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query row."""
    rows = vectors.filter(usable(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    near = Window.partitionBy("v").orderBy("vec_id")
    held = rows.select("vec_id", "v").distinct().withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k + 1)
    classes = cut(held.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("class"), F.size("v").alias("size"), "v", "ids"))
    queries = cut(
        rows.filter("q").select("vec_id", "v").distinct().join(classes.select("class", "v"), "v").select(F.col("vec_id").alias("query_id"), "class", "v")
    )
    asked = queries.select("class", "v").distinct()
    counts = {r["size"]: r["n"] for r in classes.groupBy("size").agg(F.count("*").alias("n")).collect()}  # one row a vector length
    axes = {size: axes_for(n, size) for size, n in counts.items()}
    share = min(1.0, SAMPLE / max(1, sum(counts.values())))
    drawn = classes.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < share * (1 << 30)).select("size", "v").toArrow()  # about SAMPLE rows
    sampled: dict[int, list[np.ndarray]] = {size: [] for size in counts}
    for batch in drawn.to_batches():
        for size, v in zip(batch.column(0).to_pylist(), _vectors(batch.column(1)), strict=True):
            sampled[size].append(v)
    tables = {size: tables_for(np.stack(x) if x else np.zeros((0, size)), axes[size], k) for size, x in sampled.items()}
    kind_of_number = "<f4" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"

    def hashed(probes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors_ = _vectors(batch.column(1))
                sizes = np.array([len(v) for v in vectors_])
                found: list = [None] * len(vectors_)
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    got = cells(np.stack([vectors_[i] for i in at]), axes[int(size)], probes, tables[int(size)])
                    for i, row in zip(at, got, strict=True):
                        found[i] = row
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.astype(kind_of_number).tobytes() for v in vectors_], pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["id", "v", "cells"])

        return run

    kind = "id long, v binary, cells array<long>"
    data = cut(classes.select("class", "v").mapInArrow(hashed(1), kind)).withColumn("size", F.length("v"))
    probing = asked.mapInArrow(hashed(PROBES), kind).withColumn("size", F.length("v"))
    key = ["size", "cell"]
    large = small(cut(data.select("size", F.explode("cells").alias("cell")).groupBy(*key).count().filter(F.col("count") > CELL_PART).select(*key, F.ceil(F.col("count") / CELL_PART).cast("int").alias("parts"))))
    spread = data.select("id", "v", "size", F.explode("cells").alias("cell")).join(large, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int"))
    repeated = probing.select("id", "v", "size", F.explode("cells").alias("cell")).join(large, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_c, out_d = [], [], []
        if left.num_rows and right.num_rows:
            ids = right.column("id").to_numpy()
            x = np.frombuffer(b"".join(right.column("v").to_pylist()), dtype=kind_of_number).reshape(len(ids), -1).astype(np.float64)
            for q, v in zip(left.column("id").to_pylist(), left.column("v").to_pylist(), strict=True):
                d = np.sqrt(((x - np.frombuffer(v, dtype=kind_of_number).astype(np.float64)) ** 2).sum(axis=1))
                if len(d) > k + 1:
                    at = np.flatnonzero(d <= np.partition(d, k)[k])
                    at = at[np.lexsort((ids[at], d[at]))][: k + 1]
                else:
                    at = np.arange(len(d))
                out_q += [q] * len(at)
                out_c += ids[at].tolist()
                out_d += d[at].tolist()
        return pa.table({"q": pa.array(out_q, pa.int64()), "c": pa.array(out_c, pa.int64()), "d": pa.array(out_d, pa.float64())})

    by = ["size", "cell", "part"]
    found = repeated.select("id", "v", *by).groupBy(*by).cogroup(spread.select("id", "v", *by).groupBy(*by)).applyInArrow(rerank, "q long, c long, d double")

    def first(pairs: DataFrame) -> DataFrame:
        each = pairs.groupBy("q", "c").agg(F.min("d").alias("d"))
        return each.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("d", "c"))).filter(F.col("n") <= k + 1).select("q", "c", "d")

    best = cut(first(found))
    held = best.join(classes.select(F.col("class").alias("c"), F.size("ids").alias("ids")), "c").groupBy("q").agg(F.sum("ids").alias("held")).filter(F.col("held") > k)
    short = cut(probing.select("id", "v", "size").join(held.select(F.col("q").alias("id")), "id", "left_anti"))
    n_short = short.count()
    if n_short:  # cells held too few candidates: these queries meet every vector of their length, block by block
        blocks, parts = -(-n_short // CELL_PART), F.ceil(F.col("count") / CELL_PART).cast("int")
        totals = small(cut(data.groupBy("size").count().select("size", parts.alias("parts"))))
        whole = data.select("id", "v", "size").join(totals, "size").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = short.join(totals, "size").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        by = ["size", "part", "block"]
        exact = met.select("id", "v", *by).groupBy(*by).cogroup(whole.select("id", "v", *by).groupBy(*by)).applyInArrow(rerank, "q long, c long, d double")
        best = best.join(short.select(F.col("id").alias("q")), "q", "left_anti").unionByName(first(exact))
    listed = best.join(classes.select(F.col("class").alias("c"), "ids"), "c").select(F.col("q").alias("class"), "d", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        queries.select("query_id", "class")
        .join(listed, "class")
        .filter(F.col("vec_id") != F.col("query_id"))
        .groupBy("query_id", "vec_id")
        .agg(F.min("d").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
