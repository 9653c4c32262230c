"""Centroid clustering with block-norm screening: Lloyd rounds over integer vectors, exact to the last digit.

Each vector is stored once as integers with the norms of its segments, its compressed form. By Cauchy-Schwarz no vector
is nearer to a centroid than the segment norms of both allow: the sum of (|x_s| - |c_s|) ** 2 over segments s. Centroids
are taken by ascending bound; those whose bound exceeds the least distance so far are left out, all others get exact
integer distances. A round sends a row a batch and cluster to the shuffle, and the driver sees the sums of the clusters.

Defined results: vectors of another length, null, or with null, non-finite components take no part, nor do those with a
component of 2 ** 27 or more after scaling, whose squared distances no long could hold; rows with equal ids are vectors
of their own, equal hashes start in the order of their components; rows without an id are assigned but are no starting
centroid; fewer rows than clusters make fewer centroids; no rows in, no rows out; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CLUSTERS, ROUNDS = 16, 3
DIMENSIONS, SCALE = 64, 64
#: Components of a segment, whose norm stands for it.
SEGMENT = 4
#: Components below this keep every squared distance within a long.
MOST = 1 << 27
#: What rounding may add to a bound, as a share; bounds are lowered by it.
ROUNDING = 1e-9


def segment_norms(x: np.ndarray) -> np.ndarray:
    """Norms of the segments of each row of integers."""
    width = -(-x.shape[1] // SEGMENT) * SEGMENT
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    return np.sqrt((padded.reshape(len(x), -1, SEGMENT) ** 2).sum(axis=2))


@dataclass
class Centroids:
    """Integer centroids and their segment norms."""

    values: np.ndarray

    def nearest(self, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Cluster and exact squared distance of each row (the smaller number where equal), and how many exact distances it took."""
        own = segment_norms(self.values)
        bound = (norms**2).sum(1)[:, None] + (own**2).sum(1) - 2 * norms @ own.T
        bound -= ROUNDING * ((norms**2).sum(1)[:, None] + (own**2).sum(1)) + 1e-6
        order = np.argsort(bound, axis=1, kind="stable")
        best, cluster = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), dtype=np.int64)
        left, made = np.arange(len(x)), 0
        for turn in range(len(self.values)):
            c = order[left, turn]
            near = bound[left, c] <= best[left]  # what comes later has no smaller bound
            left, c = left[near], c[near]
            if not len(left):
                break
            made += len(left)
            d = ((x[left] - self.values[c]) ** 2).sum(axis=1)
            better = (d < best[left]) | ((d == best[left]) & (c < cluster[left]))
            best[left[better]], cluster[left[better]] = d[better], c[better]
        return cluster, best, made


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, codes, norms) of the vectors that take part: little-endian integers and doubles."""
    x = f"transform(`{vector}`, x -> floor({scale}D * double(x)))"
    fits = f"size(`{vector}`) = {dimensions} AND NOT exists(`{vector}`, x -> x IS NULL OR isnan(x) OR abs(double(x)) >= {float(MOST) / scale}D)"
    kept = vectors.select(F.col(vec_id).alias("vec_id"), F.when(F.expr(fits), F.expr(x)).alias("x")).filter("x IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(batch.num_rows, dimensions)
            norms = segment_norms(x.astype(np.int64)).astype("<f8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in norms], pa.binary())], names=["vec_id", "codes", "norms"])

    return kept.mapInArrow(run, f"vec_id {vectors.schema[vec_id].dataType.simpleString()}, codes binary, norms binary")


def _unpacked(batch: pa.RecordBatch, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    at = batch.schema.names.index
    codes = np.frombuffer(b"".join(batch.column(at("codes")).to_pylist()), dtype="<i4").reshape(batch.num_rows, dimensions)
    return codes.astype(np.int64), np.frombuffer(b"".join(batch.column(at("norms")).to_pylist()), dtype="<f8").reshape(batch.num_rows, -1)


def starting_centroids(held: DataFrame, clusters: int, dimensions: int) -> np.ndarray:
    """The vectors of the smallest SHA-256 of ``1:<id>``, in that order."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = held.filter("vec_id IS NOT NULL").select(key.alias("key"), "codes").orderBy("key", "codes").limit(clusters).collect()
    return np.array([np.frombuffer(r.codes, dtype="<i4") for r in first], dtype=np.int64).reshape(len(first), dimensions)


def moved(held: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: each centroid becomes the floor of its vectors' mean in every component; empty ones stay."""
    dimensions = centroids.shape[1]
    sent = held.sparkSession.sparkContext.broadcast(Centroids(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, norms = _unpacked(batch, dimensions)
            cluster, _, _ = sent.value.nearest(x, norms)
            order = np.argsort(cluster, kind="stable")
            found, first, n = np.unique(cluster[order], return_index=True, return_counts=True)
            sums = np.add.reduceat(x[order], first, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n, pa.int64()), pa.array(list(sums), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = held.select("codes", "norms").mapInArrow(run, "cluster int, n long, sums array<long>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(dimensions)])
    out = centroids.copy()
    for r in totals.collect():  # one row a cluster
        out[r.cluster] = [r[f"s{k}"] // r.n for k in range(dimensions)]
    return out


def assigned(held: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dimensions = centroids.shape[1]
    sent = held.sparkSession.sparkContext.broadcast(Centroids(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = sent.value.nearest(*_unpacked(batch, dimensions))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return held.mapInArrow(run, f"vec_id {held.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, vec_id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    held = cut(integer_vectors(vectors, vec_id, vector, dimensions, scale))
    centroids = starting_centroids(held, clusters, dimensions)
    for _ in range(rounds):
        centroids = moved(held, centroids)
    found = cut(assigned(held, centroids)) if len(centroids) else assigned(held.limit(0), np.zeros((1, dimensions), dtype=np.int64))
    sums = {r.cluster: r.n for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # one row a cluster
    rows = [(k, n, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, n in sums.items()]
    of_cluster = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
