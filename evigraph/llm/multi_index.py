"""Near-duplicate vectors by an inverted multi-index: all pairs of at least a cosine, counted and joined.

Unit vectors are cut into halves, each with a codebook of its own; the nearest codes of both halves name a cell of the
product grid. Every vector lies in one cell and visits others in the order of how far away, at least, a vector of that cell must be:
the distance from its halves to the planes between its own codes and those of the cell. The traversal (multi-sequence:
one sorted list a half) ends at the bound that finds the asked share of partners just at the threshold. What is met is verified.

1. Equal vectors are one class, a node.
2. Codebooks learn from a bounded sample (SAMPLE rows by a hash of the vector) without its own near copies, so that a group of
   copies isn't cut into many cells. Their size grows with the root of the number of nodes, so that cells stay as large.
3. A pair meets once: the vector of the smaller cell number visits. Rows of a cell meet in one task, which gives out
   numbers of links and only those links that join what was apart: no rows of pairs.
4. Cells beyond PART rows are dealt in blocks of held and asking rows. Members of such a cell that are so near to its mean that any
   two of them must be linked are counted by their number alone.
5. Components of the joining links give the classes.

Recall: a partner at exactly the threshold, in a random direction, is found with probability RECALL; nearer ones more likely, and
``recall=1.0`` visits every cell that may hold a partner.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and name
themselves; so do vectors of different lengths among each other; rows with equal ids are vectors of their own; a null id
is linked but names no component, and isn't kept; no rows in, no rows out; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ann import usable
from .common import cut, seeded, small, whole_groups
from .labelled import unit_hash
from .near_dedup import components

#: Rows that the codebooks learn from, and rows that the bound is measured on.
SAMPLE, PROBES = 20_000, 2_000
#: Nodes that a cell is meant to hold, and most codes of a half.
CELL, MOST_CODES = 128, 1_024
RECALL = 0.999
#: Held or asking rows of a cell that one task compares.
PART = 4_096
#: Rows of similarities computed at once.
STEP = 512
TURNS = 8


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T, 0)


def codebook(x: np.ndarray, codes: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from random distinct rows."""
    start = np.unique(x, axis=0)
    codes = max(1, min(codes, len(start)))
    if not len(start):
        return np.zeros((1, x.shape[1]))
    out = start[np.random.default_rng(seed).choice(len(start), codes, replace=False)]
    for _ in range(TURNS):
        near = _distances(x, out).argmin(1)
        order = np.argsort(near, kind="stable")
        found, first, n = np.unique(near[order], return_index=True, return_counts=True)
        out[found] = np.add.reduceat(x[order], first, axis=0) / n[:, None]
    return out


def without_copies(x: np.ndarray, cosine: float) -> np.ndarray:
    """Unit rows of which none is near to an earlier one that stays (up to a block: within one, the first of a row's partners counts)."""
    kept = np.zeros((0, x.shape[1]))
    for begin in range(0, len(x), STEP):
        block = x[begin : begin + STEP]
        if len(kept):
            block = block[(block @ kept.T).max(axis=1) < cosine]
        kept = np.concatenate([kept, block[(np.tril(block @ block.T, -1) < cosine).all(axis=1)]])
    return kept


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


@dataclass
class Grid:
    """Codebooks of both halves; cell number = first code * second codes + second code."""

    first: np.ndarray
    second: np.ndarray
    stop: float = np.inf

    @cached_property
    def _between(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.sqrt(_distances(c, c)) for c in (self.first, self.second))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Own code of each half, and squared least distance to each code's region, by half."""
        codes, least = [], []
        for half, book, between in zip(halves(x), (self.first, self.second), self._between, strict=True):
            d = _distances(half, book)
            own = d.argmin(1)
            gap = d - d[np.arange(len(d)), own][:, None]
            apart = 2 * between[own]
            least.append(np.where(apart > 0, gap / np.where(apart > 0, apart, 1), 0) ** 2)
            codes.append(own)
        return codes[0], codes[1], least[0], least[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b, _, _ = self.bounds(x)
        return a * len(self.second) + b

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Own cell of each row, and the cells of larger number that it visits."""
        a, b, least_a, least_b = self.bounds(x)
        cell, out = a * len(self.second) + b, []
        order_a, order_b = np.argsort(least_a, axis=1, kind="stable"), np.argsort(least_b, axis=1, kind="stable")
        for r in range(len(x)):
            i, j = order_a[r], order_b[r]
            by_a, by_b = least_a[r, i], least_b[r, j]
            reach = np.searchsorted(by_b, self.stop - by_a, side="right")  # of each code of the first list, how far the second goes
            n = int((reach > 0).sum())
            met = np.repeat(i[:n], reach[:n]) * len(self.second) + np.concatenate([j[:k] for k in reach[:n]])
            out.append(met[met > cell[r]])
        return cell, out


def fit_grid(x: np.ndarray, nodes: int, cosine: float, recall: float) -> Grid:
    """Codebooks and bound from sampled unit rows of one length."""
    seed = seeded("multi-index-1", x.shape[1])
    distinct = without_copies(x, cosine)
    codes = int(np.clip(round((nodes / CELL) ** 0.5), 1, MOST_CODES))
    grid = Grid(*(codebook(h, codes, seed + k) for k, h in enumerate(halves(distinct))))
    if recall >= 1 or not len(x):
        grid.stop = 2 - 2 * cosine + 1e-9  # squared distance of unit vectors at the threshold
        return grid
    random = np.random.default_rng(seed + 2)
    probes = distinct[random.permutation(len(distinct))[:PROBES]]
    aside = random.normal(size=probes.shape)
    aside -= (aside * probes).sum(1)[:, None] * probes
    norms = np.linalg.norm(aside, axis=1)
    aside[norms > 0] /= norms[norms > 0][:, None]
    _, _, least_a, least_b = grid.bounds(probes)
    a, b, _, _ = grid.bounds(cosine * probes + np.sqrt(1 - cosine**2) * aside)
    rows = np.arange(len(probes))
    grid.stop = min(2 - 2 * cosine, float(np.quantile(least_a[rows, a] + least_b[rows, b], recall, method="higher"))) + 1e-9
    return grid


def _unit(vectors: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), dtype=kind).reshape(len(vectors), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked(table: pa.Table, cosine: float, kind: str) -> pa.RecordBatch:
    """Counts (a, null, n) and joining links (a, b, null) of each group of rows (size, cell, i, j, turn, node, copies, own, core, v)."""
    head = np.ones(table.num_rows, dtype=bool)
    head[1:] = False
    for c in ("size", "cell", "i", "j"):
        head[1:] |= np.diff(table.column(c).to_numpy()) != 0
    starts = np.append(np.flatnonzero(head), table.num_rows)
    turn, node, copies, own, cell = (table.column(c).to_numpy() for c in ("turn", "node", "copies", "own", "cell"))
    core = table.column("core").to_numpy(zero_copy_only=False)
    packed = table.column("v").combine_chunks()
    counts: tuple[list, list] = ([], [])
    links: tuple[list, list] = ([], [])
    for begin, end in zip(starts[:-1], starts[1:], strict=True):
        asks = begin + np.flatnonzero(turn[begin:end] == ASK)
        held = begin + np.flatnonzero(turn[begin:end] == HELD)
        if not len(asks) or not len(held):
            continue
        y, label = _unit(packed.take(pa.array(held)).to_pylist(), kind), np.arange(len(held))
        met_y = np.zeros(len(held), dtype=np.int64)
        for k in range(0, len(asks), STEP):
            step = asks[k : k + STEP]
            at_home = own[step] == cell[begin]
            once = ~at_home[:, None] | core[held] | (node[step][:, None] < node[held])  # at home the smaller node asks, but core rows never do
            found = (_unit(packed.take(pa.array(step)).to_pylist(), kind) @ y.T >= cosine) & once
            some = np.flatnonzero(found.any(axis=1))
            if not len(some):
                continue
            counts[0].append(node[step[some]])
            counts[1].append(found[some] @ copies[held])
            met_y += copies[step[some]] @ found[some]
            for r in some:
                partners = np.flatnonzero(found[r])
                labels, first = np.unique(label[partners], return_index=True)
                links[0].append(np.full(len(first), node[step[r]]))
                links[1].append(node[held[partners[first]]])
                if len(labels) > 1:
                    label[np.isin(label, labels)] = labels[0]
        some = np.flatnonzero(met_y)
        counts[0].append(node[held[some]])
        counts[1].append(met_y[some])
    a, n, x, y = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (*counts, *links))
    none_n, none_x = pa.nulls(len(a), pa.int64()), pa.nulls(len(x), pa.int64())
    columns = ((pa.array(a), pa.array(x)), (none_n, pa.array(y)), (pa.array(n), none_x))
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["a", "b", "n"])


ASK, HELD = 0, 1
_PLACED = "node long, size int, copies long, v binary, cell long, visits array<long>"


def _packed(vectors: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, str]:
    """(vec_id, size, v): the bytes of the vectors that take part, null for others; and numpy's name of their numbers."""
    single = vectors.schema[vector].dataType.elementType.simpleString() == "float"
    kind, element = ("<f4", pa.float32()) if single else ("<f8", pa.float64())
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(usable(vector), F.col(vector).cast("array<float>" if single else "array<double>")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1)
            values = held.flatten().cast(element).to_numpy(zero_copy_only=False).astype(kind) + 0.0  # no -0.0: equal vectors have equal bytes
            sizes = np.array(pc.list_value_length(held).fill_null(0))
            ends = np.cumsum(sizes)
            packed = [values[e - n : e].astype(kind).tobytes() if n else None for e, n in zip(ends, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", "size", "v"])

    return rows.mapInArrow(run, f"vec_id {vectors.schema[vec_id].dataType.simpleString()}, size int, v binary"), kind


def _grids(nodes: DataFrame, kind: str, cosine: float, recall: float, sample: int) -> dict[int, Grid]:
    """A grid for each length of vectors."""
    counts = {r["size"]: r["n"] for r in nodes.groupBy("size").agg(F.count("*").alias("n")).collect()}  # one row a vector length
    share = min(1.0, sample / max(1, sum(counts.values())))
    drawn = nodes.filter(unit_hash(F.col("v"), "multi-index") < share).select("size", "v").toArrow().sort_by([("size", "ascending"), ("v", "ascending")])
    held: dict[int, list[bytes]] = {size: [] for size in counts}
    for size, v in zip(drawn.column("size").to_pylist(), drawn.column("v").to_pylist(), strict=True):
        held[size].append(v)
    return {size: fit_grid(_unit(v, kind) if v else np.zeros((0, size)), counts[size], cosine, recall) for size, v in held.items()}


def _cores(members: DataFrame, kind: str, cosine: float) -> DataFrame:
    """(node, core) of members (size, cell, node, v) of large cells: whether the distance to the cell's mean is under half the threshold's."""
    key = "size int, cell long"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 2, 1):
            cells = table.column("cell").to_numpy() * 1.0
            edges = np.append(np.flatnonzero(np.append(True, (np.diff(cells) != 0) | (np.diff(table.column("size").to_numpy()) != 0))), len(cells))
            packed = table.column("v").combine_chunks()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                total = np.sum([_unit(packed.slice(k, min(STEP, b - k)).to_pylist(), kind).sum(axis=0) for k in range(a, b, STEP)], axis=0)
                yield pa.RecordBatch.from_arrays([table.column(c).slice(a, 1).combine_chunks() for c in ("size", "cell")] + [pa.array([b - a], pa.int64()), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["size", "cell", "n", "total"])

    def mean(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(t, dtype="<f8") for t in table.column("total").to_pylist()], axis=0) / sum(table.column("n").to_pylist())
        return pa.table({"size": table.column("size").slice(0, 1), "cell": table.column("cell").slice(0, 1), "mean": pa.array([total.astype("<f8").tobytes()], pa.binary())})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for v, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found.append(bool(np.linalg.norm(_unit([v], kind)[0] - np.frombuffer(m, dtype="<f8")) <= 0.5 * np.sqrt(2 - 2 * cosine) * (1 - 1e-9)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.bool_())], names=["node", "core"])

    # sorted within the tasks that hold them: a row a task and cell goes on
    means = members.select("size", "cell", "v").sortWithinPartitions("size", "cell").mapInArrow(sums, f"{key}, n long, total binary").groupBy("size", "cell").applyInArrow(mean, f"{key}, mean binary")
    return members.select("node", "size", "cell", "v").join(small(cut(means)), ["size", "cell"]).select("node", "v", "mean").mapInArrow(near, "node long, core boolean").filter("core")


def near_vectors(vectors: DataFrame, percent: int = 95, vec_id: str = "vec_id", vector: str = "embedding", recall: float = RECALL, sample: int = SAMPLE, part: int = PART) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: linked where 100 times the cosine is at least ``percent``."""
    cosine = percent / 100
    rows, kind = _packed(vectors, vec_id, vector)
    packed = cut(rows)
    nodes = cut(packed.filter("v IS NOT NULL").groupBy("size", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    sent = vectors.sparkSession.sparkContext.broadcast(_grids(nodes, kind, cosine, recall, sample))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                for k in range(0, own.num_rows, STEP):
                    step = own.slice(k, STEP)
                    cell, visits = sent.value[int(size)].visits(_unit(step.column(3).to_pylist(), kind))
                    yield pa.RecordBatch.from_arrays([*step.columns, pa.array(cell), pa.array(visits, pa.list_(pa.int64()))], names=["node", "size", "copies", "v", "cell", "visits"])

    placed = cut(nodes.select("node", "size", "copies", "v").mapInArrow(place, _PLACED))
    key, row = ["size", "cell"], ["turn", "node", "copies", "own", "core", "v"]
    held_by, asked_by = placed.groupBy(*key).agg(F.count("*").alias("held")), placed.select("size", F.explode("visits").alias("cell")).groupBy(*key).agg(F.count("*").alias("asked"))
    parts = F.ceil(F.col("held") / part).cast("int")
    blocks = F.ceil((F.col("held") + F.coalesce("asked", F.lit(0))) / part).cast("int")
    large = small(cut(held_by.join(asked_by, key, "left").select(*key, parts.alias("parts"), blocks.alias("blocks")).filter("parts > 1 OR blocks > 1")))
    crowded = placed.join(large.filter("parts > 1"), key, "left_semi")
    cores = cut(_cores(crowded, kind, cosine))
    members = placed.drop("visits").join(large, key, "left").join(small(cores), "node", "left").select(*key, "node", "copies", "v", F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce("blocks", F.lit(1)).alias("blocks"), F.coalesce("core", F.lit(False)).alias("core"))
    visiting = placed.select("size", F.col("cell").alias("own"), "node", "copies", "v", F.explode("visits").alias("cell")).join(large, key, "left")

    def numbered(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.coalesce(count, F.lit(1)) - 1))

    def dealt(count: str, salt: int) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.coalesce(count, F.lit(1))).cast("int")

    held = members.select(*key, "parts", "node", "copies", F.col("cell").alias("own"), "core", "v", numbered("blocks").alias("j")).withColumn("i", dealt("parts", 0)).withColumn("turn", F.lit(HELD))
    home = members.filter("NOT core").select(*key, "blocks", "node", "copies", F.col("cell").alias("own"), "core", "v", numbered("parts").alias("i")).withColumn("j", dealt("blocks", 1)).withColumn("turn", F.lit(ASK))
    guests = visiting.select(*key, "blocks", "node", "copies", "own", F.lit(False).alias("core"), "v", numbered("parts").alias("i")).withColumn("j", dealt("blocks", 1)).withColumn("turn", F.lit(ASK))
    meeting = held.select(*key, "i", "j", *row).unionByName(home.select(*key, "i", "j", *row)).unionByName(guests.select(*key, "i", "j", *row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 4, part):
            yield linked(table, cosine, kind)

    found = cut(meeting.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j", "turn", "node").mapInArrow(run, "a long, b long, n long"))
    core_rows = placed.select(*key, "node", "copies").join(small(cores), "node")
    centre = small(cut(core_rows.groupBy(*key).agg(F.sum("copies").alias("all"), F.min("node").alias("first"))))
    by_core = cut(core_rows.join(centre, key).select("node", "first", (F.col("all") - F.col("copies")).alias("n")))
    counts = found.filter("n IS NOT NULL").select(F.col("a").alias("node"), "n").unionByName(by_core.select("node", "n")).groupBy("node").agg(F.sum("n").alias("n"))
    links = found.filter("n IS NULL").select("a", "b").unionByName(by_core.filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")))
    labels = components(links)
    least = labels.join(nodes.select(F.col("node").alias("id"), "least"), "id").groupBy("component").agg(F.min("least").alias("least"))
    of_node = labels.join(least, "component").select(F.col("id").alias("node"), F.col("least").alias("reached"))
    known = nodes.join(counts, "node", "left").join(of_node, "node", "left").select("size", "v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("reached", "least").alias("named"))
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("named"))
    return packed.join(known, ["size", "v"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
