"""Near-duplicate classes by SetSketch: banded registers, joint likelihood estimates, verification on full sets.

A document is the set of its distinct word shingles (whole texts, ASCII lower case). Each shingle draws ascending points
of a Poisson process marked with registers; a register keeps the smallest point, rounded on an exponential scale with
base B. Registers merge by maximum and agree with probability close to the Jaccard similarity.

1. Documents with equal sets are one class (128-bit digests and the size), a node of the graph.
2. Bands of registers make buckets. The nodes of a bucket are compared by joint likelihood inside a task, which gives
   out only links that join what was apart, fewer than the bucket has nodes. Connected components of these links are
   families: two nodes of one bucket that may reach the threshold are always in one family.
3. The full sets of a family's nodes meet once, in one task, and are verified there, again giving out only joining
   links. A set more than the threshold's share of which stands in no other set of the family has no partner.
4. Components of the verified links are the classes of near-duplicates.

Groups beyond PART_BYTES are dealt in parts that share a few nodes; where a group is then still in several pieces, what
is outside its largest piece meets every part. So no task gathers a group whole, and no pair is left out.

With 32 bands of 4 registers a pair at similarity 0.8 shares no bucket with probability (1 - 0.8 ** 4) ** 32 = 5e-8; by a
normal tail the likelihood bound of 12.5 (5 standard errors) rules out about 3e-7 of the pairs exactly at 0.8. These are
the only links that can be lost; most of such pairs are joined through other documents all the same.

Defined results: null text and text without words is an empty set, linked with nothing; with fewer words than a
shingle the whole sequence is one; a null id is linked with nothing and has a null component; rows with equal ids
are one node; ids may be of any type with an order; no rows in, no rows out; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Rolling, column_bytes, cut, fresh, joined, lowered, mix64, small, text_steps, tidied, whole_groups, word_spans

REGISTERS, BANDS = 128, 32
#: Base of the exponential scale of register values, and the value of a point at 1.
B, OFFSET = 1.001, 8000
#: Points beyond (ln REGISTERS + TAIL) / set size are drawn only where a register is still open.
TAIL = 12.0
#: A pair is ruled out if its log likelihood at or above the threshold is so much below the best.
EXCLUDED = 12.5
#: Fewer equal registers than at the threshold less this are excluded without the likelihood (over 8 standard errors).
LEAST = 0.3
#: Bytes of sketches or sets that one task compares with each other, and nodes that all parts of a larger group share.
PART_BYTES, SHARED = 24_000_000, 16
#: Bands whose buckets are compared first.
FIRST_BANDS = 2
#: Groups up to this many nodes are compared in bulk; pairs compared in one step; rows read before a step.
BULK, PAIRS, ROWS = 24, 100_000, 20_000
_U = np.uint64


def shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    data, begins = joined(texts)
    data = lowered(data)
    starts, ends = word_spans(data)
    hashes = Rolling(data).of(starts, ends)
    bounds = np.searchsorted(starts, begins)
    size = max(0, len(hashes) - words + 1)
    combined = np.zeros(size, dtype=np.uint64)
    for k in range(words):
        combined = combined * _U(0x9E3779B97F4A7C15) + hashes[k : size + k]
    combined = mix64(combined)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(combined[a : b - words + 1]))
        elif b > a:
            whole = _U(b - a)
            for h in hashes[a:b]:
                whole = mix64(np.array([int(whole) * 0xD1B54A32D192ED03 + int(h) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0]
            out.append(np.array([whole], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Register values, one row a set; sets may be empty (all 0)."""
    m = REGISTERS
    sizes = np.array([len(s) for s in sets])
    points = np.full(len(sets) * m, np.inf)
    todo, tail = np.flatnonzero(sizes), TAIL
    while len(todo):
        element = np.concatenate([sets[i] for i in todo])
        owner = np.repeat(todo, sizes[todo])
        limit = np.zeros(len(sets))
        limit[todo] = (np.log(m) + tail) / sizes[todo]
        x, bound, salt = np.zeros(len(element)), limit[owner], 0
        while len(element):
            salt += 1
            random = mix64(element + _U(salt * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
            x = x - np.log1p(-((random >> _U(11)).astype(np.float64) * 2.0**-53)) / m
            keep = np.flatnonzero(x <= bound)
            element, owner, x, bound = element[keep], owner[keep], x[keep], bound[keep]
            register = (mix64(random[keep]) >> _U(57)).astype(np.int64)
            np.minimum.at(points, owner * m + register, x)
        full = np.isfinite(points.reshape(-1, m)[todo]).all(axis=1)
        todo, tail = todo[~full], tail * 4
    values = np.floor(OFFSET - np.log(np.where(np.isfinite(points), points, 1.0)) / np.log(B))
    return np.where(np.isfinite(points), np.clip(values, 1, 65535), 0).astype("<u2").reshape(-1, m)


def bands(registers: np.ndarray) -> np.ndarray:
    rows = REGISTERS // BANDS
    parts = registers.astype(np.uint64).reshape(len(registers), BANDS, rows)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0xD1B54A32D192ED03), (len(registers), BANDS)).copy()
    for k in range(rows):
        out = mix64(out * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out.view(np.int64)


def _agree(x: np.ndarray) -> np.ndarray:
    """-log_B(1 - x (B - 1) / B), by its series: the argument is below 0.001."""
    z = x * ((B - 1) / B)
    return z * (1 + z * (1 / 2 + z / 3)) / np.log(B)


def may_reach(threshold: float, n_u: np.ndarray, n_v: np.ndarray, more: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a similarity of at least ``threshold`` is likely enough, and the likeliest similarity (0: not looked at).

    ``more`` and ``less`` count the registers in which U's value is larger or smaller than V's; set sizes are exact.
    """
    equal = REGISTERS - more - less
    possible = (equal >= REGISTERS * (threshold - LEAST)) & (np.minimum(n_u, n_v) >= threshold * np.maximum(n_u, n_v) - 1e-9)
    ok, likeliest = np.zeros(len(equal), dtype=bool), np.zeros(len(equal))
    for at in np.array_split(np.flatnonzero(possible), 1 + possible.sum() // 4_000):
        ok[at], likeliest[at] = _likelihood(threshold, n_u[at], n_v[at], more[at], less[at])
    return ok, likeliest


def _likelihood(threshold: float, n_u: np.ndarray, n_v: np.ndarray, more: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood on a grid of similarities that holds the threshold; its top between grid points by a parabola."""
    step = 0.05
    grid = threshold + step * np.arange(-round((threshold - 0.4) / step), round((1 - threshold) / step) + 1)
    n_u, n_v = n_u.astype(float)[:, None], n_v.astype(float)[:, None]
    u = n_u / (n_u + n_v)
    v = 1 - u
    top = np.minimum(n_u, n_v) / np.maximum(n_u, n_v)
    j = np.minimum(grid, top)
    p, q = (np.maximum(_agree(np.maximum(x, 0)), 1e-9) for x in (u - v * j, v - u * j))
    ll = more[:, None] * np.log(p) + less[:, None] * np.log(q) + (REGISTERS - more - less)[:, None] * np.log(np.maximum(1 - p - q, 1e-9))
    ll[grid > top + 1e-9] = -np.inf
    best = ll.argmax(1)
    rows, inner = np.arange(len(ll)), np.clip(best, 1, len(grid) - 2)
    with np.errstate(invalid="ignore", divide="ignore"):
        bend = ll[rows, inner - 1] - 2 * ll[rows, inner] + ll[rows, inner + 1]
        shift = np.where(bend < 0, (ll[rows, inner - 1] - ll[rows, inner + 1]) / (2 * bend), 0)
    at = np.where(np.isfinite(shift), np.clip(grid[inner] + step * shift, 0, top[:, 0]), grid[best])
    return ll[:, grid >= threshold - 1e-9].max(1) >= ll[rows, best] - EXCLUDED, at


def document_sketches(docs: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, n, digest, sketch, bytes) of every row; ``mark`` is a hash of the text, ``bytes`` its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = column_bytes(batch.column(2))
            for part, texts in text_steps(range(len(whole)), whole):
                sets = shingles(texts, words)
                sums = [(int(s.sum()), int(mix64(s ^ _U(0x8EBC6AF09C88C6E3)).sum())) if len(s) else (0, 0) for s in sets]
                digests = [a.to_bytes(8, "little") + b.to_bytes(8, "little") + len(s).to_bytes(8, "little") for (a, b), s in zip(sums, sets, strict=True)]
                own = batch.slice(part.start, len(part))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in sketches(sets)], pa.binary()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["doc_id", "mark", "n", "digest", "sketch", "bytes"],
                )

    kinds = StructType([StructField("doc_id", docs.schema[doc_id].dataType), *StructType.fromDDL("mark long, n long, digest binary, sketch binary, bytes long").fields])
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")).mapInArrow(run, kinds)


def _buckets(labelled: DataFrame, first: int, last: int) -> DataFrame:
    """(key, node, label, total) for every bucket of bands ``first`` to ``last - 1`` whose nodes differ in label; ``total``
    counts its bytes of sketches. ``labelled``: (node, label, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            registers = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u2").reshape(-1, REGISTERS)
            node, label = (np.repeat(batch.column(i).to_numpy(), last - first) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(bands(registers)[:, first:last].ravel()), pa.array(node), pa.array(label)], names=["key", "node", "label"])

    single = labelled.select("node", "label", "sketch").mapInArrow(run, "key long, node long, label long").repartition("key")
    mixed = single.groupBy("key").agg((F.count("*") * 2 * REGISTERS).alias("total"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key", "total")
    return single.join(mixed, "key")


def _joins(label: np.ndarray, asks: np.ndarray, others: np.ndarray, similar: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of an ask and another row that are similar, enough to join all that similar pairs join.

    ``label``: what is joined already, as small integers; it is changed. ``asks`` and ``others``: flags of rows. Where all
    rows do both, those of the largest piece need not ask: whoever is outside asks them.
    """
    out: list[tuple[int, int]] = []
    asks, others, all_ask = asks.copy(), others.copy(), bool((asks == others).all())
    while True:
        largest = np.bincount(label[asks | others]).argmax() if all_ask and (asks | others).any() else -1
        todo = np.flatnonzero(asks & (label != largest))
        if not len(todo):
            return out
        for p in todo:
            if label[p] == largest:
                continue
            asks[p] = others[p] = False
            candidates = np.flatnonzero(others & (label != label[p]))
            found = candidates[similar(p, candidates)] if len(candidates) else candidates
            if len(found):
                met, first = np.unique(label[found], return_index=True)
                out += [(int(p), int(y)) for y in found[first]]
                own = met[0] if largest not in met else largest  # the largest keeps its label
                label[np.isin(label, met) | (label == label[p])] = own
                if all_ask and largest not in met and (label == own).sum() > (label == largest).sum():
                    largest = own


def _same(x: np.ndarray, y: np.ndarray, count: int) -> np.ndarray:
    """Smallest row reachable over the pairs (x, y), for each of ``count`` rows."""
    label = np.arange(count)
    while len(x):
        low, before = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _likely(table: pa.Table, threshold: float) -> pa.RecordBatch:
    """Joining links (a, b) of likely pairs within each group of rows (key, i, j, turn, label, node, n, sketch)."""
    turn, named, node, n = (table.column(c).to_numpy() for c in ("turn", "label", "node", "n"))
    registers = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype="<u2").reshape(-1, REGISTERS)
    group, starts = _groups(table)
    sizes = np.diff(np.append(starts, len(group)))
    bulk = (sizes <= BULK)[group]
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def may(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=bool)
        for at in range(0, len(x), PAIRS):
            left, right = registers[x[at : at + PAIRS]], registers[y[at : at + PAIRS]]
            near = np.flatnonzero((left == right).sum(1) >= REGISTERS * (threshold - LEAST))
            left, right = left[near], right[near]
            ok, _ = may_reach(threshold, n[x[at + near]], n[y[at + near]], (left > right).sum(1), (left < right).sum(1))
            out[at + near] = ok
        return out

    for apart in range(1, BULK):  # all pairs of the small groups at once
        x = np.flatnonzero(bulk[:-apart] & (group[:-apart] == group[apart:])) if len(group) > apart else np.zeros(0, np.int64)
        if not len(x):
            break
        x = x[(turn[x] != turn[x + apart]) | (turn[x] == BOTH)]
        x = x[named[x] != named[x + apart]]
        x = x[may(x, x + apart)]
        xs.append(x)
        ys.append(x + apart)
    label = _same(np.concatenate(xs), np.concatenate(ys), len(group))
    moved = np.flatnonzero(label != np.arange(len(group)))
    left, right = [node[label[moved]]], [node[moved]]
    for g in np.flatnonzero(sizes > BULK):
        rows = slice(starts[g], starts[g] + sizes[g])
        base = starts[g]
        links = _joins(np.unique(named[rows], return_inverse=True)[1], turn[rows] != OTHER, turn[rows] != ASK, lambda p, y, base=base: may(np.full(len(y), base + p), base + y))
        left.append(node[[base + p for p, _ in links]])
        right.append(node[[base + y for _, y in links]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), pa.int64()) for v in (left, right)], names=["a", "b"])


def _groups(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group of each row, and first row of each group: runs of equal (key, i, j)."""
    head = np.ones(table.num_rows, dtype=bool)
    head[1:] = False
    for c in ("key", "i", "j"):
        head[1:] |= np.diff(table.column(c).to_numpy()) != 0
    return np.cumsum(head) - 1, np.flatnonzero(head)


def joining_links(sets: list[np.ndarray], label: np.ndarray, asks: np.ndarray, others: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of rows whose sets reach ``percent``, enough to join all that such pairs join."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    tokens, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat = flat.astype(np.int32)
    alive, before = np.ones(len(sets), dtype=bool), -1
    while before != alive.sum():  # who has too many shingles of its own can't have a partner
        before = alive.sum()
        times = np.bincount(flat[np.repeat(alive, sizes)], minlength=len(tokens))
        shared = np.add.reduceat(times[flat] > 1, starts)
        alive &= 100 * shared >= percent * sizes
    stamp = np.zeros(len(tokens), dtype=bool)

    def similar(p: int, y: np.ndarray) -> np.ndarray:
        own = flat[starts[p] : starts[p] + sizes[p]]
        stamp[own] = True
        if 5 * sizes[y].sum() > len(flat):
            both = np.add.reduceat(stamp[flat], starts, dtype=np.int64)[y]
        else:
            ends = np.cumsum(sizes[y])
            at = np.arange(ends[-1]) + np.repeat(starts[y] - (ends - sizes[y]), sizes[y])
            both = np.add.reduceat(stamp[flat[at]], ends - sizes[y], dtype=np.int64)
        stamp[own] = False
        return 100 * both >= percent * (sizes[p] + sizes[y] - both)

    return _joins(label, asks & alive, others & alive, similar)


def _verified(tables: Iterator[pa.Table], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Joining links of each group of rows (key, i, j, turn, label, node, text) that hold on full sets."""
    for table in tables:
        _, starts = _groups(table)
        turn, named, node = (table.column(c).to_numpy() for c in ("turn", "label", "node"))
        texts = column_bytes(table.column("text").combine_chunks())
        # equal rows under one id give a node's text more than once
        once = np.ones(len(node), dtype=bool)
        once[1:] = (node[1:] != node[:-1]) | (turn[1:] != turn[:-1])
        once[starts] = True
        kept = np.flatnonzero(once)
        sets: list[np.ndarray] = []
        for _, part in text_steps(kept, [texts[k] for k in kept]):
            sets += shingles(part, words)
        turn, named, node = turn[kept], named[kept], node[kept]
        bounds = np.append(np.searchsorted(kept, starts), len(kept))
        found: tuple[list, list] = ([], [])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > 1:
                label = np.unique(named[a:b], return_inverse=True)[1]
                for p, y in joining_links(sets[a:b], label, turn[a:b] != OTHER, turn[a:b] != ASK, percent):
                    found[0].append(node[a + p])
                    found[1].append(node[a + y])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])


#: What a row of a group does: it asks all others, is asked, or both.
ASK, OTHER, BOTH = 0, 1, 2


def _spanning(groups: DataFrame, links_of: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """Links (a, b) that join all nodes of a group which are similar, by way of others or not.

    ``groups``: (key, node, label, total), equal labels being joined already and ``total`` the bytes of the group; ``links_of`` gives the joining links of
    rows (key, i, j, turn, label, node), comparing those with equal (key, i, j).
    """
    parts = F.ceil(F.col("total") / most).cast("int")
    dealt = groups.select("key", "node", "label", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("i"))
    row = [F.lit(0).alias("j"), F.lit(BOTH).alias("turn"), "label", "node"]
    rows = dealt.select("key", "i", *row)
    large = cut(dealt.filter("parts > 1"))
    if not large.limit(1).count():
        return cut(links_of(rows))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node"), "node"))
    common = large.withColumn("place", place).filter(F.col("place") <= SHARED).withColumn("own", F.col("i")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("i <> own")
    links = cut(links_of(rows.unionByName(common.select("key", "i", *row))))
    known = large.filter("label <> node").select(F.col("label").alias("a"), F.col("node").alias("b"))
    named = cut(large.drop("label").join(components(links.unionByName(known)), large["node"] == F.col("id"), "left").select("key", "parts", "i", "node", F.coalesce("component", "node").alias("label")))
    pieces = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = cut(pieces.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("pieces")).filter("pieces > 1"))
    held = named.join(mixed, "key")
    blocks = F.ceil(F.col("parts") * (F.col("n") - F.col("most")) / F.col("n")).cast("int")
    asked = held.filter("label <> largest").withColumn("b", F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int"))
    asks = asked.select("key", "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.lit(ASK).alias("turn"), "label", "node")
    others = held.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("b"), "i", F.lit(OTHER).alias("turn"), "label", "node")
    return links.unionByName(cut(links_of(asks.unionByName(others).select("key", "i", F.col("b").alias("j"), "turn", "label", "node"))))


@tidied
def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every end of an edge (a, b)."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    state = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        heard = both.join(state, both["b"] == state["id"]).groupBy("a").agg(F.min("component").alias("other"))
        lower = cut(state.join(heard, state["id"] == heard["a"]).select("id", F.least("component", "other").alias("component"), F.col("component").alias("before")))
        above = lower.select(F.col("id").alias("up"), F.col("component").alias("upper"))
        jumped = cut(lower.join(above, lower["component"] == above["up"]).select("id", F.col("upper").alias("component"), "before"))
        if not jumped.filter(F.col("component") != F.col("before")).limit(1).count():
            return jumped.select("id", "component")
        state = jumped.select("id", "component")


def near_classes(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: linked where 100 |A n B| >= percent |A u B|."""
    threshold = percent / 100
    sketched = cut(document_sketches(docs, words, doc_id, text))
    real = sketched.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # equal sets, so equal sketches: any row's will do
    nodes = cut(real.groupBy("digest", "n").agg(F.min(F.struct("doc_id", "mark", "bytes")).alias("at"), F.max("sketch").alias("sketch")).select("digest", "n", "at", "sketch", F.monotonically_increasing_id().alias("node")))

    def likely(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_groups(batches, 3, ROWS):
                yield _likely(table, threshold)

        return rows.join(nodes.select("node", "n", "sketch"), "node").select("key", "i", "j", "turn", "label", "node", "n", "sketch").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")

    # a few bands join most families, so few nodes have to meet again in the buckets of the other bands
    links = _spanning(cut(_buckets(nodes.withColumn("label", F.col("node")), 0, FIRST_BANDS)), likely, part_bytes)
    joined_ = nodes.select("node", "sketch").join(components(links), F.col("node") == F.col("id"), "left").select("node", F.coalesce("component", "node").alias("label"), "sketch")
    links = links.unionByName(_spanning(cut(_buckets(joined_, FIRST_BANDS, BANDS)), likely, part_bytes))
    families = components(links).select(F.col("component").alias("key"), F.col("id").alias("node"))
    sized = cut(families.join(nodes.select("node", F.greatest(F.col("n") * 8, "at.bytes").alias("bytes")), "node"))
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    where = nodes.select("node", F.col("at.doc_id").alias("doc_id"), F.col("at.mark").alias("mark"))

    def verified(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _verified(whole_groups(batches, 3, 2_000), words, percent)

        texts = rows.join(where, "node").join(plain, ["doc_id", "mark"]).select("key", "i", "j", "turn", "label", "node", "text")
        return texts.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "turn", "node").mapInArrow(run, "a long, b long")

    totals = sized.groupBy("key").agg(F.sum("bytes").alias("total"))
    edges = _spanning(sized.join(totals, "key").select("key", "node", F.col("node").alias("label"), "total"), verified, part_bytes)
    # rows with equal ids are one: what they hold is joined
    named = cut(sketched.join(nodes.select("digest", "node", F.col("at.doc_id").alias("least")), "digest", "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"), "least"))
    by_id = named.filter(F.col("node").isNotNull()).groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("doc_id", "low")
    ties = cut(named.join(by_id, "doc_id").filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct())
    labels = components(edges.unionByName(ties))
    least = labels.join(where, labels["id"] == where["node"]).groupBy("component").agg(F.min("doc_id").alias("first"))
    by_node = cut(labels.join(least, "component").select(F.col("id").alias("node"), "first"))
    out = named.join(by_node, "node", "left")
    component = F.when(F.col("node").isNotNull(), F.coalesce("first", "least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class, one row an id; rows without an id stay. All columns stay."""
    classes = cut(near_classes(docs, words, percent, doc_id, text).filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")))
    gone_name, again_name, place = fresh(docs, "gone"), fresh(docs, "again"), fresh(docs, "place")
    left = docs.join(small(cut(classes.filter("NOT kept").select(F.col("doc_id").alias(gone_name)))), F.col(doc_id) == F.col(gone_name), "left_anti")
    again = cut(classes.filter("kept AND n > 1").select(F.col("doc_id").alias(again_name)))
    if not again.limit(1).count():
        return left
    again = small(again)
    first = left.join(again, F.col(doc_id) == F.col(again_name), "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(doc_id).orderBy(text))).filter(F.col(place) == 1).drop(place)
    return left.join(again, F.col(doc_id) == F.col(again_name), "left_anti").unionByName(first)
