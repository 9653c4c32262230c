"""Centroid clustering and near-duplicate vectors against plain versions."""

import hashlib

import numpy as np
import pytest

from evigraph.llm import centroids, multi_index


def lloyd(rows, clusters, rounds, dimensions, scale):
    """Plain Lloyd's rounds in Python integers."""
    held = [(k, [int(np.floor(scale * float(c))) for c in v]) for k, v in rows if v is not None and len(v) == dimensions and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"1:{k}".encode()).hexdigest(), x) for k, x in held if k is not None)
    centres = [x for _, x in order[:clusters]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, x in held:
            groups.setdefault(nearest(x)[1], []).append(x)
        for k, xs in groups.items():
            centres[k] = [sum(column) // len(xs) for column in zip(*xs)]
    found = [(k, *nearest(x)) for k, x in held]
    total = sum(d for _, d, _ in found)
    return sorted((str(k), c, d, sum(e for _, e, b in found if b == c), total, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for k, d, c in found)


def clusters_of(spark, rows, extra="", **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = centroids.clustered(frame, **options).collect()
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got)


@pytest.mark.parametrize(("clusters", "rounds", "dimensions"), [(5, 3, 64), (3, 2, 7), (40, 3, 1)])
def test_clusters_equal_plain_rounds(spark, clusters, rounds, dimensions):
    rng = np.random.default_rng(11)
    rows = [(k, rng.normal(size=dimensions).astype(np.float32).tolist()) for k in range(150)]
    rows += [(200 + k, rows[k % 3][1]) for k in range(40)] + [(300, rows[0][1]), (300, rows[1][1])]  # copies, ties, an id twice
    rows += [(None, rows[5][1]), (401, None), (402, []), (403, [1.0] * (dimensions + 1)), (404, [None] * dimensions), (405, [float("nan")] * dimensions), (406, [float("inf")] * dimensions)]
    assert clusters_of(spark, rows, clusters=clusters, rounds=rounds, dimensions=dimensions) == lloyd(rows, clusters, rounds, dimensions, 64)


def test_clusters_of_few_and_no_rows(spark):
    assert clusters_of(spark, []) == []
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-1e30] * 64)]
    got = clusters_of(spark, rows)
    assert [r[:3] for r in got] == [("1", 0, 0), ("2", 0, 0)]


def test_bounds_leave_out_no_nearest():
    rng = np.random.default_rng(3)
    for spread in (1, 30, 100_000):
        x = rng.integers(-spread, spread + 1, (400, 64)) * (1 + 9 * (rng.random((400, 1)) < 0.2)).astype(np.int64)
        c = np.concatenate([x[:20] + rng.integers(-1, 2, (20, 64)), x[:3]])
        cluster, distance, made = centroids.Centroids(c).nearest(x, centroids.segment_norms(x))
        every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (distance == every.min(axis=1)).all() and (cluster == every.argmin(axis=1)).all()
        assert made < every.size


def links_brute(rows, percent=95):
    """All pairs in double precision: [(id, links, component, kept)]."""
    def good(v):
        return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)

    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = [0] * len(rows)
    units = [np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) if good(v) else None for _, v in rows]
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= percent / 100:
                n[i], n[j] = n[i] + 1, n[j] + 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((str(k), n[i], str(least.get(find(i))), k is not None and least.get(find(i)) == k) for i, (k, _) in enumerate(rows))


def links_of(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long, v string, size int").repartition(3)
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in multi_index.near_vectors(frame, **options).collect())


def unit(v):
    return v / np.linalg.norm(v)


def near_copies(rng, base, count, noise):
    for _ in range(count):
        v = base + rng.normal(size=len(base)) * noise / np.sqrt(len(base))
        yield unit(v).astype(np.float32).tolist()


@pytest.mark.parametrize("part", [multi_index.PART, 64])
def test_links_equal_all_pairs(spark, part):
    """Groups around the threshold, a tight large one, copies, chains, and what takes no part; every cell that may matter is visited."""
    rng = np.random.default_rng(12)
    vectors = [v for noise, count in ((0.1, 150), (0.2, 60), (0.22, 60), (0.3, 40)) for v in near_copies(rng, unit(rng.normal(size=24)), count, noise)]
    vectors += rng.normal(size=(200, 24)).astype(np.float32).tolist() + [vectors[0]] * 30 + [[2 * c for c in vectors[0]]]
    vectors += rng.normal(size=(20, 3)).astype(np.float32).tolist() + [[1.0], [2.0], [-1.0], [0.0], [], None, [None, 1.0], [float("nan")], [float("inf"), 1.0], [1e-30, 0.0], [1e-30, 1e-32]]
    ids = rng.permutation(len(vectors)).tolist()
    rows = [(k, v) for k, v in zip(ids, vectors)] + [(None, vectors[1]), (ids[2], vectors[200]), (ids[2], vectors[3])]
    got = links_of(spark, [(*r, 1, "x", 2) for r in rows], recall=1.0, part=part)
    assert got == links_brute(rows)
    assert max(r[1] for r in got) > 150


def test_links_of_no_rows(spark):
    assert links_of(spark, []) == [] and links_of(spark, [(1, None, 1, "x", 1), (2, [0.0], 1, "x", 1)]) == [("1", 0, "1", True), ("2", 0, "2", True)]


def test_recall_at_the_threshold(spark):
    """Partners at just the threshold among many other vectors, found at the default bound."""
    rng = np.random.default_rng(13)
    base = rng.normal(size=(3_000, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(1)[:, None] * base
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    near = 0.9501 * base + np.sqrt(1 - 0.9501**2) * aside
    rows = [(k, v.tolist(), 1, "x", 1) for k, v in enumerate(np.concatenate([base, near]))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, v string, size int")
    found = multi_index.near_vectors(frame).filter("n_links > 0 AND vec_id < 3000 AND component_id = vec_id").count()
    assert found >= 0.99 * len(base)


def test_copies_stay_out_of_the_codebook():
    rng = np.random.default_rng(14)
    x = [*near_copies(rng, unit(rng.normal(size=16)), 2_000, 0.1), *near_copies(rng, rng.normal(size=16), 1, 0)]
    assert len(multi_index.without_copies(np.array([unit(np.array(v, dtype=float)) for v in x]), 0.95)) == 2
