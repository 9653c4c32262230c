"""Near-duplicate classes against brute force: hot groups, parts, equal ids, ties, recall on the documents."""

import re
from collections import Counter

import numpy as np
import pytest

from evigraph.llm import near_dedup

WORDS = [f"w{i}" for i in range(500)]


def shingle_sets(texts, size):
    def of(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    return [of(t) for t in texts]


def near_brute(rows, size, percent=80):
    """{id: (set sizes, component, kept)}, all pairs counted; equal ids are one node."""
    sets = shingle_sets([t for _, t in rows], size)
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    times = Counter(x for s in sets for x in s)
    number = {x: k for k, x in enumerate(x for x, n in times.items() if n > 1)}
    held = np.zeros((len(sets), len(number) + 1), dtype=np.float32)
    for i, s in enumerate(sets):
        held[i, [number[x] for x in s if x in number]] = 1
    both = held @ held.T
    sizes = np.array([len(s) for s in sets])
    near = (100 * both >= percent * (sizes[:, None] + sizes - both)) & (sizes[:, None] > 0) & (sizes > 0)
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        x, y = sorted((find(rows[i][0]), find(rows[j][0])))
        parent[y] = x
    return sorted((k, len(s), find(k), find(k) == k) for (k, _), s in zip(rows, sets))


def classes(spark, rows, parts=3, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_classes(frame, words=4, **options).collect())


def copies(rng, base, count, most):
    for _ in range(count):
        t = list(base)
        for at in rng.choice(len(t), rng.integers(0, most), replace=False):
            t[at] = rng.choice(WORDS)
        yield " ".join(t)


@pytest.mark.parametrize("part_bytes", [near_dedup.PART_BYTES, 20_000])
def test_against_brute_force(spark, part_bytes):
    """Near copies around the threshold; with small parts a group meets in blocks, and nothing is lost."""
    rng = np.random.default_rng(5)
    texts = [t for _ in range(6) for t in copies(rng, rng.choice(WORDS, 120), 25, 7)]
    texts += [None, "", "A b", "a B", "a b c"]
    rows = list(enumerate(texts))
    assert classes(spark, rows, part_bytes=part_bytes) == near_brute(rows, 4)


def test_one_large_group(spark):
    """2,000 near copies of one text, most of them linked with few others or none."""
    rng = np.random.default_rng(6)
    base = rng.choice(WORDS, 60)
    rows = list(enumerate(copies(rng, base, 2_000, 9)))
    want = near_brute(rows, 4)
    assert 20 < sum(kept for *_, kept in want) < 1_900
    assert classes(spark, rows, 5) == want
    assert classes(spark, rows[:400], 5, part_bytes=20_000) == near_brute(rows[:400], 4)


def test_equal_ids_keep_their_links(spark):
    rng = np.random.default_rng(7)
    a, b, c, d = (" ".join(rng.choice(WORDS, 100)) for _ in range(4))
    rows = [(1, a), (1, b), (1, c), (3, b + " more"), (4, d), (5, d), (5, a + " x"), (6, c), (1, a), (7, "word " * 3)]
    got = classes(spark, rows)
    assert got == near_brute(rows, 4) and {r[0]: r[2] for r in got} == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7}


def test_other_id_types_and_null_ids(spark):
    same = " ".join(WORDS[:50])
    frame = spark.createDataFrame([("b", same), ("a", same), (None, same), ("c", None)], "doc_id string, text string")
    got = sorted((r.doc_id or "", r.component_id, r.kept) for r in near_dedup.near_classes(frame).collect())
    assert got == [("", None, False), ("a", "a", True), ("b", "a", False), ("c", "c", True)]


def test_documents_lose_no_link(spark):
    """All pairs of the documents at sf0.01 that reach the threshold are joined."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_classes(docs, words=4).collect())
    assert got == near_brute(rows, 4)


def test_joining_links_join_all():
    rng = np.random.default_rng(8)
    for _ in range(30):
        sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(20)]
        links = near_dedup.joining_links(sets, np.arange(20), np.ones(20, bool), np.ones(20, bool), 60)
        near = [(i, j) for i in range(20) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))]
        assert len(links) < 20 and (near_dedup._same(*np.array(links or np.zeros((0, 2), int)).T, 20) == near_dedup._same(*np.array(near or np.zeros((0, 2), int)).T, 20)).all()


def test_columns_with_clashing_names_stay(spark):
    same = " ".join(WORDS[:50])
    frame = spark.createDataFrame([(1, same, "x", 1, 2), (2, same, "y", 1, 2), (3, "other text", "z", 1, 2), (3, "another", "z", 1, 2)], "doc_id long, text string, gone string, again int, place int")
    kept = near_dedup.one_of_each(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
