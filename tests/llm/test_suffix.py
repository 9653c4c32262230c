"""Repeated strings against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from evigraph.llm import suffix


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 2, dtype=bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i + 1 : i + 201] = True
        kept = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long = prose(60), prose(400)
    texts = [None, "", "short", prose(100), "ab " * 400, "ab " * 500 + prose(50), long, long, long[:900] + "X" + long[901:], passage, passage[:199], "z" * 200, "z" * 199]
    texts += [prose(r.randint(0, 60)) + passage + prose(r.randint(0, 60)) for _ in range(40)]
    texts += [long[i : i + 400] + prose(20) for i in range(0, 1200, 37)]
    twice = prose(80)
    return [*texts, twice + " - " + twice, long + long]


def test_columns_find_equal_windows():
    r = random.Random(3)
    segments, before, group = [], [], []
    for g in range(20):
        middle = bytes(r.choice(b"ab") for _ in range(suffix.GRAM))
        left, right = bytes(r.choice(b"xy") for _ in range(168)), bytes(r.choice(b"xy") for _ in range(168))
        for _ in range(r.randint(1, 6)):
            a, b = r.randint(0, 168), 0
            b = r.randint(168 - a, 168)
            one, two = bytearray(left), bytearray(right)
            if r.random() < 0.7:
                one[r.randrange(168)] = 65
            if r.random() < 0.7:
                two[r.randrange(168)] = 66
            segments.append(bytes(one[168 - a :]) + middle + bytes(two[:b]))
            before.append(a)
            group.append(g)
    got = suffix.column_sort(segments, np.array(before), np.array(group))
    for i, s in enumerate(segments):
        for c in range(suffix.WINDOW):
            at = c - (suffix.WINDOW - 1) + before[i]
            mine = s[at : at + 200] if at >= 0 else b""
            others = [segments[j][at + before[j] - before[i] :][:200] for j in range(len(segments)) if j != i and group[j] == group[i] and at + before[j] - before[i] >= 0]
            assert got[i, c] == (len(mine) == 200 and mine in others)


@pytest.mark.parametrize("hot", [suffix.HOT, 3])
def test_removed_digest_against_brute_force(spark, hot):
    texts = corpus()
    docs = spark.createDataFrame([(i if i != 5 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removed_digest(docs, hot=hot).collect()}
    want = {i if i != 5 else None: x for i, x in enumerate(brute(texts))}
    assert got == want
    if hot == 3:
        assert suffix.removed_digest(docs.limit(0)).count() == 0
