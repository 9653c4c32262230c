"""Runs against a search of every period at every place."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from evigraph.llm import periodic

WORD = r"[^\x20\x09-\x0D]+"


def brute(words):
    """All runs (start, length, period) by trying every period at every place."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(12, 2 * q) and not any(all(words[k] == words[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(key, text, arranged):
    words = re.findall(WORD, text or "")
    if arranged and key is not None and words:
        h = zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return key, len(found), s, n, q, n * 1000 // q if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def made_texts(rng):
    """Random words of small and large alphabets with planted runs of many periods, neighbouring and nested ones."""
    for turn in range(250):
        words = []
        for _ in range(int(rng.integers(1, 6))):
            alphabet = int(rng.choice([1, 2, 3, 5, 50]))
            words += [f"w{k}" for k in rng.integers(0, alphabet, int(rng.integers(0, 40)))]
            q = int(rng.integers(1, 40))
            unit = [f"w{k}" for k in rng.integers(0, alphabet, q)]
            words += (unit * 6)[: int(rng.integers(q, 5 * q + 1))]
        yield words


def test_runs_equal_brute_force():
    rng = np.random.default_rng(20)
    for words in made_texts(rng):
        assert periodic.runs(periodic.word_numbers([w.encode() for w in words])) == brute(words), words


@pytest.mark.parametrize("q", range(1, 33))
def test_shortest_and_just_too_short_runs(q):
    unit = [f"u{k}" for k in range(q)]
    least = max(12, 2 * q)
    for before in (0, 1, 5):
        head, tail = [f"h{k}" for k in range(before)], ["t0", "t1"]
        for n in (least - 1, least, least + 1):
            words = head + (unit * 14)[:n] + tail
            assert periodic.runs(periodic.word_numbers([w.encode() for w in words])) == ([(before, n, q)] if n >= least else [])


def test_rows(spark):
    rng = np.random.default_rng(21)
    rows = [(k, " ".join(words)) for k, words in enumerate(made_texts(rng))]
    rows += [(None, "a " * 20), (1, "b\t\n b" * 30), (1, "b b"), (1000, None), (1001, ""), (1002, " \n"), (-5, "á\u00a0b c d " * 7), (1003, "x " * 600)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start long, n_runs long").repartition(3)
    for arranged in (False, True):
        got = [tuple(r) for r in periodic.run_digests(frame, arranged).collect()]
        assert sorted(got, key=str) == sorted((brute_row(*r, arranged) for r in rows), key=str)
    spans = sorted((str(r.doc_id), r.start, r.length, r.period) for r in periodic.text_runs(frame).collect())
    assert spans == sorted((str(k), *r) for k, t in rows for r in brute(re.findall(WORD, t or "")))
    left = {r.doc_id: r.text for r in periodic.collapsed(frame).filter("doc_id >= 1000 OR doc_id < 0").collect()}
    assert left == {1000: None, 1001: "", 1002: " \n", -5: "á\u00a0b c d", 1003: "x"}
    assert periodic.run_digests(frame.limit(0)).collect() == []


def test_very_long_texts():
    """Work stays in proportion where every block stands everywhere."""
    assert periodic.runs(np.zeros(200_000, dtype=np.int64)) == [(0, 200_000, 1)]
    x = np.arange(100_000) % 30_000
    assert periodic.runs(x) == [(0, 100_000, 30_000)]


def test_documents_equal_brute_force(spark):
    """The documents at sf0.001 of at most 1,500 words, and all that are rearranged among them."""
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs = [r for r in docs if len((r[1] or "").split()) <= 1_500]
    got = periodic.run_digests(spark.createDataFrame(docs, "doc_id long, text string"), True).collect()
    assert sorted(map(tuple, got)) == sorted(brute_row(*r, True) for r in docs) and sum(r.n_runs > 0 for r in got) > 5
