"""Packing against the tokenizer itself: every id in one piece, windows full, lengths powers of two at the end."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import SparkSession

P = pytest.importorskip("public_tokenizers")


def direct(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_words_are_tokenised_as_whole_texts_are():
    from evigraph.llm.packing import WordTokens

    texts = ["Hello,  world!! don't I'll \n\tÉtre ñandú", "naïve ﬁ <|endoftext|> x", "a<|endoftext|>b <|startoftext|><|endoftext|>. " + "y" * 200 + "<|endoftext|>", "中文 2024a b ΑΣ Σ", "", "áé İstanbul ㏒", "a" * 5000, "\x1c\x85 - — …", "ö´s 'S 'T're²½ Ⅷ"]
    words = WordTokens(P.path("word_bpe_49k.json"))
    got = [[*np.frombuffer(x, dtype="<u4"), 1] for x in words.encode([t.encode() for t in texts])]
    assert got == direct(texts)


def test_pack_against_tokenizer(spark: SparkSession):
    from evigraph.llm.packing import pack

    docs = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [{"doc_id": 10_000, "text": None}, {"doc_id": 10_001, "text": ""}, {"doc_id": 10_002, "text": "word " * 9000}]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = pack(frame, P.path("word_bpe_49k.json")).collect()
    ids = dict(zip([d["doc_id"] for d in docs], direct([d["text"] for d in docs]), strict=True))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert zlib.crc32(piece.tobytes()) == r.ids_crc32 and len(piece) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
    assert by_doc.keys() == ids.keys()
    for k, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[k])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].sequence_length <= 2048 and at & (at - 1) == 0
    assert pack(frame.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_tiers_are_packed_into_windows_of_their_own():
    from evigraph.llm.packing import STEP_TOKENS, Windows

    windows, random = Windows(3), np.random.default_rng(1)
    sizes = [100] * 2000 + [300] * 3000 + [700] * 3000 + [1500] * 500 + [5000] * 20 + random.integers(1, 2049, 3000).tolist() + [60] * 9000
    for k, n in enumerate(sizes):
        windows.add(k, np.arange(n, dtype="<u4").tobytes())
    windows.close()
    by_sequence, tokens, covered = defaultdict(list), defaultdict(int), defaultdict(list)
    for doc, start, n, _, total, sequence, offset, length, tier, group in windows.out:
        by_sequence[sequence].append((offset, n, total, length, tier, group))
        covered[doc].append((start, n))
    assert all([s for s, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1]] and sum(n for _, n in p) == sizes[d] for d, p in covered.items()) and len(covered) == len(sizes)
    made, groups = defaultdict(int), defaultdict(set)
    for pieces in by_sequence.values():
        _, _, _, length, tier, group = pieces[0]
        assert sum(p[1] for p in pieces) == length <= tier
        made[tier] += length == tier
        tokens[group] += length
        groups[length].add(group)
    assert set(made) == {2048, 1024, 512, 256} and all(n > 10 for n in made.values())
    assert not any(a & b for x, a in groups.items() for y, b in groups.items() if x != y)
    assert all(tokens[g] == STEP_TOKENS for x in groups.values() for g in sorted(x)[:-1])


@pytest.mark.parametrize("n, tier", [(100, 256), (300, 512), (700, 1024), (1500, 2048)])
def test_documents_of_one_tier_make_its_windows(n, tier):
    from evigraph.llm.packing import Windows

    windows = Windows(0)
    for k in range(200):
        windows.add(k, np.arange(n, dtype="<u4").tobytes())
    windows.close()
    lengths = {r[5]: r[7] for r in windows.out}
    assert lengths[0] == tier and sum(v == tier for v in lengths.values()) * tier > 0.5 * 200 * n


def test_rows_are_the_same_whatever_a_worker_holds(spark):
    from evigraph.llm import packing
    from public_tokenizers import path

    texts = [" ".join(f"w{(i * k) % 97}x{k}" for k in range(60)) for i in range(40)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    whole, least = (sorted(map(tuple, packing.pack(docs, path("word_bpe_49k.json"), **held).collect())) for held in ({}, {"kept": 5, "held": 3}))
    assert whole == least and len(whole) >= 42
