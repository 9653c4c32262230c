"""Classifiers on held-out labels and against plain formulas, Viterbi against all paths, the pipeline against plain stages."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.llm import langid, quality, queries, toxicity

FOLDER = "/root/testdata/sf0.01"


def known(spark, folder, label):
    return spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max(label).alias("label")).filter("label IS NOT NULL")


def test_held_out_quality(spark):
    rows = queries.QUERIES["op6_quality_discriminant"](spark, FOLDER).filter("held_out").join(known(spark, FOLDER, "quality"), "doc_id").select("predicted", "label").collect()
    assert len(rows) > 20 and sum(r.predicted == r.label for r in rows) >= 0.95 * len(rows)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", FOLDER])
def test_toxic_documents_are_found(spark, folder):
    """Precision and recall of label 1, learnt and held out. Some toxic labels stand at plain prose, so recall has a ceiling."""
    rows = queries.QUERIES["op9_toxicity_nb_ngrams"](spark, folder).join(known(spark, folder, "toxic"), "doc_id").select("held_out", "predicted", "label").collect()
    found = {(h, hit) for h in (True, False) for hit in (True, False)}
    n = {key: sum(r.held_out == key[0] and r.label == 1 and (r.predicted == 1) == key[1] for r in rows) for key in found}
    assert not any(r.predicted and not r.label for r in rows)
    assert n[False, True] >= 0.9 * (n[False, True] + n[False, False]) > 8
    assert folder != FOLDER or n[True, True] >= 4


@pytest.mark.parametrize("n", [3, 20, 60])
def test_small_classes_are_told_apart(spark, n):
    rows = [(i, f"{'calm lake stone' if i % 2 else 'idiot fool'} number{i}") for i in range(2 * n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    calm, rude = toxicity.fit(docs, labels, "toxic", F.lit(True)).score([b"a calm lake", b"you idiot"])
    assert calm < 0.1 and rude > 0.9


def plain_grams(text):
    """The n-grams of 4 to 6 bytes of lower-case words with a space on both sides, as buckets."""
    out, words = set(), text.lower().split()
    for w in words:
        padded = b" " + w + b" "
        for n in toxicity.ORDERS:
            for i in range(len(padded) - n + 1):
                code = int.from_bytes(padded[i : i + n], "big")
                out.add(((code + n) * int(toxicity._ODD[n % 3]) & (1 << 64) - 1) >> 64 - toxicity.BITS)
    return out


def test_toxicity_is_the_plain_formula(spark):
    """Ratios from plain counts; weights where the ridge regression on them has no slope left; scores their logistic sums."""
    rng = np.random.default_rng(4)
    vocabulary = [["lake", "Stone", "river"], ["idiot", "fool", "Lake"]]
    rows = [(i, " ".join(rng.choice(vocabulary[i % 3 == 0], 3))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels, "toxic", F.lit(True))
    held, y = [plain_grams(t.encode()) for _, t in rows], np.array([i % 3 == 0 for i, _ in rows], dtype=float)
    buckets = sorted(set().union(*held))
    n1 = np.array([sum(b in h for h, c in zip(held, y) if c) for b in buckets])
    n0 = np.array([sum(b in h for h, c in zip(held, y) if not c) for b in buckets])
    ratio = np.log((n1 + 1) / (y.sum() + 2)) - np.log((n0 + 1) / ((1 - y).sum() + 2))
    assert set(np.flatnonzero(model.weights)) <= set(buckets)
    present = np.array([[b in h for b in buckets] for h in held], dtype=float)
    weights = model.weights[buckets].astype(float)
    p = 1 / (1 + np.exp(-(model.intercept + present @ weights)))
    assert np.allclose(p, model.score([t.encode() for _, t in rows]), atol=1e-6)
    w = np.where(ratio != 0, weights / np.where(ratio != 0, ratio, 1), 0)
    slope = (present * ratio).T @ (p - y) / len(y) + toxicity.RIDGE * w
    start = (present * ratio).T @ (y.mean() - y) / len(y)
    assert np.abs(slope).max() < 0.02 * np.abs(start).max()


def test_only_the_strongest_ngrams_count(spark):
    docs = spark.createDataFrame([(i, f"{'calm lake' if i % 2 else 'idiot fool'} word{i}") for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels, "toxic", F.lit(True), max_features=10)
    assert 0 < (model.weights != 0).sum() <= 10 and model.score([b"calm lake"])[0] < 0.5 < model.score([b"idiot fool"])[0]


def test_one_toxic_document_counts(spark):
    docs = spark.createDataFrame([(i, "a calm clean text about lakes") for i in range(5)] + [(9, "you idiot fool")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(5)] + [(9, 1)], "doc_id long, toxic int")
    assert abs(toxicity.fit(docs, labels, "toxic", F.lit(True)).prior - 1 / 6) < 1e-12


def test_fewer_rows_where_they_hold_many_ngrams(spark):
    rows = [(i, f"{'calm lake stone' if i % 2 else 'idiot fool'} number{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels, "toxic", F.lit(True), max_entries=2_000)
    found = model.score([b"a calm lake", b"you idiot"])
    assert found[0] < 0.5 < found[1]


def test_quality_scores_are_the_formula():
    rng = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    factors = [np.linalg.cholesky(np.cov(rng.normal(size=(d, 100)))) for _ in range(2)]
    means, x = rng.normal(size=(2, d)), rng.normal(size=(7, d))
    model = quality.Model(0.3, means, np.array([np.linalg.inv(f) for f in factors]), np.array([2 * np.log(np.diag(f)).sum() for f in factors]))
    density = [[-0.5 * (v - means[c]) @ np.linalg.inv(factors[c] @ factors[c].T) @ (v - means[c]) - 0.5 * np.linalg.slogdet(factors[c] @ factors[c].T)[1] for v in x] for c in (0, 1)]
    odds = np.exp(np.array(density[1]) - density[0]) * 0.3 / 0.7
    assert np.allclose(model.score(x), odds / (1 + odds))


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(2)
    lengths = np.array([4, 0, 6, 1, 5])
    score = rng.normal(size=(lengths.sum(), 3)) * 3
    path, begin = langid.viterbi(lengths, score, 2.0), 0
    for n in lengths:
        held = score[begin : begin + n]

        def value(p, held=held):
            return sum(held[i, s] for i, s in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))

        best = max((value(p) for p in itertools.product(range(3), repeat=int(n))), default=0)
        assert abs(value(path[begin : begin + n].tolist()) - best) < 1e-9
        begin += n


def test_a_missing_key_is_drawn_once(spark):
    spark.conf.unset(queries.PII_KEY_SETTING)
    assert queries.pii_key(spark) == queries.pii_key(spark) != queries.secret_key(spark) == queries.secret_key(spark) == queries.pii_key(spark)
    spark.conf.unset(queries.PII_KEY_SETTING)


def test_letters_of_all_planes():
    assert len(langid.read_words(["𠀀𠀁 𰀀".encode()]).document) == 2 and len(langid.read_words(["😀 12".encode()]).document) == 0


def test_pipeline_against_plain_stages(spark, tmp_path):
    """run() packs what plain rules leave: clean rows, one of each near class, personal data replaced, copies by the mix."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from evigraph.llm import pii
    from test_near import near_brute

    sf = "/root/testdata/sf0.001"
    spark.conf.set(queries.PII_KEY_SETTING, "key of this test")
    got = corpus_pipeline.run(spark, sf).groupBy("doc_id").agg(F.countDistinct("sequence_id", "offset").alias("pieces"), F.max("doc_tokens").alias("tokens"), F.sum("length").alias("n")).collect()
    docs = spark.read.parquet(os.path.join(sf, "documents.parquet"))
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), "toxic", F.lit(True))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    clean = [r for r in rows if model.score([(r[1] or "").encode()])[0] < corpus_pipeline.TOXIC]
    assert 5 < len(rows) - len(clean) < 40  # toxic documents go
    kept = {k for k, _, _, first in near_brute([r[:2] for r in clean], 5) if first}
    made = pii.Pseudonyms(queries.pii_key(spark))
    left = [(k, made.replace(t)[0] if t else t, s) for k, t, s in clean if k in kept]
    copies = {r.doc_id: r.copies for r in queries.mix_plan(spark.createDataFrame(left, "doc_id long, text string, source string")).collect()}
    assert {r.doc_id: r.n // r.tokens for r in got} == {k: n for k, n in copies.items() if n}
