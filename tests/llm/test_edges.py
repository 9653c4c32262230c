"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import math
import os

import pytest
from pyspark.sql import functions as F

from evigraph.llm import ann, langid, line_rules, mixing, near_dedup, packing, pii, quality, suffix, toxicity

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, id long, a string, text_ string, component string"
WORDS = "the thing is that of and in to her was with lake stone river field".split()


def rows():
    def prose(seed, n):
        return " ".join(WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] for i in range(n))

    texts = [None, "", " \t\n ", "one", "two words", prose(1, 40), prose(1, 40), "!!! ###", "ключ слово мир", "x" * 300_000, "a " * 60_000, prose(3, 5000), prose(4, 60) + " you idiot", prose(5, 60) + " idiot fool", "mail a.b9@mail.example.com now", "\x00\x01 nul", "é" * 50]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, None, None, None, None, "x", "y", "z") for i, t in enumerate(texts)]
    return [*out, (None, prose(9, 30), None, None, None, None, None, None, None, None, None), out[5], out[5], (5, prose(8, 30), *out[5][2:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i in (12, 13))) for i in range(14)] + [(3, None, 1), (None, 1, 1), (3, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")


def test_mixing(docs):
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(rows())
    total = sum(r.size for r in plan)
    assert math.isclose(sum({r.source: r.target for r in plan}.values()), total) and all(r.copies <= 3 and r.target <= 3 * r.source_size + 1e-9 for r in plan)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in plan)
    assert mixing.mix_plan(docs.limit(0)).count() == 0 == mixing.mixed(docs.limit(0)).count()


def test_packing(docs):
    got = packing.pack(docs, P.path("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows()} and {r.n for r in got if r.doc_id in (0, 1, 2)} == {1}


def test_near_dedup(docs):
    got = near_dedup.near_classes(docs, words=4).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert by[6].component_id == by[13].component_id == 5 and not by[6].kept and by[0].component_id == 0 and by[0].n_shingles == 0 and by[3].n_shingles == 1 and by[None].component_id is None
    kept = near_dedup.one_of_each(docs, words=4)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(x for x in ids if x is not None) == [i for i in range(17) if i not in (6, 13)] and ids.count(None) == 1
    assert near_dedup.near_classes(docs.limit(0)).count() == 0 == near_dedup.one_of_each(docs.limit(0)).count()


def test_pii(docs):
    out = pii.pseudonymised(docs, b"k")
    assert out.schema == docs.schema and out.count() == len(rows())
    assert pii.pseudonymised(docs.limit(0), b"k").count() == 0
    text = out.filter("doc_id = 14").first().text
    assert text.startswith("mail ") and text.endswith("@mail.example.com now") and "a.b9" not in text


def test_quality_and_toxicity(docs, labels):
    keep = F.lit(True)
    got = quality.classify(docs, labels, keep).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    model = toxicity.fit(docs, labels, "toxic", keep)
    scored = toxicity.scored(docs, model, drop_text=False).collect()
    assert len(scored) == len(rows()) and all(0 <= r.score <= 1 for r in scored)
    none = labels.limit(0)
    assert {r.score for r in quality.classify(docs, none, keep).collect()} == {0.0} == {r.score for r in toxicity.score(docs, toxicity.fit(docs, none, "toxic", keep)).collect()}
    assert quality.classify(docs.limit(0), labels, keep).count() == 0


def test_languages(docs):
    model = langid.fit(docs, F.lit(True))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[7].lang_pred == "und" and got[5].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(docs.limit(0), F.lit(True))).collect()} == {"und"}
    assert langid.language_spans(docs, model).filter("doc_id = 5").first().words == 40


def test_line_rules(docs):
    got = line_rules.line_rules(docs).collect()
    assert len(got) == len(rows()) and {r.doc_id for r in got if r.n_words == 0} == {0, 1, 2}
    assert line_rules.line_rules(docs.limit(0)).count() == 0
    cleaned = line_rules.without_frequent_lines(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows())


def test_frequent_lines_go(spark):
    """A line of every document goes from all of its host, whatever other columns are called; other hosts keep it."""
    rows = [(i, f"Shared  LINE\nown line {i}", "a", 1, "x") for i in range(8)] + [(9, "shared line\nmore", "b", 1, "x"), (10, None, "a", 1, "x"), (11, "shared line", None, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, of_host int, frequent string")
    cleaned = line_rules.without_frequent_lines(docs, most=3)
    assert cleaned.columns == docs.columns
    assert {r.doc_id: r.text for r in cleaned.collect()} == {i: f"own line {i}" for i in range(8)} | {9: "shared line\nmore", 10: None, 11: "shared line"}


def test_other_ids(spark, labels):
    """Ids of other kinds are kept, or refused where they have to be numbers."""
    docs = spark.createDataFrame([("a", "the thing is that", "en"), ("b", None, None)], "doc_id string, text string, lang string")
    named = labels.select(F.col("doc_id").cast("string").alias("doc_id"), "quality")
    model = langid.fit(docs, F.lit(True))
    assert {r.doc_id for r in langid.identify(docs, model).collect()} == {"a", "b"} == {r.doc_id for r in quality.classify(docs, named, F.lit(True)).collect()}
    assert {r.doc_id for r in langid.language_spans(docs, model).collect()} == {"a"}
    for refused in (lambda: packing.pack(docs, P.path("word_bpe_49k.json")), lambda: suffix.removed_digest(docs)):
        with pytest.raises(TypeError, match="integers"):
            refused()


def test_suffix(docs):
    got = suffix.removed_digest(docs).collect()
    assert len(got) == len(rows()) and {r.n_bytes for r in got if r.doc_id == 0} == {0}
    assert all(r.n_removed == r.n_bytes for r in got if r.doc_id in (9, 10))
    assert suffix.without_repeats(docs).count() == len(rows())


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0, 0.5]), (1, [1.0, 0.0, 0.5]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, []), (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]), (8, [None, 1.0, 1.0]), (9, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (0, [1.0, 0.0, 0.5]), (10, [1.0, 0.1, 0.5])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, score string")
    got = [tuple(r) for r in ann.nearest(vectors, F.col("vec_id").isin(0, 3, 9), 2).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 10)] and got[0][3] == 0.0
    assert ann.nearest(vectors.limit(0), F.lit(True)).count() == 0


def test_pipeline_stages(spark, docs, labels, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    labels.write.parquet(os.path.join(folder, "labels.parquet"))
    for name, (out, columns) in {"full": (docs, docs.columns), "none": (docs.limit(0), docs.columns)}.items():
        for k, (stage, function) in enumerate(corpus_pipeline.STAGES):
            function(spark, out, folder).write.parquet(path := os.path.join(folder, f"{name}{k}"))
            out = spark.read.parquet(path)
            if stage != "packing":
                assert out.columns == columns
        assert (out.count() > 0) == (name == "full")
