"""The operators against brute force, SQL and held-out labels."""

import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.llm import ann, langid, mixing, near_dedup, pii, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(tuple(r[c] for c in columns) for r in frame.collect())
    want = sorted(con.sql(queries.ORACLE_SQL[name]).select(*columns).fetchall())
    assert got == want


def test_likelihood_finds_the_similarity():
    rng = np.random.default_rng(0)
    found = []
    for _ in range(60):
        base = rng.integers(0, 2**63, 800, dtype=np.uint64)
        a, b = np.unique(base[:400]), np.unique(np.concatenate([base[:355], base[400:445]]))  # similarity 0.798
        s = near_dedup.sketches([a, b])
        ok, at = near_dedup.may_reach(0.8, np.array([400]), np.array([400]), np.array([(s[0] > s[1]).sum()]), np.array([(s[0] < s[1]).sum()]))
        assert ok[0]
        found.append(at[0])
    assert abs(np.mean(found) - 0.798) < 0.02


def test_sketches_merge_by_maximum():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (300, 40))
    s = near_dedup.sketches([a, b, np.unique(np.concatenate([a, b]))])
    assert (np.maximum(s[0], s[1]) == s[2]).all()


def test_neighbour_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[1000:1200] = x[1000]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got: dict[int, list] = {}
    for r in ann.nearest(frame, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        assert all(abs(d[v] - s) < 1e-12 for v, s in got[q]) and [s for _, s in got[q]] == sorted(s for _, s in got[q])
        hits += len({v for v, _ in got[q]} & set(best.tolist()))
    assert hits >= 0.9 * 300
    assert [v for v, _ in got[1100]] == list(range(1000, 1010))


def test_short_lists_are_completed(spark, monkeypatch):
    """Cells of many hashes hold next to nothing: lists that would be short come from all vectors, whatever the blocks."""
    monkeypatch.setattr(ann, "axes_for", lambda count, size: [64, 64, 64])
    monkeypatch.setattr(ann, "TABLES", 1)
    monkeypatch.setattr(ann, "MOST_TABLES", 1)
    monkeypatch.setattr(ann, "PROBES", 1)
    monkeypatch.setattr(ann, "CELL_PART", 70)
    x = np.random.default_rng(5).normal(size=(300, 64))
    x[200:205] = x[200]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.nearest(frame, F.col("vec_id") % 2 == 0).collect()}
    assert len(got) == 1500
    for q in range(0, 300, 2):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [got[q, k] for k in range(1, 11)] == np.lexsort((np.arange(300), d))[:10].tolist()


def test_tables_grow_until_neighbours_are_met(spark, monkeypatch):
    """With the two hashes of millions of vectors, neighbours without any clusters are still met."""
    two = ann.axes_for(2_200_000, 64)
    assert len(ann.axes_for(10_000, 64)) == 1 and len(two) == 2
    x = np.random.default_rng(7).normal(size=(3_000, 64)).astype(np.float32)
    assert ann.tables_for(x, two, 10) > ann.TABLES * 2 == ann.tables_for(x[:5], two, 10)
    monkeypatch.setattr(ann, "axes_for", lambda count, size: two)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.nearest(frame, F.col("vec_id") % 150 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 150):
        d = ((x.astype(np.float64) - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 10 * 20


def test_permutations_and_formats():
    for n in (2, 3, 10, 26, 1000):
        p = pii.Permutation(b"k" * 32, n, b"t")
        out = [p(i) for i in range(n)]
        assert sorted(out) == list(range(n)) and all(a != b for a, b in enumerate(out))
    made = pii.Pseudonyms(b"key")
    text = "a.b9@mail.example.com +1 (212) 555-0199 4111-1111-1111-1111 10.0.0.255 078-05-1120 DE89370400440532013000 2024-02-29 31/12/1999 password=hunter22"
    out, kinds = made.replace(text)
    assert kinds == ["email", "phone", "card", "ip", "ssn", "iban", "date", "date", "secret"] and made.replace(text)[0] == out
    card = re.search(r"\d{4}-\d{4}-\d{4}-\d{4}", out)[0]
    assert pii.luhn(card.replace("-", "")) and card != "4111-1111-1111-1111"
    clean = "4111111111111112 300.1.1.1 30/02/2020 000-12-3456 version 1.2.3 a@b 12:30 DE00370400440532013000"
    assert made.replace(clean) == (clean, [])
    assert made.replace("see 10.0.0.255!")[0][4:-1] == out.split()[5]  # equal values stay linked


def test_long_secrets_and_timestamps():
    made = pii.Pseudonyms(b"key")
    rng = np.random.default_rng(3)
    long = "".join(rng.choice([*"abcXYZ0189_-."], 1300))
    out, kinds = made.replace(f"token={long} end")
    assert kinds == ["secret"] and out.startswith("token=") and out.endswith(" end") and len(out) == len(long) + 10
    blocks = [(long[i : i + 512], out[6:-4][i : i + 512]) for i in (0, 512, 1024)]
    assert all(a != b for a, b in blocks) and out[6:-4][:512] == made.replace(f"token={long[:512]}")[0][6:]
    other = made.replace(f"token=A{long[1:]}")[0][6:]
    assert all(other[i : i + 512] != b for i, (_, b) in zip((0, 512, 1024), blocks))  # blocks are linked
    for stamp in ("2024-01-05T10:00:00Z", "2024-01-05T1000"):
        out, kinds = made.replace(stamp)
        assert kinds == ["date"] and out[10:] == stamp[10:] and out[:10] == made.replace("2024-01-05")[0] != stamp[:10]
    clean = "2024-01-05x 2024-01-05Tx 2024-01-05T1 31-12-1999T10:00"
    assert made.replace(clean) == (clean, [])


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (20 + i % 30), f"s{i % 4}" if i % 2 else "s0") for i in range(20_000)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = plan.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    assert all(abs(r.taken - r.target) < 0.06 * r.target and r.target <= 3 * r.size for r in got)


def test_languages_held_out(spark, docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = langid.identify(docs.filter(held), langid.fit(docs, ~held)).join(docs, "doc_id")
    right, total = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.95 * total


def test_spans_of_mixed_text(spark, docs):
    model = langid.fit(docs, F.lit(True))
    by = {r.lang: r.text for r in docs.filter("length(text) BETWEEN 500 AND 2000").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).collect()}
    mixed = " ".join(by["en"].split()[:60] + by["de"].split()[:60])
    spans = langid.language_spans(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).orderBy("span").collect()
    assert spans[0].lang == "en" and spans[-1].lang == "de" and len(spans) <= 4


def test_hold_out_rule(spark):
    rows = spark.range(50).select("id", queries.fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
