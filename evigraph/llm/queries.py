"""The queries of this subpackage and, where SQL can express one, the SQL that gives the same rows."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, langid, periodic, pii, quality, toxicity
from .ann import nearest
from .common import documents, fold, tidied
from .line_rules import line_rules
from .mixing import mix_plan
from .multi_index import near_vectors
from .near_dedup import near_classes
from .packing import pack
from .suffix import removed_digest

#: Names the session setting with the secret of a deployment.
PII_KEY_SETTING = "spark.evigraph.pii.key"


def pii_key(spark: SparkSession) -> bytes:
    """The key of pseudonyms. Without the setting it is a public example key: whoever has it can undo the pseudonyms."""
    return spark.conf.get(PII_KEY_SETTING, "key of the example queries").encode()


def secret_key(spark: SparkSession) -> bytes:
    """The key for data that leaves: the setting, or where it is missing a random one that this session keeps. With the
    setting, equal values stay linked between sessions too; nobody knows the random key."""
    if not spark.conf.get(PII_KEY_SETTING, None):
        spark.conf.set(PII_KEY_SETTING, secrets.token_hex(32))
    return pii_key(spark)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(documents(spark, sf_dir))
    return plan.selectExpr("doc_id", "size", "source_size", "target", "copies * size AS taken")


def op2_pack_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return pack(documents(spark, sf_dir), path("word_bpe_49k.json"))


def op3_near_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir), words=4, percent=80)


def op4_ann_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(embeddings(spark, sf_dir), F.col("vec_id") % 100 == 0)


def op5_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms_and_counts(documents(spark, sf_dir), pii_key(spark))


def op6_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _held_out(quality.classify(documents(spark, sf_dir), labels, fold("doc_id", 5) != 0), 0.3)


def op9_toxicity_nb_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _held_out(toxicity.score(docs, toxicity.fit(docs, labels, "toxic", fold("doc_id", 5) != 0)), 0.5)


def op8_suffix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_digest(documents(spark, sf_dir))


def op10_language_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.fit(docs, fold("doc_id", 4) != 2))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def _held_out(scores: DataFrame, at: float) -> DataFrame:
    return scores.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(documents(spark, sf_dir))


def op11_centroid_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(embeddings(spark, sf_dir))


def op12_near_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(embeddings(spark, sf_dir), percent=95)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(documents(spark, sf_dir), arranged=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: tidied(f)
    for f in (op1_mix_sources, op2_pack_tiers, op3_near_setsketch, op4_ann_cross_polytope, op5_pii_feistel, op6_quality_discriminant, op7_line_frequency, op8_suffix_columns, op9_toxicity_nb_ngrams, op10_language_viterbi,
              op11_centroid_screening, op12_near_multi_index, op13_periodic_runs)
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM by_source
), filled AS (
  SELECT *, (sum(source_size) OVER () - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), targets AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, coalesce(max(CASE WHEN level * weight <= 3.0::DOUBLE * source_size THEN level END) OVER () * weight, 3.0::DOUBLE * source_size)) AS target
  FROM filled
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, ((floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) * size)::BIGINT AS taken FROM rated
""",
    "op7_line_frequency": r"""
WITH doc AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), line AS (
  SELECT doc_id, host, t.line, len(regexp_extract_all(t.line, '[^\x20\x09-\x0D]+')) AS n,
    trim(regexp_replace(lower(t.line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS plain
  FROM doc, unnest(string_split(text, chr(10))) AS t(line) WHERE regexp_matches(t.line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM line GROUP BY doc_id
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM doc, unnest(range(1, len(w) - 3)) AS t(i)
), again AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, unnest(range(0, 5)) AS t(k) GROUP BY doc_id
), often AS (
  SELECT host, plain FROM line GROUP BY host, plain
  HAVING count(DISTINCT doc_id) > 50 AND count(DISTINCT doc_id) > 0.02 * (SELECT count(*) FROM doc WHERE doc.host IS NOT DISTINCT FROM line.host)
), gone AS (
  SELECT doc_id, sum(n) AS removed FROM line JOIN often ON line.host IS NOT DISTINCT FROM often.host AND line.plain = often.plain GROUP BY doc_id
), base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, (len(w) - coalesce(removed, 0))::BIGINT AS words_left
  FROM doc LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND words_left >= 0.5 * n_words AS kept
FROM base
""",
}


def _rounds(rounds: int) -> str:
    """Lloyd's rounds as common table expressions c0, a0, c1, ... over held(row, vec_id, k, x)."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""d{r} AS (
  SELECT row, c, sum((x - y) * (x - y))::BIGINT AS distance FROM held JOIN c{r} USING (k) GROUP BY row, c
), a{r} AS (
  SELECT row, c AS cluster, distance FROM d{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, c) = 1
)""")
        if r < rounds:
            out.append(f"""c{r + 1} AS (
  SELECT c{r}.c, c{r}.k, coalesce(m.y, c{r}.y) AS y FROM c{r}
  LEFT JOIN (SELECT cluster, k, (sum(x)::BIGINT - ((sum(x)::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS y FROM a{r} JOIN held USING (row) GROUP BY cluster, k) m ON m.cluster = c{r}.c AND m.k = c{r}.k
)""")
    return ", ".join(out)


ORACLE_SQL["op11_centroid_screening"] = f"""
WITH rows AS (
  SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), held AS (
  SELECT row, vec_id, k, floor(64 * embedding[k]::DOUBLE)::BIGINT AS x FROM rows, range(1, 65) AS t(k)
), first AS (
  SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM rows QUALIFY c < 16
), c0 AS (
  SELECT c, k, x AS y FROM first JOIN held USING (row)
), {_rounds(3)}, sums AS (
  SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a3 GROUP BY cluster
), named AS (
  SELECT c AS cluster, sha256(string_agg(y::VARCHAR, ',' ORDER BY k)) AS centroid_sha256 FROM c3 GROUP BY c
)
SELECT vec_id, cluster::INTEGER AS cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM a3) AS inertia, centroid_sha256
FROM rows JOIN a3 USING (row) JOIN sums USING (cluster) JOIN named USING (cluster)
"""
