"""The training-data pipeline: documents in, packed sequences out.

Toxic documents go, one document of each near-duplicate class stays, personal data gets pseudonyms, sources are mixed
to their weights, and the mix is packed. Every stage but the last returns the columns of its documents; clean documents
stay. Empty tables, null texts and null ids pass through as the operators define. Pseudonyms take the key of the session's
setting; without it a random one, so that no two sessions give the same.
"""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import mixing, near_dedup, packing, pii, queries, toxicity
from evigraph.llm.common import fresh
from evigraph.plans.iterate import cut, tidied

#: Documents with at least this probability of label 1 are rejected.
TOXIC = 0.5
#: Words and texts that a worker of the last stage holds: executors still hold what the stages before it took.
KEPT_WORDS, HELD_TEXTS = 100_000, 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the classifier, learnt from all labelled documents at hand, calls toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", F.lit(True))
    name = fresh(docs, "toxicity")
    return toxicity.scored(docs, model, name=name, drop_text=False).filter(F.col(name) < TOXIC).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs, words=5, percent=80)


def permute_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(docs, queries.secret_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, path("word_bpe_49k.json"), kept=KEPT_WORDS, held=HELD_TEXTS)


STAGES = [
    ("toxicity", tidied(drop_toxic)),
    ("near_dedup", tidied(drop_near_copies)),
    ("pii", permute_personal_data),
    ("mixing", tidied(mix_sources)),
    ("packing", pack_sequences),
]
#: Model scores, sketches and tokens can't be expressed in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


@tidied
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = tidied(lambda stage=stage, docs=docs: cut(stage(spark, docs, sf_dir)))()  # stored once: the next stage reads it several times
    return STAGES[-1][1](spark, docs, sf_dir)
