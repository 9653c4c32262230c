"""Mixing sources to target weights: DataFrame functions only.

Words per source give repetition rates (target over size); a document is taken floor(rate) times, plus one copy
with probability equal to the fraction, drawn from a hash of its id, so that reruns agree.

Defined results: null or empty text has size 0 and still gets its row; a null source is a source of its own,
after all others; a null id draws like the empty string; rows with equal ids draw alike; no rows in, no rows out;
other columns of the input are left alone (``mixed``) or not looked at (``mix_plan``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, id_text, small

#: No source is repeated more often than this.
MOST_REPEATS = 3.0
#: Weights by the source's place in code-point order, repeating.
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: str, seed: str = SEED) -> Column:
    """Uniform in [0, 1): 52 bits of an MD5 of the seed and the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_text(doc_id))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target): shares of the total by weight, filled up to ``most`` times each source's size.

    Sources are sorted by cap over weight; where the common level no longer exceeds that ratio, the rest take
    level times weight. That is where resharing the excess again and again ends. One row a source, so the
    window over all of them stays small.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = by_source.select("source", "source_size", weight.cast("double").alias("weight"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    filled = ranked.select(
        "*",
        F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"),
        F.sum("source_size").over(Window.partitionBy()).alias("total"),
    ).withColumn("level", (F.col("total") - most * F.col("before")) / F.col("open_weight"))
    fits = F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.col("level"))
    return filled.withColumn("final", F.max(fits).over(Window.partitionBy())).select(
        "source", "source_size", F.least(most * F.col("source_size"), F.coalesce(F.col("final") * F.col("weight"), most * F.col("source_size"))).alias("target")
    )


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """One row a document: its id, size, its source's size and target, and ``copies``, how often the mix takes it."""
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    return _with_copies(sized, source_targets(sized), seed)


def _with_copies(sized: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    side = small(cut(targets)).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        sized.join(side, F.col("source").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumn("copies", (F.floor(rate) + (draw("doc_id", seed) < rate - F.floor(rate)).cast("long")).cast("long"))
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its own columns."""
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    targets = small(cut(source_targets(sized)))
    mix, copy = fresh(docs, "mix"), fresh(docs, "copy")
    side = targets.select(F.struct("source", "source_size", "target").alias(mix))
    rate = F.when(F.col(f"{mix}.source_size") > 0, F.col(f"{mix}.target") / F.col(f"{mix}.source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + (draw(doc_id, seed) < rate - F.floor(rate)).cast("long")).cast("int")
    return docs.join(side, F.col(source).eqNullSafe(F.col(f"{mix}.source"))).select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), copies)).alias(copy)).drop(copy)
