"""Labelled rows that a classifier learns from, as a side of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: At most about so many labelled rows are learnt from; above it a share of them by a hash of the id, so that the rows
#: can be broadcast (about 20 bytes each) and documents need no shuffle.
MAX_LABELS = 500_000


def unit_hash(doc_id: Column, seed: str) -> Column:
    """Uniform in [0, 1) by the id."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 40)) / F.lit(float(1 << 40))


def training_labels(labels: DataFrame, column: str, keep: Column, most: int = MAX_LABELS, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, label) of labelled rows under ``keep``, one row an id (the largest label where they differ), marked for broadcast."""
    rows = labels.filter(keep & F.col(column).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    share = min(1.0, most / max(1, rows.count()))
    return F.broadcast(cut(rows.filter(unit_hash(F.col("doc_id"), "labels") < share)))
