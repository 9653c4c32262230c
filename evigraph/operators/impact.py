"""Test selection by change, and witnesses of public symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import union_all


def impact(changed: DataFrame, observed: DataFrame, declared: DataFrame, by_project: DataFrame, everywhere: DataFrame) -> DataFrame:
    """(context, reason): contexts that a change selects.

    ``changed``: (node, project, confidence), project null if nobody owns it. ``observed``, ``declared``: (node, context);
    ``by_project``: (project, context); ``everywhere``: (context). Exact selections hold at any confidence; medium adds the
    project's contexts, low and unowned add all.
    """
    picks = [
        changed.join(observed, "node").select("context", F.lit("observed").alias("reason")),
        changed.join(declared, "node").select("context", F.lit("declared").alias("reason")),
        changed.filter("confidence = 'medium' AND project IS NOT NULL").select("project").distinct().join(by_project, "project").select("context", F.lit("project").alias("reason")),
        changed.filter("confidence = 'low' OR project IS NULL").groupBy().agg(F.count("*").alias("n")).filter("n > 0").join(everywhere).select("context", F.lit("workspace").alias("reason")),
    ]
    return union_all(picks).distinct()


def selection_complete(changed: DataFrame) -> DataFrame:
    return changed.agg(F.coalesce(F.bool_and((F.col("confidence") == "high") & F.col("project").isNotNull()), F.lit(True)).alias("selection_complete"))


def witness_status(symbols: DataFrame, observed: DataFrame, declared: DataFrame) -> DataFrame:
    """(node, status) of public symbols (node, confidence): witnessed, else declared_only, else unwitnessed if sure, else unknown."""
    seen, said = observed.select("node", F.lit(True).alias("seen")).distinct(), declared.select("node", F.lit(True).alias("said")).distinct()
    status = F.when(F.col("seen"), "witnessed").when(F.col("said"), "declared_only").when(F.col("confidence") == "high", "unwitnessed").otherwise("unknown")
    return symbols.join(seen, "node", "left").join(said, "node", "left").select("node", status.alias("status"))


def detached(contexts: DataFrame, observed: DataFrame) -> DataFrame:
    """Test contexts that witness nothing."""
    return contexts.filter("role = 'test'").join(observed.select("context").distinct(), "context", "left_anti").select("context")


def duplicate_scripts(scripts: DataFrame, command: str) -> DataFrame:
    """Commands that stand more than once but for white space, with their places in order."""
    plain = F.btrim(F.regexp_replace(F.col(command), r"\s+", " "))
    return scripts.groupBy(plain.alias("command")).agg(F.count("*").alias("n_scripts")).filter("n_scripts > 1")
