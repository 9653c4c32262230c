"""Baselines and differences: full outer joins with a rule for each kind of change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import full_outer

BREAKING, ADDITIVE, REVIEW, INFO = "breaking", "additive", "review", "informational"


def changes(before: DataFrame, after: DataFrame, keys: list[str], values: list[str], added: Column, removed: Column, changed: Column) -> DataFrame:
    """(keys..., change, severity): rows added, removed or changed; values are compared so that null equals null."""
    both = full_outer(before, after, keys, values)
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    named = both.withColumn("change", change).filter(F.col("change").isNotNull())
    severity = F.when(F.col("change") == "added", added).when(F.col("change") == "removed", removed).otherwise(changed)
    return named.select(*keys, "change", severity.alias("severity"))


def public_api(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return changes(before, after, keys, values, F.lit(ADDITIVE), F.lit(BREAKING), F.lit(REVIEW))


def http_operations(before: DataFrame, after: DataFrame, keys: list[str], fixed: list[str], responses: str) -> DataFrame:
    """A changed operation is additive only if nothing but its responses differs and they are a strict superset."""
    old, new = F.col(f"before.{responses}"), F.col(f"after.{responses}")
    same = F.lit(True)
    for c in fixed:
        same = same & F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}"))
    grown = same & (F.size(F.array_except(old, new)) == 0) & (F.size(new) > F.size(old))
    return changes(before, after, keys, [*fixed, responses], F.lit(ADDITIVE), F.lit(BREAKING), F.when(grown, ADDITIVE).otherwise(BREAKING))


def migrations(before: DataFrame, after: DataFrame, name: str, digest: str) -> DataFrame:
    """Edited and removed migrations break; a new one breaks unless its name is after all of the baseline's."""
    last = before.groupBy().agg(F.max(name).alias("__last"))
    found = changes(before, after, [name], [digest], F.lit(ADDITIVE), F.lit(BREAKING), F.lit(BREAKING))
    late = found.join(F.broadcast(last)).withColumn("severity", F.when((F.col("change") == "added") & F.col("__last").isNotNull() & (F.col(name) <= F.col("__last")), BREAKING).otherwise(F.col("severity")))
    return late.drop("__last")


def catalog_items(before: DataFrame, after: DataFrame) -> DataFrame:
    """Items (kind, key, digest, nullable, has_default, is_unique): changed and removed ones break; of new ones, tables and plain
    indexes add, columns add if nullable or with a default, constraints and unique indexes break."""
    after_ = F.col("after")
    added = (
        F.when(F.col("kind") == "table", ADDITIVE)
        .when(F.col("kind") == "column", F.when(after_["nullable"] | after_["has_default"], ADDITIVE).otherwise(BREAKING))
        .when(F.col("kind") == "constraint", BREAKING)
        .otherwise(F.when(after_["is_unique"], BREAKING).otherwise(ADDITIVE))
    )
    return changes(before, after, ["kind", "key"], ["digest", "nullable", "has_default", "is_unique"], added, F.lit(BREAKING), F.lit(BREAKING))


def queries(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Query contracts (key, dynamic, digest): a query that becomes or begins dynamic breaks, any other change informs."""
    dynamic = F.col("after.dynamic")
    return changes(before, after, [key], ["dynamic", "digest"], F.when(dynamic, BREAKING).otherwise(INFO), F.lit(INFO), F.when(dynamic & ~F.col("before.dynamic"), BREAKING).otherwise(INFO))


def bootstraps(before: DataFrame, after: DataFrame, name: str, digest: str) -> DataFrame:
    """Sources of a first schema: any change of them breaks."""
    return changes(before, after, [name], [digest], F.lit(BREAKING), F.lit(BREAKING), F.lit(BREAKING))


def repeated_names(sources: DataFrame, scope: str, name: str, place: str) -> DataFrame:
    """(scope, name, n, first): names declared more than once in a scope, with the least place."""
    return sources.groupBy(scope, name).agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")


def parameter_problems(occurrences: DataFrame, key: str, position: str, most: int = 1024) -> DataFrame:
    """(key, problem, at) of the places of a query's parameters: one below 1, the least above ``most``, the first gap.

    A gap lies after the last place that equals its rank; ranks are taken inside a query.
    """
    each = occurrences.select(key, F.col(position).alias("p")).distinct()
    ranked = each.filter("p > 0").withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("p")))
    gap = ranked.filter("p <> r").groupBy(key).agg(F.min("r").alias("at")).select(key, F.lit("gap").alias("problem"), "at")
    low = each.filter("p <= 0").groupBy(key).agg(F.min("p").alias("at")).select(key, F.lit("invalid").alias("problem"), "at")
    high = each.filter(F.col("p") > most).groupBy(key).agg(F.min("p").alias("at")).select(key, F.lit("limit").alias("problem"), "at")
    return gap.unionByName(low).unionByName(high)


def lint(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """New findings of a linter break, resolved ones inform."""
    return changes(before.select(*keys).distinct(), after.select(*keys).distinct(), keys, keys, F.lit(BREAKING), F.lit(INFO), F.lit(INFO))


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("change", "severity").agg(F.count("*").alias("n_changes"))


def require_same(before: DataFrame, after: DataFrame, columns: list[str]) -> None:
    """Both sides must be one contract, server version and completeness: raises if a column's values differ."""
    sides = before.select(*columns).unionByName(after.select(*columns))
    ends = sides.agg(*[F.struct(F.min(c).eqNullSafe(F.max(c)).alias("one"), F.count_if(F.col(c).isNull()).alias("none"), F.count(c).alias("some")).alias(c) for c in columns]).first()
    for c in columns:
        if not ends[c]["one"] or (ends[c]["none"] and ends[c]["some"]):
            raise ValueError(f"{c} differs between the baseline and the current state")
