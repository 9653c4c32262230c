"""The fold of an event log by operation: outcome counts, coverage, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import status_class


def _sum_if(condition: Column, name: str) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long").alias(name)


def outcome_sums(code: str = "status") -> list[Column]:
    """Sums by class of status; an auth rejection is a client error too."""
    c = status_class(F.col(code))
    return [
        F.count("*").alias("cases"),
        _sum_if(c == "success", "successes"),
        _sum_if(c == "auth", "auth_rejections"),
        _sum_if(c.isin("auth", "client_error"), "client_errors"),
        _sum_if(c == "server_error", "server_errors"),
        _sum_if(F.col("failed_check"), "check_failures"),
    ]


def coverage() -> Column:
    """What the sums of an operation say of it: the first rule that fits."""
    return (
        F.when(F.col("cases") == 0, "not_exercised")
        .when(F.col("server_errors") > 0, "server_error")
        .when(F.col("check_failures") > 0, "check_failure")
        .when(F.col("successes") > 0, "exercised")
        .when(F.col("auth_rejections") == F.col("cases"), "auth_only")
        .otherwise("rejected")
    )


def fold(events: DataFrame, operation: str, code: str = "status") -> DataFrame:
    """One row an operation: sums, coverage, and its histogram of status codes as text."""
    histogram = events.groupBy(operation, code).agg(F.count("*").alias("n")).groupBy(operation)
    joined = histogram.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(code), F.col("n")))), lambda x: F.concat_ws(":", x[code], x["n"])), " ").alias("histogram"))
    return events.groupBy(operation).agg(*outcome_sums(code)).withColumn("coverage", coverage()).join(joined, operation)


def totals(events: DataFrame, operation: str, code: str = "status") -> DataFrame:
    """The same sums by operation and over all (operation null)."""
    return events.rollup(operation).agg(*outcome_sums(code))
