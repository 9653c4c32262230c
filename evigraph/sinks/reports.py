"""Reports: canonical JSON lines, text, dependency graphs, content-addressed artifacts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, order: list[str], path: str) -> None:
    """Rows as JSON, ordered, keys in order of the name; files in order of their names hold them in order."""
    rows.orderBy(*order).select(*sorted(rows.columns)).write.mode("overwrite").json(path)


def text_lines(rows: DataFrame, order: list[str], pattern: str) -> Iterator[str]:
    """Formatted rows in order, streamed a partition at a time."""
    for row in rows.orderBy(*order).toLocalIterator():
        yield pattern.format(**row.asDict())


def mermaid(edges: DataFrame, owner_of_source: str, owner_of_target: str) -> Iterator[str]:
    """A flow chart of edges between owners, each once."""
    yield "graph TD"
    pairs = edges.select(F.col(owner_of_source).alias("a"), F.col(owner_of_target).alias("b")).filter("a <> b").distinct()
    for row in pairs.orderBy("a", "b").toLocalIterator():
        yield f'  {_name(row.a)}["{row.a}"] --> {_name(row.b)}["{row.b}"]'


def _name(text: str) -> str:
    return "n_" + "".join(c if c.isalnum() else f"_{ord(c):x}_" for c in text)


def artifacts(rows: DataFrame, body: list[str], path: str) -> DataFrame:
    """Adds each row's content digest and appends the rows whose digest is not stored yet, by the digest's first byte."""
    spark = rows.sparkSession
    content = F.to_json(F.struct(*[F.col(c) for c in sorted(body)]))
    named = rows.withColumn("content_digest", F.sha2(content, 256)).dropDuplicates(["content_digest"]).withColumn("shard", F.substring("content_digest", 1, 2))
    try:
        known = spark.read.parquet(path).select("content_digest")
        named = named.join(known, "content_digest", "left_anti")
    except AnalysisException as e:  # nothing is stored yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    named.write.mode("append").partitionBy("shard").parquet(path)
    return spark.read.parquet(path)
