"""The event fold over a growing folder of event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.events import coverage, outcome_sums


def event_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def folded(events: DataFrame, operation: str) -> DataFrame:
    """Running sums by operation; the state is one row an operation."""
    return events.groupBy(operation).agg(*outcome_sums()).withColumn("coverage", coverage())


def start(events: DataFrame, operation: str, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the fold's rows after each batch to a folder of that batch's number; what is in the folder now is read and the query ends.

    A batch that is run again after a failure overwrites its own folder. The rows stay on the executors.
    """

    def store(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch:012}")

    out = folded(events, operation).writeStream.outputMode("complete").foreachBatch(store)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The fold after the last batch."""
    rows = spark.read.parquet(path)
    last = rows.agg({"batch": "max"}).first()[0]
    return rows.filter(rows["batch"] == last).drop("batch")
