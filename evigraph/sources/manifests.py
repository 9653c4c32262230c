"""Package manifests, relation providers, event logs, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inventory

#: Limits of one relation provider.
MOST_BYTES, MOST_RECORDS = 64 << 20, 250_000


def manifests(files: DataFrame) -> DataFrame:
    """(path, name, version, entry, target) of package.json texts (path, text): one row an export or entry point."""
    exports = F.from_json(F.get_json_object("text", "$.exports"), "map<string,string>")
    main = F.create_map(F.lit("."), F.get_json_object("text", "$.main"))
    entries = F.coalesce(exports, F.when(F.get_json_object("text", "$.main").isNotNull(), main))
    return files.select("path", F.get_json_object("text", "$.name").alias("name"), F.get_json_object("text", "$.version").alias("version"), F.explode_outer(entries).alias("entry", "target"))


def scripts(files: DataFrame) -> DataFrame:
    """(path, script, command, is_test, runners, no_op, allows_empty) of package.json texts."""
    held = F.from_json(F.get_json_object("text", "$.scripts"), "map<string,string>")
    rows = files.select("path", F.explode(held).alias("script", "command"))
    command = F.col("command")
    return rows.select("*", inventory.test_script(F.col("script")).alias("is_test"), inventory.runners(command).alias("runners"), inventory.no_op(command).alias("no_op"), inventory.allows_empty(command).alias("allows_empty"))


def dependencies(files: DataFrame) -> DataFrame:
    """(path, kind, package, range, local) of package.json texts."""
    out = None
    for kind in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        held = F.from_json(F.get_json_object("text", f"$.{kind}"), "map<string,string>")
        rows = files.select("path", F.lit(kind).alias("kind"), F.explode(held).alias("package", "range"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("local", F.col("range").rlike("^(workspace|file|link):"))


def relation_provider(spark: SparkSession, path: str, sha256: str, kind: str) -> DataFrame:
    """(subject, predicate, object) of a pinned provider file: CSV of three columns, or JSON lines. Raises if it isn't the pinned one."""
    raw = spark.read.format("binaryFile").load(path).select("length", F.sha2("content", 256).alias("digest")).collect()  # one row
    if len(raw) != 1 or raw[0]["length"] > MOST_BYTES:
        raise ValueError(f"{path}: one file of at most {MOST_BYTES} bytes is expected")
    if raw[0]["digest"] != sha256:
        raise ValueError(f"{path}: its digest is not the pinned one")
    schema = "subject string, predicate string, object string"
    rows = spark.read.schema(schema).csv(path) if kind == "csv" else spark.read.schema(schema).json(path)
    if rows.limit(MOST_RECORDS + 1).count() > MOST_RECORDS:
        raise ValueError(f"{path}: over {MOST_RECORDS} records")
    return rows


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """(operation, case_id, parent_id, status, failed_check, malformed) of a log of JSON lines; ``malformed`` holds the text of a
    line that doesn't parse, else null, so that such lines can be counted."""
    schema = "operation string, case_id string, parent_id string, status int, failed_check boolean, malformed string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed").json(path)


def snapshot(rows: DataFrame, path: str) -> None:
    """Writes a baseline once: an existing one is left as it is."""
    rows.write.mode("ignore").parquet(path)
