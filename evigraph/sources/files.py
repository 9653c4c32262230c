"""Source files as rows: discovery, visibility, ignored paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_matches

# Directories whose sources are not read, and those that are not read as consumers either.
IGNORED_DIRECTORIES = ("tests", "__tests__", "__test__", "__mocks__", "target", "node_modules", "dist", "build", "coverage", ".git")
NO_CONSUMERS = ("target", "node_modules", "dist", "build", "coverage")
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "svelte": "svelte", "py": "python", "rs": "rust", "sql": "sql"}


def ignored(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda x: x.isin(*IGNORED_DIRECTORIES))


def no_consumer(directory: Column) -> Column:
    return directory.startswith(".") | directory.isin(*NO_CONSUMERS)


def fingerprinted_bundle(path: Column) -> Column:
    """Built assets: under public/assets or public_html/assets, with 8 to 16 characters after a hyphen of the stem that hold
    two upper-case letters, or one and a digit."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    pieces = F.split(stem, "-")
    ends = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), "-"))
    upper = lambda x: F.length(F.regexp_replace(x, "[^A-Z]", ""))
    hashed = F.exists(F.slice(ends, 2, F.greatest(F.size(ends) - 1, F.lit(0))), lambda x: x.rlike("^[A-Za-z0-9_-]{8,16}$") & ((upper(x) >= 2) | ((upper(x) >= 1) & x.rlike("[0-9]"))))
    return path.rlike("(^|/)public(_html)?/assets(/|$)") & hashed


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def visible(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Not ignored and not excluded, unless an include pattern names it."""
    named = glob_matches(path, include) if include else F.lit(False)
    return named | (~ignored(path) & ~fingerprinted_bundle(path) & ~(glob_matches(path, exclude) if exclude else F.lit(False)))


def discover(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, most_bytes: int = 8 << 20) -> DataFrame:
    """(path, language, text, bytes) of the visible source files under a folder; larger files have null text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(F.col("path"), "^.*?" + "/" + root.rstrip("/").split("/")[-1] + "/", "")
    rows = raw.select(relative.alias("path"), F.col("length").alias("bytes"), "content").withColumn("language", language(F.col("path")))
    kept = rows.filter(F.col("language").isNotNull() & visible(F.col("path"), include or [], exclude or []))
    return kept.select("path", "language", F.when(F.col("bytes") <= most_bytes, F.col("content").cast("string")).alias("text"), "bytes")


def nested_roots(projects: DataFrame) -> DataFrame:
    """(root, inner): project roots that lie under another one, which leaves them out."""
    outer, inner = projects.select("root").distinct(), projects.select(F.col("root").alias("inner")).distinct()
    parts = F.split("inner", "/")
    above = inner.filter(F.size(parts) > 1).select("inner", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
    return above.join(outer, "root", "left_semi").select("root", "inner")
