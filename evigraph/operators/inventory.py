"""Test scripts of projects, and how far a change reaches whose file is not known."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a command contains, and the runner it means.
RUNNERS = (
    ("schemathesis", "schemathesis"), ("playwright", "playwright"), ("vitest", "vitest"), ("cypress", "cypress"), ("pytest", "pytest"), ("unittest", "unittest"), ("cargo test", "cargo"),
    ("deno test", "deno"), ("bun test", "bun"), ("node --test", "node"), ("jest", "jest"), ("mocha", "mocha"), (" ava", "ava"),
)
# Flags of runners that pass without any test.
EMPTY_FLAGS = ("--allow-no-tests", "--pass-with-no-tests", "--passwithnotests", "--suppress-no-test-exit-code")
# Files at the root of a workspace that rule all of it.
CONTROL_FILES = (
    "Cargo.lock", "Cargo.toml", "deno.json", "deno.jsonc", "package-lock.json", "package.json", "Pipfile.lock", "poetry.lock",
    "pnpm-lock.yaml", "pnpm-workspace.yaml", "pyproject.toml", "rust-toolchain", "rust-toolchain.toml", "tsconfig.json", "uv.lock", "yarn.lock",
)


def test_script(name: Column) -> Column:
    return name.isin("test", "pretest", "posttest") | name.startswith("test:") | name.endswith(":test")


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def runners(command: Column) -> Column:
    """The runners that a command names, in any case of ASCII letters, sorted."""
    text = _lower(command)
    named = [F.when(text.contains(needle) | ((text == "ava") | text.startswith("ava ") if runner == "ava" else F.lit(False)), F.lit(runner)) for needle, runner in RUNNERS]
    return F.array_sort(F.array_compact(F.array(*named)))


def no_op(command: Column) -> Column:
    """Commands that do nothing, or only print; white space of any kind around them is no part of them."""
    text = F.regexp_replace(command, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")
    return text.isin("", ":", "true", "exit 0") | (text.rlike("^(echo|printf) ") & ~text.rlike(r"&&|;|\|"))


def allows_empty(command: Column) -> Column:
    return F.arrays_overlap(F.split(_lower(command), r"[\x20\t\n\f\r]+"), F.array(*[F.lit(f) for f in EMPTY_FLAGS]))


def control_path(path: Column, own_config: str | None = None) -> Column:
    """Files at the root that bear on every project; ``own_config`` names the tool's own configuration."""
    names = [*CONTROL_FILES, *([own_config] if own_config else [])]
    known = path.isin(*names) | path.rlike(r"^tsconfig\..*\.json$") | path.rlike(r"^requirements.*\.txt$")
    return ~path.contains("/") & known


def script_inventory(scripts: DataFrame) -> DataFrame:
    """Scripts (name, command, ...) that are tests by name or name a runner, with runners (``other`` where none is named), no_op and allows_empty."""
    held = scripts.withColumn("runners", runners(F.col("command"))).filter(test_script(F.col("name")) | (F.size("runners") > 0))
    shown = F.when(F.size("runners") > 0, F.col("runners")).otherwise(F.array(F.lit("other")))
    return held.select(*scripts.columns, shown.alias("runners"), no_op(F.col("command")).alias("no_op"), allows_empty(F.col("command")).alias("allows_empty"))


def fallback(changed: DataFrame, files: DataFrame, projects: DataFrame, own_config: str | None = None) -> DataFrame:
    """(path, scope, project, source): for each changed path of the repository what it stands for.

    ``file`` where exactly one file has it: files whose path from the repository's root it is, or else, if they are all of one project, files whose path
    inside their project it is. Else ``workspace`` for control files, for paths that files of several projects have, and for
    paths under no project's root; else ``project``, the one with the deepest root above it. ``source`` is the path inside the project.

    ``files``: (node, project, path); ``projects``: (project, root).
    """
    asked = changed.select("path").distinct()
    root = F.btrim("root", F.lit("/"))
    roots = projects.select("project", F.when(root == ".", "").otherwise(root).alias("root")).distinct()
    placed = files.join(roots, "project", "left").select("node", "project", F.col("path").alias("inner"), F.when(F.coalesce("root", F.lit("")) == "", F.col("path")).otherwise(F.concat_ws("/", "root", "path")).alias("path"))

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("path").agg(F.countDistinct("node").alias(f"{name}_nodes"), F.countDistinct("project").alias(f"{name}_projects"), F.min(F.struct("project", "inner")).alias(f"{name}_first"))

    whole = counted(placed, "whole")
    inner = counted(placed.select("node", "project", F.col("inner").alias("path"), "inner"), "inner")
    parts = F.split("path", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    owner = asked.select("path", F.posexplode(above).alias("depth", "root")).join(roots, "root").groupBy("path").agg(F.max_by(F.struct("project", "root"), F.struct("depth", "project")).alias("owner"))
    met = asked.join(whole, "path", "left").join(inner, "path", "left").join(owner, "path", "left")
    files_found = F.when(F.col("whole_nodes") > 0, F.col("whole_nodes")).when(F.col("inner_projects") == 1, F.col("inner_nodes")).otherwise(0)
    file = F.when(F.col("whole_nodes") > 0, F.col("whole_first")).otherwise(F.col("inner_first"))
    scope = F.when(files_found == 1, "file").when(control_path(F.col("path"), own_config) | (F.coalesce("inner_projects", F.lit(0)) > 1) | F.col("owner").isNull(), "workspace").otherwise("project")
    inside = F.when(F.col("owner.root") == "", F.col("path")).when(F.col("path") == F.col("owner.root"), "").otherwise(F.substring("path", F.length("owner.root") + 2, F.length("path")))
    return met.select("path", scope.alias("scope"), F.when(scope == "file", file["project"]).when(scope == "project", F.col("owner.project")).alias("project"), F.when(scope == "file", file["inner"]).when(scope == "project", inside).alias("source"))
