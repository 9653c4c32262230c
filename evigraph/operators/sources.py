"""Whether observed dependencies between packages keep to declared constraints, with the path and evidence of each violation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import cut, union_all
from . import findings, order

# Edges that make one package depend on another, and the kinds of findings in their order.
DEPENDENCY_EDGES = ("module_dependency", "dynamic_import", "glob_import", "require", "workspace_source_bypass")


def workspace_dependencies(edges: DataFrame, nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """(src, dst, evidence): projects that depend on others by edges (src, dst, kind, target_kind, path) from what production
    reaches, with the least path as evidence."""
    used = edges.filter(F.col("kind").isin(*DEPENDENCY_EDGES) & (F.col("target_kind") == "node")).join(roles.filter(F.col("roles").contains("production")).select(F.col("node").alias("src")), "src", "left_semi")
    placed = used.join(nodes.select(F.col("node").alias("src"), F.col("project").alias("a")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("project").alias("b")), "dst").filter("a <> b")
    return placed.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.min("path").alias("evidence"))


def constraint_states(constraints: DataFrame, bindings: DataFrame) -> DataFrame:
    """(constraint, rule, severity, start, goal, state): rules about dependencies (constraint, rule, subject, object, severity) with the
    packages bound to both ends (object, package); without one of them a rule is skipped, else evaluated."""
    of = lambda end, name: bindings.groupBy(F.col("object").alias(end)).agg(F.max("package").alias(name))
    met = constraints.filter(F.col("rule").isin("no_path", "forbids_relation")).join(of("subject", "start"), "subject", "left").join(of("object", "goal"), "object", "left")
    return met.select("constraint", "rule", "severity", "start", "goal", F.when(F.col("start").isNull() | F.col("goal").isNull(), "skipped").otherwise("evaluated").alias("state"))


def forbidden_dependencies(states: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(constraint, severity, hop, src, dst, evidence): the hops of each forbidden path that is there. A forbidden relation is one hop."""
    live = cut(states.filter("state = 'evaluated'"))
    direct = live.filter("rule = 'forbids_relation'").join(dependencies, (F.col("start") == F.col("src")) & (F.col("goal") == F.col("dst"))).select("constraint", "severity", F.lit(1).alias("hop"), "src", "dst", "evidence")
    asked = live.filter("rule = 'no_path'").select(F.col("constraint").alias("key"), "start", "goal")
    hops = order.path_hops(asked, dependencies).withColumnRenamed("key", "constraint")
    along = hops.join(dependencies, ["src", "dst"]).join(live.select("constraint", "severity"), "constraint").select("constraint", "severity", "hop", "src", "dst", "evidence")
    return direct.unionByName(along)


def intrinsic_findings(edges: DataFrame, nodes: DataFrame, projects: DataFrame, roles: DataFrame) -> DataFrame:
    """(kind, severity, source_project, target_project, evidence): imports past a package's exports, whatever is declared.

    Where only tests compare an export with its source a bypass is advisory; the workspace's root project is exempt.
    """
    placed = edges.join(nodes.select(F.col("node").alias("src"), F.col("project").alias("source_project")), "src")
    parts = F.split("dst", "/")
    package = F.when(F.col("dst").rlike("^[.#/]|:"), F.col("dst")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.when(F.col("dst").startswith("@"), 2).otherwise(1)), "/"))
    hidden = placed.filter("target_kind = 'unexported_workspace'").select(F.lit("unexported_workspace_import").alias("kind"), F.lit("error").alias("severity"), "source_project", package.alias("target_project"), F.col("path").alias("evidence")).filter("source_project <> target_project")
    at_root = projects.filter("root = '.'").select("project")
    witness = findings.identity_witnesses(edges, roles).select("src", "dst").distinct().withColumn("witness", F.lit(True))
    bypass = placed.filter("kind = 'workspace_source_bypass' AND target_kind = 'node'").join(nodes.select(F.col("node").alias("dst"), F.col("project").alias("target_project")), "dst")
    for end in ("source_project", "target_project"):
        bypass = bypass.join(at_root.withColumnRenamed("project", end), end, "left_anti")
    severity = F.when(F.col("witness").isNotNull(), "advisory").otherwise("error")
    passed = bypass.join(witness, ["src", "dst"], "left").select(F.lit("workspace_source_bypass").alias("kind"), severity.alias("severity"), "source_project", "target_project", F.col("path").alias("evidence"))
    return union_all([hidden, passed]).distinct()
