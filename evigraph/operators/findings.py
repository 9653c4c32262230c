"""Findings: anti joins and ordered rules over what contexts reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ids import digest
from ..model import COMPLETENESS, CONFIDENCE, FINDING_KINDS, GATING, TOGETHER, named, ordinal
from . import graph

# Parts of paths, and infixes and endings of names, that tell what a source is for.
FIXTURES = ("fixture", "fixtures", "__fixtures__", "testdata", "test-data", "snapshots")
GENERATED = ("generated", "__generated__", "dist", "build", "coverage", "target")
TOOLING = ("tool", "tools", "script", "scripts", "xtask", "benches")
TEST_PARTS = ("test", "tests", "__test__", "__tests__", "integration-tests", "fixtures")
TEST_INFIXES, TEST_ENDINGS = (".test.", ".spec.", ".playwright."), ("_test.py", "_test.rs")
# Boundaries behind which code may be that no parser shows.
UNSEEN_CODE = ("macro_expansion", "conditional_compilation", "unsupported_syntax")


def worst_completeness(projects: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(project, completeness): the worst of a project's own and its boundaries' effects."""
    own = projects.select("project", ordinal("completeness", COMPLETENESS).alias("o"))
    effects = boundaries.select("project", ordinal("effect", COMPLETENESS).alias("o"))
    return own.unionByName(effects).groupBy("project").agg(named(F.max("o"), COMPLETENESS).alias("completeness"))


def project_confidence(projects: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(project, confidence) by a project's worst completeness."""
    return worst_completeness(projects, boundaries).select("project", named(ordinal("completeness", COMPLETENESS), CONFIDENCE).alias("confidence"))


def node_confidence(nodes: DataFrame, projects: DataFrame, boundaries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, confidence) of files and symbols ``nodes``: (node, project) and, where there are symbols or languages, (file, language).

    A project that is unknown or unsupported gives low. Else confidence starts complete (partial for a partial project
    without any boundary) and is worsened by boundaries of the whole project and by those that bear on the node: for a file those at it
    or at one of its symbols; for a symbol those at it, and at its file those of macros, conditional compilation or
    syntax; reflection, and for files dynamic imports, of any node whose language runs together with the node's. In a
    Rust symbol's project macros, conditional compilation or syntax at Rust code or the project alone decide, if there are any.

    ``known``: (node, file, language) of the nodes that boundaries may stand at (``nodes`` if not given); a file's ``file`` is
    itself. ``boundaries``: (project, node, kind, effect). All of them are summed up before they meet nodes.
    """
    if "file" not in nodes.columns:
        nodes = nodes.withColumn("file", F.col("node"))
    if "language" not in nodes.columns:
        nodes = nodes.withColumn("language", F.lit(None).cast("string"))
    known = (nodes if known is None else known).select("node", F.col("file").alias("at_file"), family("language").alias("family")).dropDuplicates(["node"])
    effect = boundaries.select("project", "node", "kind", ordinal("effect", COMPLETENESS).alias("o"))
    placed = effect.join(known, "node", "left")
    local = F.col("kind").isin(*UNSEEN_CODE)
    at_project = effect.groupBy("project").agg(F.count("*").alias("all"), F.max(F.when(F.col("node").isNull(), F.col("o"))).alias("wide"), F.max(F.when(F.col("node").isNull() & local, F.col("o"))).alias("wide_code"))
    at_file = placed.filter("node IS NOT NULL").groupBy("project", F.coalesce("at_file", "node").alias("file")).agg(F.max("o").alias("in_file"), F.max(F.when(local & (F.col("node") == F.coalesce("at_file", "node")), F.col("o"))).alias("code_at_file"))
    at_node = effect.filter("node IS NOT NULL").groupBy("project", "node").agg(F.max("o").alias("own"))
    by_family = placed.filter("family IS NOT NULL").groupBy("project", "family").agg(
        F.max(F.when(F.col("kind").isin("dynamic_import", "reflection"), F.col("o"))).alias("seen_by_files"), F.max(F.when(F.col("kind") == "reflection", F.col("o"))).alias("seen_by_symbols"), F.max(F.when(local, F.col("o"))).alias("family_code")
    )
    joined = nodes.select("node", "project", "file", family("language").alias("family")).join(projects.select("project", "completeness"), "project", "left")
    for side, keys in ((at_project, ["project"]), (at_file, ["project", "file"]), (at_node, ["project", "node"]), (by_family, ["project", "family"])):
        joined = joined.join(side, keys, "left")
    start = F.when((F.col("completeness") == "partial") & F.col("all").isNull(), 1).otherwise(0)
    is_file = F.col("node") == F.col("file")
    bearing = F.when(is_file, F.greatest("in_file", "seen_by_files", F.lit(0))).otherwise(F.greatest("own", "code_at_file", "seen_by_symbols", F.lit(0)))
    unknown = F.col("completeness").isNull() | (F.col("completeness") == "unsupported")
    rust = F.when(~is_file & (F.col("family") == "rust"), F.greatest("wide_code", "family_code", F.lit(0))).otherwise(0)
    place = F.when(rust > 0, rust).when(unknown, 2).otherwise(F.greatest(start, F.coalesce("wide", F.lit(0)), bearing))
    return joined.select("node", named(place, CONFIDENCE).alias("confidence"))


def family(language: str) -> Column:
    """Languages that run together under one name."""
    return F.when(F.col(language).isin(*TOGETHER), "ecmascript").otherwise(F.col(language))


def lowered(confidence: Column, when: Column) -> Column:
    """High becomes medium where the condition holds."""
    return F.when(when & (confidence == "high"), F.lit("medium")).otherwise(confidence)


def disposition(path: Column) -> Column:
    """What a source is for, by its folders and name in any case of letters: the first rule that fits."""
    parts = F.split(F.lower(path), r"[/\\]")
    named_so = lambda names: F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    return F.when(named_so(FIXTURES), "fixture").when(named_so(GENERATED), "generated").when(conventional_test(path), "test").when(named_so(TOOLING), "tooling").otherwise("maintained")


def conventional_test(path: Column) -> Column:
    """Tests by a folder (or a whole name) among TEST_PARTS, or by an infix or ending of the name, in any case of letters."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    found = F.arrays_overlap(parts, F.array(*[F.lit(n) for n in TEST_PARTS]))
    for infix in TEST_INFIXES:
        found = found | name.contains(infix)
    for ending in TEST_ENDINGS:
        found = found | name.endswith(ending)
    return found


def evidence_class(kind: Column, confidence: Column) -> Column:
    limited = (confidence != "high") | kind.isin("unreferenced_public", "dynamic_boundary")
    inferred = kind.isin("unreachable_file", "unused_private_symbol", "test_only", "tooling_only")
    return F.when(limited, "boundary_limited").when(inferred, "inferred").otherwise("direct")


def public_dependencies(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): public symbols (node, visibility) and all that they lead to, by edges that are no containment or re-export."""
    public = symbols.filter(F.col("visibility") == "public").select("node")
    return graph.expand(public, graph.traversable(edges), [], []).select("node")


def _only(roles: Column) -> Column:
    """The kind of a node that contexts reach, but none of production."""
    return F.when(~roles.contains("production"), F.when(roles == "test", "test_only").otherwise("tooling_only"))


def reach_findings(nodes: DataFrame, roles: DataFrame, roots: DataFrame, confidence: DataFrame, needed_by_public: DataFrame) -> DataFrame:
    """(kind, node, confidence): files that no context reaches, and files that only tests or tooling reach.

    ``needed_by_public``: (node) that a public symbol leads to; the confidence of a finding at it is lowered. Roots are exempt
    from the second kind.
    """
    files = nodes.select("node").join(roles.select("node", "roles"), "node", "left").join(confidence, "node", "left").join(_marked(needed_by_public, "needed"), "node", "left").join(_marked(roots, "is_root"), "node", "left")
    kind = F.when(F.col("roles").isNull(), "unreachable_file").when(F.col("is_root").isNull(), _only(F.col("roles")))
    return files.select(kind.alias("kind"), "node", lowered(F.coalesce("confidence", F.lit("high")), F.col("needed").isNotNull()).alias("confidence")).filter("kind IS NOT NULL")


def _marked(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select("node").distinct().withColumn(name, F.lit(True))


def unreported_files(nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """(node) of files that production reaches: only their symbols are looked at. Roots that only tests or tooling reach are none."""
    return nodes.select("node").join(roles.filter(F.col("roles").contains("production")).select("node"), "node", "left_semi")


def symbol_findings(symbols: DataFrame, roles: DataFrame, roots: DataFrame, files: DataFrame, confidence: DataFrame, needed_by_public: DataFrame) -> DataFrame:
    """(kind, node, confidence) of symbols (node, file, visibility) in ``files`` (node), those with no finding of their own.

    A symbol that only tests or tooling reach is test_only or tooling_only, unless it is a root; its confidence is lowered
    if it is public or needed by a public one. One that nothing reaches is unused_private_symbol (private or internal, lowered if
    needed) or unreferenced_public (always lowered); with unknown visibility it is nothing.
    """
    rest = symbols.select("node", "file", "visibility").join(files.select(F.col("node").alias("file")).distinct(), "file", "left_semi")
    rest = rest.join(roles.select("node", "roles"), "node", "left").join(confidence, "node", "left").join(_marked(needed_by_public, "needed"), "node", "left").join(_marked(roots, "is_root"), "node", "left")
    hidden, public = F.col("visibility").isin("private", "internal"), F.col("visibility") == "public"
    unreached = F.when(hidden, "unused_private_symbol").when(public, "unreferenced_public")
    kind = F.when(F.col("roles").isNull(), unreached).when(F.col("is_root").isNull(), _only(F.col("roles")))
    return rest.select(kind.alias("kind"), "node", lowered(F.coalesce("confidence", F.lit("high")), public | F.col("needed").isNotNull()).alias("confidence")).filter("kind IS NOT NULL")


def edge_findings(edges: DataFrame, nodes: DataFrame, projects: DataFrame, boundaries: DataFrame, roles: DataFrame) -> DataFrame:
    """(kind, node, project, target, confidence, gates): what the kinds and targets of edges (src, dst, kind, target_kind) report.

    ``nodes``: (node, project, language); ``projects``: (project, root, completeness, languages); ``roles``: (node, roles). An edge
    of a node that is not known reports nothing. A bypass is one if its target is a node; it does not gate where one of
    both ends lies in the project at the workspace's root, or where only tests reach its source and an edge of a module
    goes the same way. Dynamic and unsupported targets are as sure as the project. An unresolved edge is certain, but in Rust as
    sure as the project.
    """
    bypass = (F.col("kind") == "workspace_source_bypass") & (F.col("target_kind") == "node")
    reported_kind = (
        F.when(bypass, "workspace_source_bypass")
        .when(F.col("target_kind") == "unexported_workspace", "unexported_workspace_import")
        .when(F.col("target_kind") == "unresolved_internal", "unresolved_internal_edge")
        .when(F.col("target_kind").isin("dynamic_unknown", "unsupported"), "dynamic_boundary")
    )
    found = edges.select(reported_kind.alias("found"), "src", "dst").filter("found IS NOT NULL")
    at = projects.select("project", (F.col("root") == ".").alias("at_root"), (F.size("languages") == 1).alias("one"), F.array_contains("languages", "rust").alias("with_rust")).join(project_confidence(projects, boundaries).withColumnRenamed("confidence", "sure"), "project")
    own = nodes.select(F.col("node").alias("src"), "project", "language").join(at, "project", "left")
    far = nodes.join(at.filter("at_root"), "project", "left_semi").select(F.col("node").alias("dst")).distinct().withColumn("far_root", F.lit(True))
    witness = identity_witnesses(edges, roles).select("src", "dst").distinct().withColumn("witness", F.lit(True))
    met = found.join(own, "src").join(far, "dst", "left").join(witness, ["src", "dst"], "left")
    sure = F.coalesce("sure", F.lit("low"))
    rust = F.coalesce(F.col("language") == "rust", F.col("one") & F.col("with_rust"), F.lit(False))
    confidence = F.when(F.col("found") == "dynamic_boundary", sure).when((F.col("found") == "unresolved_internal_edge") & rust, sure).otherwise("high")
    lifted = (F.col("found") == "workspace_source_bypass") & (F.coalesce("at_root", F.lit(False)) | F.col("far_root").isNotNull() | F.col("witness").isNotNull())
    return met.select(F.col("found").alias("kind"), F.col("src").alias("node"), "project", F.col("dst").alias("target"), confidence.alias("confidence"), (gates(F.col("found"), confidence) & ~lifted).alias("gates"))


def identity_witnesses(edges: DataFrame, roles: DataFrame) -> DataFrame:
    """Bypass edges beside an edge of a module with the same ends, from a node that only tests reach: these don't gate."""
    to_nodes = edges.filter(F.col("target_kind") == "node") if "target_kind" in edges.columns else edges
    modules = to_nodes.filter(F.col("kind").isin("module_dependency", "dynamic_import", "require")).select("src", "dst").distinct()
    tests = roles.filter(F.col("roles") == "test").select(F.col("node").alias("src"))
    return to_nodes.filter(F.col("kind") == "workspace_source_bypass").join(modules, ["src", "dst"], "left_semi").join(tests, "src", "left_semi")


def directive_findings(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, node, issue, line, confidence): every issue of a symbol's directive (node, file, issues: array of (kind, line)), if its file is known."""
    known = symbols.join(files.select(F.col("node").alias("file")).distinct(), "file", "left_semi").select("node", F.explode("issues").alias("i"))
    return known.select(F.lit("malformed_fuzz_directive").alias("kind"), "node", F.col("i.kind").alias("issue"), F.col("i.line").alias("line"), F.lit("high").alias("confidence"))


def gates(kind: Column, confidence: Column) -> Column:
    return kind.isin(*GATING) & (confidence == "high")


def reported(findings: DataFrame) -> DataFrame:
    """Findings with evidence, gate, a stable id and their place in the canonical order."""
    return findings.select(
        "*",
        evidence_class(F.col("kind"), F.col("confidence")).alias("evidence"),
        gates(F.col("kind"), F.col("confidence")).alias("gates"),
        ordinal("kind", FINDING_KINDS).alias("kind_ord"),
        digest(F.col("kind"), F.col("node"), domain="finding/1").alias("finding_id"),
    )


def new_boundaries(boundaries: DataFrame, findings: DataFrame) -> DataFrame:
    """Boundaries that no finding stands for already."""
    known = findings.select("project", F.col("node").alias("__node"), "kind").distinct()
    same = (boundaries["project"] == known["project"]) & (boundaries["kind"] == known["kind"]) & boundaries["node"].eqNullSafe(known["__node"])
    return boundaries.join(known, same, "left_anti")
