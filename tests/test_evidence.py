"""Usage, inventory, declarations and policies on small fixtures written from their rules."""

import pytest
from pyspark.sql import functions as F

from evigraph.operators import conformance, diff, findings, inventory, joins, lexicon, usage
from evigraph.queries import evidence
from evigraph.sources import files, manifests


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns or frame.columns) for r in frame.collect())


def test_targets(spark):
    held = spark.createDataFrame([("n1", "p", "a.ts"), ("n2", "q", "a.ts"), ("n3", "q", "b.ts")], "node string, project string, path string")
    roots = spark.createDataFrame([("p", "."), ("q", "/pkg/q/")], "project string, root string")
    symbols = spark.createDataFrame([("n3#C.f", "n3", "f"), ("n1#f", "n1", "f")], "node string, file string, name string")
    asked = ["n2", "q::a.ts", "./a.ts", "pkg/q/b.ts", "b.ts", "b.ts#f", "b.ts#C.f", "b.ts#g", "zz", "x::a.ts"]
    got = {r.query: (r.outcome, r.node) for r in usage.resolve_targets(spark.createDataFrame([(a,) for a in asked], "query string"), held, roots, symbols).collect()}
    settled = {"n2": "n2", "q::a.ts": "n2", "./a.ts": "n1", "pkg/q/b.ts": "n3", "b.ts": "n3", "b.ts#f": "n3#C.f", "b.ts#C.f": "n3#C.f"}
    assert got == {k: ("resolved", v) for k, v in settled.items()} | {k: ("unmatched", None) for k in ("b.ts#g", "zz", "x::a.ts")}
    elsewhere = spark.createDataFrame([("p", "x"), ("q", "y")], "project string, root string")
    assert usage.resolve_targets(spark.createDataFrame([("a.ts",)], "query string"), held, elsewhere, symbols).first().outcome == "ambiguous"


def test_literals(spark):
    operations = spark.createDataFrame([(1, "/a", "GET /a", "getA"), (2, "/a", "PUT /a", None)], "operation int, path string, key string, operation_id string")
    literals = spark.createDataFrame([("f", 1, "/a", True), ("f", 2, "/a", False), ("f", 3, "getA", False), ("g", 1, "PUT /a", False)], "site string, line int, value string, http_use boolean")
    declared = spark.createDataFrame([(2, "f", 1)], "operation int, site string, line int")
    assert rows(usage.literal_references(operations, literals, declared)) == [(1, "f", 1, "route"), (1, "f", 3, "operation_id"), (2, "g", 1, "operation_key")]


def test_scripts_and_scopes(spark):
    commands = spark.createDataFrame([("ava",), ("echo x",), ("echo x; ava",), ("true",), ("JEST --passWithNoTests",), ("jest --pass-with-no-tests-x",)], "c string")
    c = F.col("c")
    got = [(r.c, r.r, r.n, r.e) for r in commands.select("c", inventory.runners(c).alias("r"), inventory.no_op(c).alias("n"), inventory.allows_empty(c).alias("e")).collect()]
    assert got == [("ava", ["ava"], False, False), ("echo x", [], True, False), ("echo x; ava", ["ava"], False, False), ("true", [], True, False), ("JEST --passWithNoTests", ["jest"], False, True), ("jest --pass-with-no-tests-x", ["jest"], False, False)]
    scripts = spark.createDataFrame([("test", "make"), ("build", "make"), ("build", "npx JEST"), ("a:test", "\t\n true \u00a0"), ("posttest", "echo a||b"), ("x:test:y", "true")], "name string, command string")
    got = [tuple(r) for r in inventory.script_inventory(scripts).select("name", "runners", "no_op").collect()]
    assert got == [("test", ["other"], False), ("build", ["jest"], False), ("a:test", ["other"], True), ("posttest", ["other"], False)]


def test_change_scopes(spark):
    files = spark.createDataFrame([("1", "a", "x"), ("2", "b", "x"), ("3", "b", "y/z"), ("4", "c", "q"), ("5", "c", "pkg/a/own"), ("6", "a", "own")], "node string, project string, path string")
    projects = spark.createDataFrame([("a", "pkg/a"), ("b", "pkg/b/"), ("c", "."), ("d", "pkg/a/deep")], "project string, root string")
    want = {
        "pkg/a/x": ("file", "a", "x"),  # a path from the repository's root
        "x": ("workspace", None, None),  # two projects have it
        "y/z": ("file", "b", "y/z"),  # one project has it
        "q": ("file", "c", "q"),
        "pkg/a/own": ("project", "a", "own"),  # two files have this path from the root, but no two projects have it inside
        "pkg/b/new": ("project", "b", "new"), "pkg/a/deep/n/m": ("project", "d", "n/m"), "pkg/b": ("project", "b", ""), "other/file": ("project", "c", "other/file"),
        "Cargo.toml": ("workspace", None, None), "pkg/b/Cargo.toml": ("project", "b", "Cargo.toml"), "own.json": ("workspace", None, None),
    }
    changed = spark.createDataFrame([(p,) for p in [*want, "x"]], "path string")
    assert {r.path: (r.scope, r.project, r.source) for r in inventory.fallback(changed, files, projects, "own.json").collect()} == want
    elsewhere = inventory.fallback(spark.createDataFrame([("n/o",)], "path string"), files, projects.filter("root <> '.'")).first()
    assert (elsewhere.scope, elsewhere.project) == ("workspace", None)


def test_tests_and_dispositions(spark):
    want = {
        "src/a.playwright.ts": (True, "test"), "integration-tests/a.ts": (True, "test"), "Tests/a.ts": (True, "test"), "spec/a.ts": (False, "maintained"), "test_a.py": (False, "maintained"), "x_test.go": (False, "maintained"),
        "a/x_TEST.rs": (True, "test"), "a.Spec.ts": (True, "test"), "fixtures/a.ts": (True, "fixture"), "test-data/a": (False, "fixture"), "a/Snapshots/b": (False, "fixture"), "coverage/a": (False, "generated"), "target/a": (False, "generated"),
        "__generated__/a": (False, "generated"), "a.generated.ts": (False, "maintained"), "xtask/a": (False, "tooling"), "benches/a": (False, "tooling"), "tool/a": (False, "tooling"), "tooling/a": (False, "maintained"),
        "scripts/a.test.ts": (True, "test"), "win\\build\\a.ts": (False, "generated"), "win\\tests\\a.ts": (False, "maintained"), "latest/a.ts": (False, "maintained"),
    }
    rows_ = spark.createDataFrame([(p,) for p in want], "p string").select("p", findings.conventional_test(F.col("p")).alias("t"), findings.disposition(F.col("p")).alias("d")).collect()
    assert {r.p: (r.t, r.d) for r in rows_} == want


NODES = "node string, project string, file string, language string"
BOUNDARIES = "project string, node string, kind string, effect string"


def test_confidence_of_files_and_symbols(spark):
    names = [("a.ts", "p", "a.ts", "typescript"), ("b.js", "p", "b.js", "javascript"), ("c.py", "p", "c.py", "python"), ("a.ts#f", "p", "a.ts", "typescript"), ("b.js#g", "p", "b.js", "javascript"), ("c.py#h", "p", "c.py", "python")]
    nodes = spark.createDataFrame([*names, ("r.rs", "q", "r.rs", "rust"), ("r.rs#m", "q", "r.rs", "rust"), ("lost", "none", "lost", "rust"), ("u", "u", "u", None), ("v", "v", "v", None)], NODES)
    projects = spark.createDataFrame([("p", "complete"), ("q", "unsupported"), ("u", "partial"), ("v", "partial")], "project string, completeness string")

    def sure(*boundaries):
        return {r.node: r.confidence for r in findings.node_confidence(nodes, projects, spark.createDataFrame(list(boundaries), BOUNDARIES)).collect()}

    none = sure()
    assert none == {**{n: "high" for n, *_ in names}, "r.rs": "low", "r.rs#m": "low", "lost": "low", "u": "medium", "v": "medium"}
    assert sure(("v", "elsewhere", "dynamic_import", "partial")) == {**none, "v": "high"}  # a boundary that doesn't bear on it explains a partial project
    assert sure(("p", "a.ts#f", "dynamic_import", "partial")) == {**none, "a.ts": "medium", "b.js": "medium", "a.ts#f": "medium"}
    assert sure(("p", "b.js", "reflection", "unsupported")) == {**none, "a.ts": "low", "b.js": "low", "a.ts#f": "low", "b.js#g": "low"}
    assert sure(("p", "c.py", "unsupported_syntax", "partial")) == {**none, "c.py": "medium", "c.py#h": "medium"}
    assert sure(("p", "c.py", "unresolved_internal", "partial")) == {**none, "c.py": "medium"}
    assert sure(("p", None, "reflection", "partial"), ("p", "c.py#h", "unresolved_internal", "unsupported")) == {**none, **{n: "medium" for n, *_ in names}, "c.py": "low", "c.py#h": "low"}
    assert sure(("q", "r.rs", "macro_expansion", "partial")) == {**none, "r.rs#m": "medium"}  # decides alone for Rust symbols


def test_files_and_symbols_that_are_unused(spark):
    roles = spark.createDataFrame([("prod", "production,test"), ("t", "test"), ("tool", "test,tooling"), ("root", "test"), ("s.used", "production"), ("s.t", "test"), ("s.tp", "tooling"), ("s.root", "test")], "node string, roles string")
    roots = spark.createDataFrame([("root",), ("s.root",)], "node string")
    files = spark.createDataFrame([(n,) for n in ("prod", "t", "tool", "root", "gone", "needed")], "node string")
    sure = spark.createDataFrame([(n, "high") for n in ("t", "tool", "gone", "needed", "s.t", "s.priv")] + [("s.low", "low")], "node string, confidence string")
    needed = spark.createDataFrame([("t",), ("needed",), ("s.need",)], "node string")
    assert rows(findings.reach_findings(files, roles, roots, sure, needed), "kind", "node", "confidence") == [("test_only", "t", "medium"), ("tooling_only", "tool", "high"), ("unreachable_file", "gone", "high"), ("unreachable_file", "needed", "medium")]
    symbols = [("s.used", "public"), ("s.t", "private"), ("s.tp", "public"), ("s.root", "private"), ("s.priv", "private"), ("s.int", "internal"), ("s.need", "internal"), ("s.pub", "public"), ("s.low", "public"), ("s.what", "unknown")]
    held = spark.createDataFrame([(n, "prod", v) for n, v in symbols] + [("other", "t", "private"), ("third", "gone", "private"), ("fourth", "root", "private")], "node string, file string, visibility string")
    got = rows(findings.symbol_findings(held, roles, roots, findings.unreported_files(files, roles), sure, needed), "node", "kind", "confidence")
    assert got == [
        ("s.int", "unused_private_symbol", "high"), ("s.low", "unreferenced_public", "low"), ("s.need", "unused_private_symbol", "medium"), ("s.priv", "unused_private_symbol", "high"),
        ("s.pub", "unreferenced_public", "medium"), ("s.t", "test_only", "high"), ("s.tp", "tooling_only", "medium"),
    ]


def test_edges_that_report(spark):
    nodes = spark.createDataFrame([("a", "p", "typescript"), ("t", "p", "typescript"), ("r", "q", "rust"), ("w", "top", "typescript"), ("x", "q", None), ("b", "p", "svelte")], "node string, project string, language string")
    projects = spark.createDataFrame([("p", "apps/p", "complete", ["rust", "typescript"]), ("q", "apps/q", "partial", ["rust"]), ("top", ".", "complete", ["typescript"])], "project string, root string, completeness string, languages array<string>")
    roles = spark.createDataFrame([("t", "test"), ("a", "production")], "node string, roles string")
    bypass = "workspace_source_bypass"
    edges = [
        ("a", "b", bypass, "node"), ("a", "b", "require", "node"), ("t", "b", bypass, "node"), ("t", "b", "dynamic_import", "node"), ("t", "a", bypass, "node"), ("t", "a", "import", "node"), ("w", "a", bypass, "node"), ("a", "w", bypass, "node"),
        ("a", "pkg", bypass, "unexported_workspace"), ("a", "pkg", bypass, "external"), ("a", "./x", "import", "unresolved_internal"), ("r", "./y", "import", "unresolved_internal"), ("x", "./z", "import", "unresolved_internal"),
        ("a", "?", "import", "dynamic_unknown"), ("r", "?", "import", "unsupported"), ("nobody", "b", bypass, "node"),
    ]
    found = findings.edge_findings(spark.createDataFrame(edges, "src string, dst string, kind string, target_kind string"), nodes, projects, spark.createDataFrame([], BOUNDARIES), roles)
    assert rows(found, "node", "target", "kind", "confidence", "gates") == sorted([
        ("a", "b", bypass, "high", True), ("t", "b", bypass, "high", False), ("t", "a", bypass, "high", True), ("w", "a", bypass, "high", False), ("a", "w", bypass, "high", False), ("a", "pkg", "unexported_workspace_import", "high", True),
        ("a", "./x", "unresolved_internal_edge", "high", True), ("r", "./y", "unresolved_internal_edge", "medium", False), ("x", "./z", "unresolved_internal_edge", "medium", False), ("a", "?", "dynamic_boundary", "high", False), ("r", "?", "dynamic_boundary", "medium", False),
    ])


def test_public_symbols_and_what_they_need(spark):
    edges = spark.createDataFrame([("p", "a", "import"), ("a", "b", "require"), ("b", "p", "import"), ("p", "c", "contains"), ("p", "d", "re_export"), ("q", "e", "import")], "src string, dst string, kind string")
    symbols = spark.createDataFrame([("p", "public"), ("q", "private"), ("z", "public")], "node string, visibility string")
    assert rows(findings.public_dependencies(symbols, edges)) == [("a",), ("b",), ("p",), ("z",)]
    issues = "node string, file string, issues array<struct<kind:string,line:int>>"
    directives = spark.createDataFrame([("s", "f", [("x", 3), ("y", 4)]), ("t", "f", []), ("u", "g", [("x", 1)])], issues)
    assert rows(findings.directive_findings(directives, spark.createDataFrame([("f",)], "node string")), "node", "issue", "line") == [("s", "x", 3), ("s", "y", 4)]


def test_declared_paths_and_cycles(spark):
    relations = spark.createDataFrame([("d", "a", "b"), ("d", "b", "c"), ("e", "c", "a"), ("e", "x", "x"), ("u", "a", "c")], "predicate string, subject string, object string")
    constraints = spark.createDataFrame([(1, "a", "c"), (2, "c", "b"), (3, "c", "b"), (4, "z", "z"), (5, "b", "a")], "constraint int, start string, goal string")
    via = spark.createDataFrame([(1, "d"), (2, "e"), (3, "e"), (3, "d"), (5, "d")], "constraint int, predicate string")
    assert rows(conformance.prohibited_paths(constraints, via, relations)) == [(1,), (3,), (4,)]
    assert rows(conformance.cyclic_predicates(relations)) == [("e",)]
    assert rows(conformance.cyclic_predicates(relations.filter("predicate <> 'e'"))) == []


def test_references_and_eligibility(spark):
    references = spark.createDataFrame([("s", "t1", "A", "A"), ("s", "t2", "A", "B"), ("s", "t3", "A", "B"), ("s", "t4", "A", "A")], "source string, target string, document string, target_document string")
    declared = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "target string")
    assert rows(conformance.dangling_references(references, declared, declared.filter("target = 't2'")), "target", "problem") == [("t3", "not_exported"), ("t4", "missing")]
    kinds = spark.createDataFrame([("accepted", ["x"], "granted"), ("accepted", [], "granted"), ("accepted", None, "granted"), ("proposed", ["x"], "granted"), (None, ["x"], None)], "s string, g array<string>, a string")
    got = [tuple(r) for r in kinds.select(*[conformance.eligible(F.col("s"), F.col("g"), F.col("a"), review) for review in (False, True)]).collect()]
    assert got == [(True, True), (False, True), (False, True), (False, True), (False, False)]


def test_suppressions_whichever_way(spark):
    candidates = spark.createDataFrame([(1, "b", "a", "y", "x"), (2, "b", "a", "y", None), (3, "c", "a", "y", "x"), (4, "c", "a", None, None)], "candidate int, term_a string, term_b string, concept_a string, concept_b string")
    pairs = lambda a, b, r: spark.createDataFrame([(a, b, r)], "a string, b string, reason string")
    got = rows(lexicon.suppressions(candidates, pairs("x", "y", "differ"), pairs("a", "b", "never")))
    assert got == [(1, "distinct_from", "differ"), (2, "never_suggest", "never"), (3, "distinct_from", "differ")]


@pytest.mark.parametrize("most", [1, 2, 5, 7, 1000])
def test_sibling_pairs_against_all_pairs(spark, most):
    data = [("k", m, f"{m}{i}") for m, n in (("a", 3), ("b", 1), ("c", 4), ("d", 2)) for i in range(n)] + [("one", "a", "x"), ("one", "a", "y")]
    want = [(k, x, y) for k, m, x in sorted(data) for l, o, y in sorted(data) if k == l and m < o]
    want.sort(key=lambda p: (p[1][0], p[2][0], p[1], p[2]))
    got = rows(lexicon.sibling_pairs(spark.createDataFrame(data, "key string, member string, item string"), most))
    assert got == sorted(want[:most])


def test_repeated_rows_stay(spark):
    paths = spark.createDataFrame([("a/b",), ("a/b",), ("z",)], "path string")
    assert rows(joins.longest_prefix(paths, spark.createDataFrame([("a",)], "root string"))) == [("a/b", "a")] * 2
    points = spark.createDataFrame([(1, 5), (1, 5)], "k int, at int")
    spans = spark.createDataFrame([(1, 0, 9, "wide"), (1, 4, 6, "thin")], "k int, begin int, end int, name string")
    assert rows(joins.narrowest_interval(points, spans, ["k"], "at", "begin", "end", 3, ["name"]), "at", "name") == [(5, "thin")] * 2


def test_null_nodes_and_queries(spark):
    kind = "project string, node string, kind string"
    boundaries = spark.createDataFrame([("p", None, "x"), ("p", "n", "x"), ("q", None, "x")], kind)
    assert rows(findings.new_boundaries(boundaries, spark.createDataFrame([("p", None, "x")], kind)), "project", "node") == [("p", "n"), ("q", None)]
    state = "k int, dynamic boolean, digest string"
    before = spark.createDataFrame([(1, False, "a"), (2, False, "a"), (3, False, "a"), (4, True, "a")], state)
    after = spark.createDataFrame([(1, True, "a"), (2, False, "b"), (4, True, "b"), (5, False, "a"), (6, True, "a")], state)
    assert {r.k: r.severity for r in diff.queries(before, after, "k").collect()} == {1: "breaking", 2: "informational", 3: "informational", 4: "informational", 5: "informational", 6: "breaking"}
    diff.require_same(before.filter("k = 1"), before.filter("k = 2"), ["dynamic", "digest"])
    with pytest.raises(ValueError, match="dynamic"):
        diff.require_same(before, before, ["dynamic"])


def test_parameters(spark):
    places = spark.createDataFrame([("a", 1), ("a", 1), ("a", 3), ("b", 0), ("b", 1), ("c", 1), ("c", 2000)], "q string, p int")
    assert rows(diff.parameter_problems(places, "q", "p")) == [("a", "gap", 2), ("b", "invalid", 0), ("c", "gap", 2), ("c", "limit", 2000)]


def test_paths(spark):
    paths = spark.createDataFrame([(p,) for p in ("src/a.ts", "x/src/a/b/c/d.ts", "src/a/b.ts", "a/src", "lib/tests/x.py")], "p string")
    got = [tuple(r) for r in paths.select(lexicon.semantic_scope(F.col("p")), files.ignored(F.col("p"))).collect()]
    assert got == [(None, False), ("x/src/a/b", False), ("src/a", False), (None, False), (None, True)]
    bundles = {"public/assets/index-9fA3bC12.js": True, "public_html/assets/a/index-DSxv5.js": False, "public/assets/index-abcdefgh.js": False, "public/assets/app-main-Zk4abcde.css": True, "assets/index-9fA3bC12.js": False}
    got = {r.p: r.f for r in spark.createDataFrame([(p,) for p in bundles], "p string").select("p", files.fingerprinted_bundle(F.col("p")).alias("f")).collect()}
    assert got == bundles


def test_malformed_lines_are_kept(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"operation": "a", "status": 200}\n{"operation": \n')
    got = {(r.operation, r.status, r.malformed) for r in manifests.event_lines(spark, str(log)).collect()}
    assert got == {("a", 200, None), (None, None, '{"operation": ')}


def test_importer_counts_make_no_pairs(spark):
    """20,000 symbols of one name with 20,000 importers: 400,000,000 pairs, but one count."""
    n, keys = 20_000, ["package", "name"]
    symbols = spark.range(n).selectExpr("id AS symbol", "'p' AS package", "'hot' AS name", "id % 2 = 0 AS public").unionByName(spark.createDataFrame([(n, "p", "one", True), (n + 1, "q", "hot", True)], "symbol long, package string, name string, public boolean"))
    said = spark.range(n).selectExpr("'p' AS package", "'hot' AS name", "id + 5 AS importer")
    said = said.unionByName(said).unionByName(spark.createDataFrame([("p", "one", 9)], "package string, name string, importer long"))
    got = usage.importer_counts(symbols, said, keys).groupBy("n_importers", "first_importer").count()
    assert rows(got) == [(1, 9, 1), (n, 5, n // 2)]


def most_joined(frame):
    """Rows that the largest join of a query gives out."""
    execution = frame._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    at, most = [execution.executedPlan()], 0
    while at:
        plan = at.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            at.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            at.append(plan.plan())
        if "Join" in name:
            most = max(most, plan.metrics().apply("numOutputRows").value())
        at += [plan.children().apply(k) for k in range(plan.children().size())]
    return most


def test_package_consumers_make_no_pairs(spark, tmp_path):
    """3,000 parts of one name, each asked for by 3,000 customers: 9,000,000 pairs; no join gives out more rows than its tables hold."""
    n, d = 3_000, str(tmp_path)
    spark.range(n).selectExpr("id AS p_partkey", "'b' AS p_brand", "'n' AS p_name", "10 AS p_size").write.parquet(f"{d}/part.parquet")
    spark.range(n).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(f"{d}/orders.parquet")
    spark.range(n).selectExpr("id AS l_orderkey", "(id * 7) % 3000 AS l_partkey").write.parquet(f"{d}/lineitem.parquet")
    got = evidence.package_consumers(spark, d)
    assert rows(got.groupBy("n_consumers").count()) == [(n, n)]
    assert most_joined(got) <= 4 * n


def test_literal_reference_counts(spark):
    import random

    rng, schemas = random.Random(4), ("operation int, path string, key string, operation_id string", "site string, line int, value string, http_use boolean", "operation int, site string, line int")
    operations = [(k, f"/{k % 4}", f"GET /{k}", None if k % 3 else f"id{k}") for k in range(24)] + [(3, "/3", "GET /3", "id3"), (30, "/9", "/1", "/2")]
    literals = [(rng.choice("fgh"), rng.randint(1, 9), rng.choice([f"/{rng.randint(0, 5)}", f"GET /{rng.randint(0, 30)}", f"id{rng.randint(0, 30)}"]), rng.choice([True, False, None])) for _ in range(400)] + [(None, 1, "/1", True), ("f", None, "id3", False)]
    declared = [(rng.randint(0, 30), rng.choice("fgh"), rng.randint(1, 9)) for _ in range(60)] * 2 + [(1, None, 1)]
    frames = [spark.createDataFrame(r, s) for r, s in zip((operations, literals, declared), schemas, strict=True)]
    got, want = usage.literal_reference_counts(*frames), usage.literal_references(*frames).groupBy("operation", "literal_kind").count()
    assert rows(got) == rows(want) and len(rows(want)) > 30


def test_literal_reference_counts_make_no_pairs(spark):
    n = 3_000
    operations = spark.range(n).selectExpr("id AS operation", "'/hot' AS path", "concat('GET ', id) AS key", "CAST(null AS string) AS operation_id")
    literals = spark.range(n).selectExpr("id AS site", "1 AS line", "'/hot' AS value", "true AS http_use")
    declared = spark.range(n).selectExpr("id AS operation", "id AS site", "1 AS line")
    got = usage.literal_reference_counts(operations, literals, declared)
    assert rows(got.groupBy("literal_kind", "n_sites").count()) == [("route", n - 1, n)]
    assert most_joined(got) <= 4 * n


def test_points_meet_lists_of_intervals(spark):
    """800 intervals of one key and bin, 300 points twice: 240,000 pairs of rows; a point meets a row for each 256 intervals."""
    spans = [("k", (7 * i) % 40, 40 + (11 * i) % 59, i) for i in range(800)]
    points = [("k", i % 100, i) for i in range(300)] * 2 + [("other", 5, 1), ("k", None, 2)]
    got = joins.narrowest_interval(spark.createDataFrame(points, "k string, at int, p int"), spark.createDataFrame(spans, "k string, begin int, end int, name int"), ["k"], "at", "begin", "end", 100, ["name"])
    want = []
    for k, at, p in points:
        held = [(e - b, name) for key, b, e, name in spans if key == k and at is not None and b <= at <= e]
        if held:
            want.append((p, at, min(held)[1]))
    assert rows(got, "p", "at", "name") == sorted(want)
    assert most_joined(got) <= 3_000
