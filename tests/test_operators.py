"""Every query against its SQL at the smallest scale, and properties that hold between operators."""

import duckdb
import pytest

from evigraph import catalog, ids
from evigraph.operators import conformance, diff, findings, graph, windows
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    def value(v):
        return "~" if v is None else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    expected = duck.sql(catalog.ORACLE_SQL[name])
    assert columns == sorted(expected.columns)
    got = [tuple(r[c] for c in columns) for r in frame.collect()]
    want = [tuple(r) for r in expected.select(*[f'"{c}"' for c in columns]).fetchall()]
    assert plain(got) == plain(want)


@pytest.fixture(scope="module")
def small(spark):
    edges = spark.createDataFrame([(a, b, "import") for a, b in ("ab", "bc", "ca", "cd", "de", "xy", "bb")], "src string, dst string, kind string")
    contexts = spark.createDataFrame([("p", "production", "runtime"), ("t", "test", "runtime")], "context string, role string, scope string")
    roots = spark.createDataFrame([("p", "b"), ("p", "d"), ("t", "a")], "context string, node string")
    return edges, contexts, roots


def test_witness_and_targets_agree(small, spark):
    edges, contexts, roots = small
    full = {(r.context, r.node): (r.distance, r.root_index, r.root) for r in graph.reachability(edges, contexts, roots).collect()}
    assert full["p", "e"] == (1, 1, "d") and full["p", "a"] == (2, 0, "b") and full["t", "e"] == (4, 0, "a") and ("p", "y") not in full
    targets = spark.createDataFrame([("e",), ("a",)], "node string")
    part = {(r.context, r.target): (r.distance, r.root_index, r.root) for r in graph.reach_targets(edges, roots, targets).collect()}
    assert part == {k: v for k, v in full.items() if k[1] in "ea"}


def test_symbols_reach_their_files_and_surfaces_backwards(spark):
    edges = spark.createDataFrame([("s", "t", "import"), ("a", "b", "re_export"), ("b", "c", "re_export"), ("c", "s", "import"), ("x", "s", "import")], "src string, dst string, kind string")
    contexts = spark.createDataFrame([("open", "public_surface"), ("run", "runtime")], "context string, scope string")
    roots = spark.createDataFrame([("open", "a"), ("run", "a"), ("run", "x")], "context string, node string")
    symbols = spark.createDataFrame([("t", "f"), ("s", "g")], "node string, file string")
    full = {(r.context, r.node): (r.distance, r.root_index, r.root) for r in graph.reachability(edges, contexts, roots, symbols).collect()}
    assert full["open", "f"] == (3, 0, "a") and full["run", "g"] == (2, 1, "x") and ("run", "b") not in full and full["open", "c"] == (0, 0, "a")
    targets = spark.createDataFrame([(n,) for n in "fgbs"], "node string")
    part = {(r.context, r.target): (r.distance, r.root_index, r.root) for r in graph.reach_targets(edges, roots, targets, contexts, symbols).collect()}
    assert part == {k: v for k, v in full.items() if k[1] in "fgbs"}


def test_tables_go_when_nothing_reads_them(spark):
    from evigraph.plans import iterate

    before = len(iterate._standing)
    made = iterate.tidied(lambda: iterate.cut(iterate.cut(spark.range(5)).filter("id > 1")))()
    assert len(iterate._standing) == before + 1 and made.count() == 3
    laid = iterate.tidied(lambda: iterate.laid_out(spark.range(9), "id").groupBy("id").count())()
    assert laid.count() == 9 and len(iterate._standing) == before + 2
    kept, n = iterate.counted_cut(spark.range(7))
    assert n == 7 == kept.count()
    iterate.remove_tables(before)
    assert len(iterate._standing) == before


def test_closure_cycles_paths_components(small, spark):
    edges, _, _ = small
    assert {r.node for r in graph.cyclic_nodes(edges).collect()} == {"a", "b", "c"}
    paths = {(r.source, r.node): "".join(r.path) for r in graph.shortest_paths(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert paths == {("a", "b"): "ab", ("a", "c"): "abc", ("a", "d"): "abcd", ("a", "e"): "abcde"}
    assert {(r.node, r.component) for r in graph.connected(edges).collect()} == {*((n, "a") for n in "abcde"), ("x", "x"), ("y", "x")}


def test_pages_make_the_slice(small, spark):
    edges, _, _ = small
    hood = graph.neighbourhood(edges, spark.createDataFrame([("c",)], "node string"), 2)
    whole = [(r.distance, r.node) for r in hood.orderBy("distance", "node").collect()]
    pages = [[(r.distance, r.node) for r in windows.page(hood, ["distance", "node"], k, 2).orderBy("place").collect()] for k in range(0, len(whole), 2)]
    assert [x for p in pages for x in p] == whole


def test_facts_never_return_to_their_origin(small, spark):
    edges, _, _ = small
    seeds = spark.createDataFrame([("c", "writes", "direct"), ("e", "unknown", "boundary_limited")], "node string, kind string, evidence string")
    got = {(r.node, r.origin, r.evidence) for r in graph.propagate_facts(seeds, edges).collect()}
    assert got == {("c", "c", "direct"), ("b", "c", "inferred"), ("a", "c", "inferred"), *((n, "e", "boundary_limited") for n in "abcde")}


def test_diff_of_equals_is_empty_and_turns_around(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "z")], "k int, v string, w string")
    b = spark.createDataFrame([(2, "y", "q"), (3, "y", "z")], "k int, v string, w string")
    assert diff.public_api(a, a, ["k"], ["v", "w"]).count() == 0
    there = {(r.k, r.change, r.severity) for r in diff.public_api(a, b, ["k"], ["v", "w"]).collect()}
    assert there == {(1, "removed", "breaking"), (2, "changed", "review"), (3, "added", "additive")}
    back = {(r.k, r.change) for r in diff.public_api(b, a, ["k"], ["v", "w"]).collect()}
    assert back == {(1, "added"), (2, "changed"), (3, "removed")}


def test_ids_and_findings(spark):
    row = spark.range(1).select(ids.file_id(F.lit("a/b"), F.lit("c~d")).alias("f"), ids.cursor(F.lit(1), F.lit("x/é?")).alias("c"), findings.disposition(F.lit("src/x_test.py")).alias("d")).withColumn("r", ids.read_cursor(F.col("c"))).first()
    assert row.f == "file/a~1b/c~0d" and row.r == ["1", "x/é?"] and "=" not in row.c and row.d == "test"


def test_providers(spark):
    facts = [("approves", "ap", "p1"), ("covers", "ap", "cap"), ("provides", "p1", "cap"), ("provides", "p2", "cap"), ("contract", "p1", "c1")]
    got = conformance.approved_providers(spark.createDataFrame(facts, "predicate string, subject string, object string")).collect()
    assert [(r.capability, r.provider, r.contract, r.owner, r.duplicate) for r in got] == [("cap", "p1", "c1", None, False)]


@pytest.mark.parametrize("most", [0, 100_000])
def test_walks_lay_steps_out_only_for_many_rounds_or_rows(small, spark, monkeypatch, most):
    """Few rows read the steps as they are, at most twice; results are the same when every round has too many rows."""
    from evigraph.plans import iterate

    laid = []
    monkeypatch.setattr(graph, "laid_out", lambda *a, **k: laid.append(a[1]) or iterate.laid_out(*a, **k))
    monkeypatch.setattr(graph, "MOST_BROADCAST", most)
    monkeypatch.setattr(iterate, "MOST_BROADCAST", most)
    edges, _, _ = small
    twice = edges.unionByName(edges)
    start = spark.createDataFrame([("a",)], "node string")
    near = {(r.node, r.distance) for r in graph.neighbourhood(twice, start, 2, "outgoing").collect()}
    assert near == {("a", 0), ("b", 1), ("c", 2)} and laid == ([] if most else ["src"])
    far = {(r.node, r.distance) for r in graph.neighbourhood(twice, start, 9, "outgoing").collect()}
    assert far == near | {("d", 3), ("e", 4)} and laid[-1] == "src" and len(laid) == (1 if most else 2)


@pytest.mark.parametrize("most", [0, 100_000])
def test_paths_and_facts_deal_their_steps_once(spark, monkeypatch, most):
    from evigraph.plans import iterate

    laid = []
    monkeypatch.setattr(graph, "laid_out", lambda *a, **k: laid.append(a[1]) or iterate.laid_out(*a, **k))
    monkeypatch.setattr(graph, "MOST_BROADCAST", most)
    monkeypatch.setattr(iterate, "MOST_BROADCAST", most)
    pairs = [("a", "c"), ("a", "b"), ("b", "e"), ("c", "d"), ("d", "z"), ("e", "z"), ("b", "a"), ("z", "a"), ("b", "e"), ("x", "c"), ("x", "b2"), ("b2", "d")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    sources = spark.createDataFrame([("a",), ("x",)], "node string")
    paths = {(r.source, r.node): (r.hops, "".join(r.path)) for r in graph.shortest_paths(edges, sources).collect()}
    assert paths["a", "z"] == (3, "abez") and paths["x", "d"] == (2, "xb2d") and paths["x", "e"] == (6, "xb2dzabe") and ("a", "a") not in paths and laid == ["src"]
    facts = graph.propagate_facts(spark.createDataFrame([("z", "writes", "direct")], "node string, kind string, evidence string"), edges)
    assert {(r.node, r.direct) for r in facts.collect()} == {("z", True), *((n, False) for n in ("a", "b", "b2", "c", "d", "e", "x"))} and laid == ["src", "callee"]


@pytest.mark.parametrize("most", [0, 100_000])
def test_shortest_paths_hold_no_paths_in_hash_tables(spark, monkeypatch, most):
    """Random edges against brute force; no join lays paths out in hash tables of partitions, which can't be written to disk."""
    import random

    from evigraph.plans import iterate

    plans = []
    for name in ("cut", "counted_cut"):
        kept = getattr(iterate, name)
        monkeypatch.setattr(graph, name, lambda df, kept=kept: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    monkeypatch.setattr(graph, "MOST_BROADCAST", most)
    monkeypatch.setattr(iterate, "MOST_BROADCAST", most)
    draw = random.Random(4)
    pairs = [(f"n{draw.randrange(30)}", f"n{draw.randrange(30)}") for _ in range(60)]
    want = {}
    for source in ("n1", "n2", "n17"):
        seen, level = {source}, {source: (source,)}
        while level:
            reached = {}
            for node, path in level.items():
                for src, dst in pairs:
                    if src == node and dst not in seen:
                        reached[dst] = min(reached.get(dst, ("o",)), (*path, dst))
            level, seen = reached, seen | reached.keys()
            want |= {(source, node): path for node, path in level.items()}
    sources = spark.createDataFrame([("n1",), ("n2",), ("n17",), ("n1",)], "node string")
    found = [(r.source, r.node, r.hops, tuple(r.path)) for r in graph.shortest_paths(spark.createDataFrame(pairs, "src string, dst string"), sources).collect()]
    assert sorted(found) == sorted((*k, len(p) - 1, p) for k, p in want.items()) and max(r[2] for r in found) > 3
    with_paths = [p for p in plans if "path#" in p]
    assert not any("ShuffledHashJoin" in p for p in with_paths) and any("SortMergeJoin" in p for p in with_paths) == (most == 0)


@pytest.mark.parametrize("columns", [["src", "dst"], ["src", "dst", "kind"]])
def test_edges_send_no_uncounted_parts_through_the_driver(spark, monkeypatch, columns):
    """Without their kinds, parts look small enough to be broadcast at any size of the tables."""
    from evigraph import derive
    from evigraph.plans import iterate

    folder = "/root/testdata/sf0.001"
    few = derive.edges(spark, folder).select(*columns)
    monkeypatch.setattr(iterate, "MOST_BROADCAST", 0)
    many = derive.edges(spark, folder).select(*columns)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (few, many)]
    assert ["BroadcastHashJoin" in p for p in plans] == [True, False] and "ShuffledHashJoin" in plans[1]
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
