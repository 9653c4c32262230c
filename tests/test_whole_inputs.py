"""Queries over all of their tables, against brute force: no subset of ids, no prefix of a text."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evigraph import catalog, derive
from evigraph.operators import conformance
from evigraph.queries import graph as graph_queries
from evigraph.queries import relations

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    def read(name, *columns):
        return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").select(*columns).collect()]

    return read


def got(spark, name, *columns):
    return Counter(tuple(r) for r in catalog.QUERIES[name](spark, FOLDER).select(*columns).collect())


def test_point_in_interval_over_all_lines(spark, rows):
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date"))
    lines = rows("lineitem", "l_orderkey", "l_linenumber", "l_suppkey", day, F.col("l_quantity").cast("int"))
    spans = defaultdict(list)
    for order, line, supplier, begin, quantity in lines:
        spans[supplier].append((begin, begin + quantity * 4, order, line))
    want = []
    for order, line, supplier, at in {x[:4] for x in lines}:
        held = [(end - begin, owner, owner_line) for begin, end, owner, owner_line in spans[supplier] if begin <= at <= end]
        want.append((order, line, *min(held)[1:]))  # a line's own interval holds it, so every point has one
    assert got(spark, "point_in_interval", "l_orderkey", "l_linenumber", "owner", "owner_line") == Counter(want)


def test_unique_match_join_over_all_parts(spark, rows):
    parts = rows("part", "p_partkey", "p_size", "p_brand", "p_type")
    want = []
    for k, size, brand, kind in parts:
        met = [o for o, s, b, t in parts if s == size and (k % 2 or b == brand) and (k % 5 >= 3 or t == kind)]
        want.append((k, len(met), "touch" if len(met) == 1 else "ambiguous", met[0] if len(met) == 1 else None))
    assert got(spark, "unique_match_join", "ref", "matches", "outcome", "p_partkey") == Counter(want)


def test_exception_asof_over_all_rules(spark, rows):
    suppliers = rows("supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    want, taken = [], set()
    for k, size in sorted(rows("part", "p_partkey", "p_size")):
        met = [(s, balance < 4000) for s, nation, balance in suppliers if s % 7 == k % 7 and nation == k % 25]
        for result, error in met or [(None, False)]:
            if k % 13 == 0:
                state = "rejected"
            elif k % 8 == 0:
                state = "expired"
            elif not error:
                state = "irrelevant"
            elif size <= 10:
                state = "stale"
            else:
                state = "irrelevant" if result in taken else "applied"
                taken.add(result)
            want.append((result, k, state))
    assert got(spark, "exception_asof", "result", "exception", "state") == Counter(want)


def events(spark, folder, sequences):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id"))
    flat = [(user, kind) for user, kinds in sequences.items() for kind in kinds]
    made = spark.createDataFrame([(i, user, kind) for i, (user, kind) in enumerate(flat)], "event_id long, user_id long, event_type string")
    made.withColumn("ts", at).write.parquet(f"{folder}/events.parquet")


def test_event_cycle_closure_over_all_users(spark, tmp_path):
    sequences = {3: "ab", 4: "bca", 5: "cd", 6: "ef"}  # the cycle a, b, c is made by users 3 and 4 together
    events(spark, tmp_path, sequences)
    steps = {pair for kinds in sequences.values() for pair in zip(kinds, kinds[1:])}
    want, hops, level = {}, 1, set(steps)
    while level:
        want |= {pair: hops for pair in level}
        level, hops = {(a, d) for a, b in level for c, d in steps if b == c} - want.keys(), hops + 1
    assert {(r.src, r.dst): r.hops for r in graph_queries.event_cycle_closure(spark, str(tmp_path)).collect()} == want
    assert want["a", "a"] == 3 and want["e", "f"] == 1


def test_components_over_shared_name_terms(spark, tmp_path):
    names = ["small ring", "ring bolt", "blue bolt", "red widget", "Red-Cog", "plain", "", None]
    names += ["blue"] * 20
    made = spark.createDataFrame(list(enumerate(names, 100)), "p_partkey long, p_name string")
    made.write.parquet(f"{tmp_path}/part.parquet")
    # parts 100 and 102 share no term and meet over 101; the least node names the component
    want = {("part/100", 23 + 4), ("part/103", 2 + 3), ("part/105", 1 + 1)}
    assert {tuple(r) for r in graph_queries.components_shared_terms(spark, str(tmp_path)).collect()} == want


def test_shortest_paths_over_all_edges(spark):
    steps = defaultdict(set)
    for src, dst, _ in derive.edges(spark, FOLDER).collect():
        steps[src].add(dst)
    want = {}
    for source in (f"region/{k}" for k in range(5)):
        seen, level = {source}, {source: (source,)}
        while level:
            reached = defaultdict(list)
            for node, path in level.items():
                for dst in steps[node] - seen:
                    reached[dst].append((*path, dst))
            level = {node: min(paths) for node, paths in reached.items()}
            seen |= level.keys()
            want |= {(source, node): (len(path) - 1, " ".join(path)) for node, path in level.items()}
    found = {(r.source, r.node): (r.hops, r.path) for r in graph_queries.shortest_path_regions(spark, FOLDER).collect()}
    assert found == want
    assert {"customer", "order", "part", "supplier"} <= {node.split("/")[0] for _, node in found}


def test_duplicate_scripts_compare_whole_texts(spark, rows, tmp_path):
    opening = "The same opening of forty letters and more"
    texts = [opening + " one", opening + " two", opening + " \n two", opening, "a  b", " a b\t", "", " "]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = relations.duplicate_scripts(spark, str(tmp_path)).select("command", "n_scripts").collect()
    assert {tuple(r) for r in found} == {(opening + " two", 2), ("a b", 2), ("", 2)}
    plain = Counter(re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ") for (t,) in rows("documents", "text"))
    assert got(spark, "duplicate_scripts", "command", "n_scripts") == Counter((t, n) for t, n in plain.items() if n > 1)


def test_exceptions_deal_large_groups(spark):
    """One group of 300 rules and 200 results in parts of 1,000 pairs: the same rows, from many tasks' keys; rules that meet nothing stay once."""
    rules = spark.range(300).selectExpr("id AS exception", "1 AS constraint", "cast(id % 2 AS int) AS version", "7 AS scope", "id % 5 > 0 AS approved", "if(id % 3 = 0, 'a', 'z') AS expires")
    rules = rules.unionByName(spark.createDataFrame([(900, None, 1, 7, True, "z"), (901, 1, 1, 8, True, "z")], "exception long, constraint int, version int, scope int, approved boolean, expires string"))
    results = spark.range(200).selectExpr("id AS result", "1 AS constraint", "1 AS version", "7 AS scope", "if(id % 4 = 0, 'error', 'advisory') AS severity")
    few, whole = (conformance.exceptions(results, rules, F.lit("m"), part=p) for p in (1_000, 10**9))
    assert Counter(map(tuple, few.collect())) == Counter(map(tuple, whole.collect())) and few.count() == 300 * 200 + 2
    assert few.filter("state = 'applied'").select("exception").distinct().collect() == [(1,)] and few.filter("state = 'applied'").count() == 50
