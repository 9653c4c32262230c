"""Orders, cycles, paths, conformance and pages against plain versions."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from evigraph.operators import graph, inspection, order, sources


def random_edges(seed, nodes=14, count=22):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(nodes):02}", f"n{rng.randrange(nodes):02}") for _ in range(count)})


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def plain_reach(edges):
    reach = {}
    for start in {x for e in edges for x in e}:
        seen, queue = set(), deque([start])
        while queue:
            at = queue.popleft()
            for a, b in edges:
                if a == at and b not in seen:
                    seen.add(b)
                    queue.append(b)
        reach[start] = seen
    return reach


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strong_components_and_cycles(spark, seed):
    edges = random_edges(seed)
    reach = plain_reach(edges)
    want = {(n, min(m for m in reach[n] | {n} if n in reach[m])) for n in reach if n in reach[n]}
    assert {tuple(r) for r in order.strong_components(frame(spark, edges)).select("node", "component").collect()} == want
    paths = {}
    for r in order.cycle_hops(frame(spark, edges)).orderBy("component", "hop").collect():
        paths.setdefault(r.component, []).append((r.src, r.dst))
    assert paths.keys() == {c for _, c in want}
    for component, hops in paths.items():
        assert hops[0][0] == hops[-1][1] == component and all(h in edges for h in hops) and all(a[1] == b[0] for a, b in zip(hops, hops[1:]))
        assert len(hops) == shortest_cycle(edges, component)


def shortest_cycle(edges, start):
    level, n = {start}, 0
    while True:
        level, n = {b for a, b in edges if a in level}, n + 1
        if start in level:
            return n


def first_path(edges, start, goal):
    """Breadth first, neighbours in order: the path by the parents found first."""
    parent, queue = {start: None}, deque([start])
    while queue:
        at = queue.popleft()
        for a, b in sorted(edges):
            if a == at and b not in parent:
                parent[b] = at
                queue.append(b)
    if goal not in parent or goal == start:
        return []
    path = [goal]
    while parent[path[-1]] is not None:
        path.append(parent[path[-1]])
    return list(zip(path[::-1], path[::-1][1:]))


def test_paths_are_those_found_first(spark):
    edges = random_edges(5, 16, 40)
    asked = [(f"{a}>{b}", f"n{a:02}", f"n{b:02}") for a in range(6) for b in range(16)]
    want = {(k, i + 1, *hop) for k, a, b in asked for i, hop in enumerate(first_path(edges, a, b))}
    assert {tuple(r) for r in order.path_hops(spark.createDataFrame(asked, "key string, start string, goal string"), frame(spark, edges)).collect()} == want


def test_layers_and_problems(spark):
    depends = [("b", "a"), ("c", "b"), ("c", "a"), ("d", "d"), ("e", "f"), ("f", "e"), ("g", "e"), ("g", "a"), ("h", "lost"), ("c", "b")]
    nodes, rows = spark.createDataFrame([(n,) for n in "abcdefgh"], "node string"), spark.createDataFrame(depends, "node string, dependency string")
    assert {r.node: r.layer for r in order.layers(nodes, rows).collect()} == {"a": 0, "h": 0, "b": 1, "c": 2, "d": None, "e": None, "f": None, "g": None}
    assert {tuple(r) for r in order.dependency_problems(nodes, rows).collect()} == {("d", "d", "itself"), ("h", "lost", "unknown"), ("c", "b", "repeated")}


def test_declared_constraints_against_sources(spark):
    edges = [
        ("p1", "q1", "module_dependency", "node", "b.ts"), ("p2", "q1", "require", "node", "a.ts"), ("p1", "p2", "module_dependency", "node", "a.ts"), ("q1", "r1", "dynamic_import", "node", "c.ts"), ("t1", "s1", "module_dependency", "node", "t.ts"),
        ("p1", "s1", "import", "node", "x.ts"), ("p1", "@x/q/y", "module_dependency", "unexported_workspace", "u.ts"), ("q1", "q", "import", "unexported_workspace", "v.ts"), ("t1", "q1", "workspace_source_bypass", "node", "w.ts"), ("t1", "q1", "require", "node", "w.ts"),
        ("p1", "r1", "workspace_source_bypass", "node", "z.ts"), ("p1", "o1", "workspace_source_bypass", "node", "z.ts"),
    ]
    edges = spark.createDataFrame(edges, "src string, dst string, kind string, target_kind string, path string")
    nodes = spark.createDataFrame([("p1", "p"), ("p2", "p"), ("q1", "q"), ("r1", "r"), ("s1", "s"), ("t1", "t"), ("o1", "top")], "node string, project string")
    roles = spark.createDataFrame([("p1", "production"), ("p2", "production,test"), ("q1", "production"), ("t1", "test")], "node string, roles string")
    found = cut_rows(sources.workspace_dependencies(edges, nodes, roles))
    assert found == {("p", "q", "a.ts"), ("q", "r", "c.ts"), ("p", "r", "z.ts"), ("p", "top", "z.ts")}
    held = sources.workspace_dependencies(edges.filter("dst <> 'r1' OR kind <> 'workspace_source_bypass'"), nodes, roles)
    rules = [("c1", "no_path", "P", "R", "error"), ("c2", "forbids_relation", "P", "R", "error"), ("c3", "forbids_relation", "P", "Q", "advisory"), ("c4", "no_path", "R", "P", "error"), ("c5", "no_path", "P", "nowhere", "error"), ("c6", "must_reference", "P", "Q", "error")]
    states = sources.constraint_states(spark.createDataFrame(rules, "constraint string, rule string, subject string, object string, severity string"), spark.createDataFrame([("P", "p"), ("Q", "q"), ("R", "r")], "object string, package string"))
    assert {(r.constraint, r.state) for r in states.collect()} == {("c1", "evaluated"), ("c2", "evaluated"), ("c3", "evaluated"), ("c4", "evaluated"), ("c5", "skipped")}
    assert cut_rows(sources.forbidden_dependencies(states, held)) == {("c1", "error", 1, "p", "q", "a.ts"), ("c1", "error", 2, "q", "r", "c.ts"), ("c3", "advisory", 1, "p", "q", "a.ts")}
    projects = spark.createDataFrame([("p", "apps/p"), ("q", "apps/q"), ("top", ".")], "project string, root string")
    assert cut_rows(sources.intrinsic_findings(edges, nodes, projects, roles)) == {
        ("unexported_workspace_import", "error", "p", "@x/q", "u.ts"), ("workspace_source_bypass", "advisory", "t", "q", "w.ts"), ("workspace_source_bypass", "error", "p", "r", "z.ts"),
    }


def cut_rows(rows):
    return {tuple(r) for r in rows.collect()}


def test_pages_own_everything_once(spark):
    edges = [(a, b, "import", "node") for a, b in random_edges(8, 12, 30)] + [("n01", "ext", "import", "external"), ("n03", "lost", "import", "unresolved_internal"), ("zz", "ext", "import", "external")]
    edges = spark.createDataFrame(edges, "src string, dst string, kind string, target_kind string")
    hood = graph.neighbourhood(edges.filter("target_kind = 'node'"), spark.createDataFrame([("n01",)], "node string"), 2, "outgoing")
    contexts = spark.createDataFrame([(f"c{k % 3}", f"n{k:02}") for k in range(12)] + [("far", "zz")], "context string, node string")
    projects = spark.createDataFrame([(f"p{k % 4}", f"n{k:02}") for k in range(12)], "project string, node string")
    boundaries = spark.createDataFrame([("p1", None, "reflection"), ("p1", "n01", "dynamic_import"), ("none", None, "reflection")], "project string, node string, kind string")
    request = inspection.request_digest(["n01"], 2, "outgoing", 4)
    nodes, seen, after, pages = [], {"context": [], "project": [], "edge": [], "boundary": []}, None, 0
    total = hood.count()
    while True:
        page = inspection.page_nodes(hood, 4, after)
        nodes += [(r.distance, r.node) for r in page.orderBy("distance", "node").collect()]
        seen["context"] += [r.context for r in inspection.owned(hood, page, contexts, "context").filter("owned").collect()]
        of_projects = inspection.owned(hood, page, projects, "project")
        seen["project"] += [r.project for r in of_projects.filter("owned").collect()]
        seen["edge"] += [tuple(r)[:4] for r in inspection.owned_edges(hood, page, edges).filter("owned").collect()]
        seen["boundary"] += [tuple(r)[:3] for r in inspection.owned_boundaries(hood, page, boundaries, of_projects).filter("owned").collect()]
        row = inspection.continuation(hood, page, "g", request).first()
        pages += 1
        assert row.omitted_nodes == total - page.count()
        if row.continuation is None:
            break
        after = inspection.start_of(spark, row.continuation, "g", request)
        with pytest.raises(ValueError, match="another"):
            inspection.start_of(spark, row.continuation, "h", request)
        with pytest.raises(ValueError, match="another"):
            inspection.start_of(spark, row.continuation, "g", inspection.request_digest(["n01"], 3, "outgoing", 4))
    inside = {n for _, n in nodes}
    assert nodes == sorted(nodes) and len(nodes) == total and pages > 1
    assert sorted(seen["context"]) == sorted({c for c, n in ((r.context, r.node) for r in contexts.collect()) if n in inside}) and sorted(seen["project"]) == sorted({r.project for r in projects.collect() if r.node in inside})
    want = sorted(tuple(r) for r in edges.collect() if r.src in inside and (r.target_kind != "node" or (r.dst in inside and r.src != r.dst)))
    assert sorted(seen["edge"]) == want and sorted(seen["boundary"], key=str) == sorted([("p1", None, "reflection"), ("p1", "n01", "dynamic_import")], key=str)
