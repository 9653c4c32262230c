"""Graph operators over edge tables (src, dst, kind, target_kind).

Each round of a loop joins only the frontier with the edges, keeps one row for each node it reaches by partial
aggregation, and drops known nodes by an anti join. Edges are projected once to the two columns that the loop needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import NOT_RUNTIME
from ..plans.iterate import MOST_BROADCAST, any_rows, beside, counted_cut, cut, laid_out, shuffled, tidied, union_all

#: Rounds of few rows that read the steps as they are; a walk of more has them laid out.
SCANS = 2


def traversable(edges: DataFrame, kinds: tuple[str, ...] | None = None, without: tuple[str, ...] = NOT_RUNTIME) -> DataFrame:
    """(src, dst) of edges whose target is a node, of the given kinds (or all but some), as often as they are there."""
    keep = F.col("kind").isin(*kinds) if kinds else ~F.col("kind").isin(*without)
    if "target_kind" in edges.columns:
        keep = keep & (F.col("target_kind") == "node")
    return edges.filter(keep).select("src", "dst")


@tidied
def expand(seeds: DataFrame, steps: DataFrame, keys: list[str], carried: list[str], most_rounds: int | None = None) -> DataFrame:
    """Breadth-first expansion: rows (keys..., node, distance, carried...) with the least distance, then the least ``carried``.

    ``seeds``: (keys..., node, carried...) at distance 0. ``steps``: (src, dst), equal ones as one. Steps are laid out only for walks
    that read them often: a few rows are sent to all tasks, and a last round shuffles once.
    """
    columns = [*keys, "node", "distance", *carried]

    def least(rows: DataFrame) -> DataFrame:
        if not carried:
            return rows.groupBy(*keys, "node").agg(F.min("distance").alias("distance")).select(*columns)
        best = F.min(F.struct("distance", *carried)).alias("best")
        return rows.groupBy(*keys, "node").agg(best).select(*keys, "node", "best.*").select(*columns)

    def nearest(rows: DataFrame) -> DataFrame:
        """``least`` of rows at one distance: a single carried column is then a plain minimum, which needs no sort."""
        if len(carried) != 1:
            return least(rows)
        return rows.groupBy(*keys, "node").agg(F.first("distance").alias("distance"), F.min(carried[0]).alias(carried[0])).select(*columns)

    steps, laid = steps.select("src", "dst"), False
    frontier, new = counted_cut(least(seeds.withColumn("distance", F.lit(0))))
    levels, seen, total, done = [frontier], frontier.select(*keys, "node"), new, 0
    while new and (most_rounds is None or done < most_rounds):
        done += 1
        if not laid and done != most_rounds and (new > MOST_BROADCAST or done > SCANS):
            steps, laid = laid_out(steps, "src", distinct=False), True
        reached = beside(frontier, new).join(steps, frontier["node"] == steps["src"]).select(*keys, F.col("dst").alias("node"), F.lit(done).alias("distance"), *carried)
        frontier, new = counted_cut(nearest(reached).join(shuffled(seen) if total > MOST_BROADCAST else seen, [*keys, "node"], "left_anti").select(*columns))
        if new:
            levels.append(frontier)
            seen, total = seen.union(frontier.select(*keys, "node")), total + new
    return union_all(levels)


def runtime_steps(edges: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(src, dst) that runtime reachability follows; a symbol (node, file) also reaches its file."""
    steps = traversable(edges)
    return steps if symbols is None else steps.union(symbols.select(F.col("node").alias("src"), F.col("file").alias("dst")))


def reachability(edges: DataFrame, contexts: DataFrame, roots: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(context, node, distance, root_index, root): one witness root for each context and node it reaches.

    ``contexts``: (context, scope); ``roots``: (context, node); ``symbols``: (node, file). A root's index is the rank of its id in
    its context. A public surface starts from all that re-exports lead to, at distance 0; the witness is the least
    (distance, index).
    """
    ranked = roots.select("context", "node").distinct().withColumn("root_index", F.row_number().over(Window.partitionBy("context").orderBy("node")) - 1)
    scoped = cut(ranked.join(contexts.select("context", "scope"), "context"))
    public = scoped.filter(F.col("scope") == "public_surface").select("context", "node", "root_index")
    surface = expand(public.select("context", "root_index", "node"), traversable(edges, ("re_export",)), ["context", "root_index"], [])
    seeds = scoped.filter(F.col("scope") != "public_surface").select("context", "node", "root_index").unionByName(surface.select("context", "node", "root_index"))
    found = expand(seeds, runtime_steps(edges, symbols), ["context"], ["root_index"])
    return found.join(scoped.select("context", "root_index", F.col("node").alias("root")), ["context", "root_index"]).select("context", "node", "distance", "root_index", "root")


def roles(reached: DataFrame, contexts: DataFrame) -> DataFrame:
    """(node, contexts, roles): how many contexts reach a node, and the sorted roles of those."""
    named = reached.select("context", "node").join(contexts.select("context", "role"), "context")
    return named.groupBy("node").agg(F.countDistinct("context").alias("contexts"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def reach_targets(edges: DataFrame, roots: DataFrame, targets: DataFrame, contexts: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """(context, target, distance, root_index, root): the same answers for some targets, by walking edges backwards from them.

    With ``contexts`` (context, scope), a context that shows a public surface is answered too: its roots are then all that
    re-exports lead to, which the walk forwards from them gives; they are met by the walk backwards like any other root.
    """
    ranked = roots.select("context", "node").distinct().withColumn("root_index", F.row_number().over(Window.partitionBy("context").orderBy("node")) - 1)
    starts = ranked.select("context", "root_index", "node", F.col("node").alias("root"))
    if contexts is not None:
        scoped = cut(ranked.join(contexts.select("context", "scope"), "context"))
        public = scoped.filter(F.col("scope") == "public_surface").select("context", "root_index", "node")
        surface = expand(public, traversable(edges, ("re_export",)), ["context", "root_index"], []).select("context", "root_index", "node")
        named = scoped.select("context", "root_index", F.col("node").alias("root"))
        plain = scoped.filter(F.col("scope") != "public_surface").select("context", "root_index", "node")
        starts = surface.unionByName(plain).join(named, ["context", "root_index"]).select("context", "root_index", "node", "root")
    back = runtime_steps(edges, symbols).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    met = expand(targets.select(F.col("node").alias("target"), "node"), back, ["target"], []).join(starts, "node")
    best = met.groupBy("context", "target").agg(F.min(F.struct("distance", "root_index", "root")).alias("b"))
    return best.select("context", "target", F.col("b.distance").alias("distance"), F.col("b.root_index").alias("root_index"), F.col("b.root").alias("root"))


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """(node, distance): nodes within ``depth`` (at most 16) steps; self edges are not followed."""
    if not 0 <= depth <= 16:
        raise ValueError("depth must be between 0 and 16")
    plain, there, back = edges.filter(F.col("src") != F.col("dst")), F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ways = {"outgoing": [there], "incoming": [back], "both": [there, back]}[direction]
    steps = plain.select(F.inline(F.array(*ways)))  # edges are read once for both ways
    return expand(roots.select("node"), steps, [], [], depth)


def induced(edges: DataFrame, slice_nodes: DataFrame, page_nodes: DataFrame) -> DataFrame:
    """Edges with both ends in the slice, owned by the page that holds their source."""
    inside = edges.filter(F.col("src") != F.col("dst"))
    owned = inside.join(page_nodes.select(F.col("node").alias("src")), "src", "left_semi")
    return owned.join(slice_nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(*edges.columns)


def closure(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(src, dst, hops): every pair joined by a path of one edge at least, with its least length. Cycles are pairs of equal ends."""
    steps = edges.select("src", "dst").distinct()
    first = cut(steps.select("src", "dst", F.lit(1).alias("hops")))
    levels, frontier, seen, hops = [first], first, first.select("src", "dst"), 1
    while most_rounds is None or hops < most_rounds:
        hops += 1
        reached = frontier.alias("f").join(steps.alias("s"), F.col("f.dst") == F.col("s.src")).select(F.col("f.src").alias("src"), F.col("s.dst").alias("dst")).distinct()
        frontier = cut(reached.join(seen, ["src", "dst"], "left_anti").withColumn("hops", F.lit(hops)))
        if not any_rows(frontier):
            break
        levels.append(frontier)
        seen = seen.union(frontier.select("src", "dst"))
    return union_all(levels)


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(node): nodes that reach themselves."""
    return closure(edges).filter(F.col("src") == F.col("dst")).select(F.col("src").alias("node"))


def shortest_paths(edges: DataFrame, sources: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(source, node, hops, path): the shortest path, and among those the first in the order of its nodes. A source has none to itself.

    The paths of a round are numbered in their order, and steps carry numbers: the least number that reaches a node is its first
    path. All are of one length, so their order is that of the numbers they come from, then of their last nodes: paths are never
    compared. Each is written out once, from the one it comes from; unless these are few, both meet in a merge, which may spill.
    """

    def numbered(rows: DataFrame) -> DataFrame:
        return cut(rows.orderBy("before", "node").select("source", "node", "before", F.monotonically_increasing_id().alias("at")))

    def reaching(rows: DataFrame, number: Column) -> DataFrame:
        return rows.select("source", "node", number.cast("long").alias("before"))

    steps = laid_out(edges.select("src", "dst").filter(F.col("src") != F.col("dst")), "src", distinct=False)
    starts, new = counted_cut(reaching(sources.select(F.col("node").alias("source"), "node").distinct(), F.lit(0)))
    frontier, levels, hops = numbered(starts), [], 0
    seen, paths = frontier.select("source", "node"), frontier.select("source", "node", "at", F.array("node").alias("path"))
    while new and (most_rounds is None or hops < most_rounds):
        hops += 1
        ends = beside(frontier.select("source", F.col("node").alias("end"), "at"), new)
        reached = reaching(ends.join(steps, ends["end"] == steps["src"]).withColumn("node", F.col("dst")), F.col("at"))
        known = reaching(seen, F.lit(-1))  # below every number, so that what was seen stays out
        way = paths.select(F.col("at").alias("before"), F.col("path").alias("way"))
        way = F.broadcast(way) if new <= MOST_BROADCAST else shuffled(way)
        found, new = counted_cut(reached.unionByName(known).groupBy("source", "node").agg(F.min("before").alias("before")).filter("before >= 0"))
        if new:
            frontier = numbered(found)
            paths = cut(frontier.join(way, "before").select("source", "node", "at", F.concat("way", F.array("node")).alias("path")))
            levels.append(paths.select("source", "node", F.lit(hops).alias("hops"), "path"))
            seen = seen.union(frontier.select("source", "node"))
    return union_all(levels) if levels else paths.select("source", "node", F.lit(0).alias("hops"), "path").limit(0)


def propagate_facts(seeds: DataFrame, calls: DataFrame) -> DataFrame:
    """(node, origin, kind, evidence, direct): facts flow from callee to caller until nothing is new, never back to their origin.

    ``seeds``: (node, kind, evidence); ``calls``: (src, dst). A propagated fact's evidence is inferred, unless its kind is
    unknown or it was boundary_limited. Calls are dealt by callee once; rounds shuffle facts only.
    """
    facts, new = counted_cut(seeds.select("node", F.col("node").alias("origin"), "kind", "evidence").distinct())
    callers = laid_out(calls.select(F.col("dst").alias("callee"), F.col("src").alias("caller")).filter(F.col("callee") != F.col("caller")), "callee", distinct=False)
    key, delta, known, total = ["node", "origin", "kind", "evidence"], facts, facts, new
    levels = [facts.withColumn("direct", F.lit(True))]
    while new:
        moved = beside(delta, new).join(callers, delta["node"] == callers["callee"]).filter(F.col("caller") != F.col("origin"))
        delta, new = counted_cut(moved.select(F.col("caller").alias("node"), "origin", "kind", "evidence").distinct().join(shuffled(known) if total > MOST_BROADCAST else known, key, "left_anti").select(*key))
        if new:
            levels.append(delta.withColumn("direct", F.lit(False)))
            known, total = known.union(delta), total + new
    kept = F.col("direct") | (F.col("evidence") == "boundary_limited")
    evidence = F.when(kept, F.col("evidence")).when(F.col("kind") == "unknown", F.lit("boundary_limited")).otherwise(F.lit("inferred"))
    return union_all(levels).withColumn("evidence", evidence)


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that is connected, for every end of an edge (src, dst)."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    state = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("component")))
    while True:
        heard = both.join(state, both["dst"] == state["node"]).groupBy("src").agg(F.min("component").alias("other"))
        lower = cut(state.join(heard, state["node"] == heard["src"]).select("node", F.least("component", "other").alias("component"), F.col("component").alias("before")))
        above = lower.select(F.col("node").alias("up"), F.col("component").alias("upper"))
        state = cut(lower.join(above, lower["component"] == above["up"]).select("node", F.col("upper").alias("component"), "before"))
        if not any_rows(state.filter(F.col("component") != F.col("before"))):
            return state.select("node", "component")


def quotient(edges: DataFrame, owners: DataFrame, weight: Column | None = None) -> DataFrame:
    """(src_owner, dst_owner, edges): edges between different owners. ``owners``: (node, owner)."""
    left = owners.select(F.col("node").alias("src"), F.col("owner").alias("src_owner"))
    right = owners.select(F.col("node").alias("dst"), F.col("owner").alias("dst_owner"))
    crossing = edges.join(left, "src").join(right, "dst").filter(F.col("src_owner") != F.col("dst_owner"))
    return crossing.groupBy("src_owner", "dst_owner").agg(F.count("*").alias("edges") if weight is None else F.sum(weight).alias("edges"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node, with the end that is missing."""
    known = nodes.select("node").distinct()
    parts = [edges.join(known.withColumnRenamed("node", end), end, "left_anti").select("src", "dst", "kind", F.lit(end).alias("missing")) for end in ("src", "dst")]
    return union_all(parts)
