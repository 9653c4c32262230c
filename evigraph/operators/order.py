"""Orders, cycles and paths with their hops: what a dependency graph can be told by, without arrays of paths in a loop.

Paths are walked over distances. Distances to a goal are found backwards, by frontiers; from a start the least next node
whose distance is one less leads on, so every path is the first, by its nodes in turn, of the shortest ones. A round moves all paths one
hop at once and gives out that hop as a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import counted_cut, cut, laid_out, tidied, union_all
from . import graph


def dependency_problems(nodes: DataFrame, depends: DataFrame) -> DataFrame:
    """(node, dependency, problem): dependencies (node, dependency) of a node on itself, on an unknown one, or said twice."""
    known = nodes.select(F.col("node").alias("dependency")).distinct()
    itself = depends.filter(F.col("node") == F.col("dependency")).select("node", "dependency", F.lit("itself").alias("problem"))
    lost = depends.join(known, "dependency", "left_anti").select("node", "dependency", F.lit("unknown").alias("problem"))
    twice = depends.groupBy("node", "dependency").agg(F.count("*").alias("n")).filter("n > 1").select("node", "dependency", F.lit("repeated").alias("problem"))
    return union_all([itself.distinct(), lost.distinct(), twice])


@tidied
def layers(nodes: DataFrame, depends: DataFrame) -> DataFrame:
    """(node, layer): a node comes one layer after the last of its dependencies (node, dependency); in or behind a cycle it has none.

    A round takes the nodes without open dependencies and closes the edges to them; nodes and edges that are done are looked at no more.
    """
    left = cut(nodes.select("node").distinct())
    open_ = cut(depends.select("node", "dependency").join(left.select(F.col("node").alias("dependency")), "dependency", "left_semi").join(left, "node", "left_semi").select("node", "dependency").distinct())
    done, layer = [], 0
    while True:
        ready, n = counted_cut(left.join(open_.select("node").distinct(), "node", "left_anti").select("node"))
        if not n:
            return union_all([*done, left.select("node", F.lit(None).cast("int").alias("layer"))])
        done.append(ready.select("node", F.lit(layer).alias("layer")))
        left = cut(left.join(ready, "node", "left_anti"))
        open_ = cut(open_.join(ready.select(F.col("node").alias("dependency")), "dependency", "left_anti"))
        layer += 1


@tidied
def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that lies on a cycle of (src, dst); a component is named by its least node.

    Nodes that nothing leads to or from go first. Then the least node that reaches a node is its colour; what reaches that
    node backwards within its colour is its component. One component a colour is found a round, the rest goes on.
    """
    left, found = cut(edges.select("src", "dst").distinct()), []
    while True:
        left = _trimmed(left)
        colour, n = counted_cut(_least_above(left))
        if not n:
            return union_all(found) if found else colour.select("node", F.col("colour").alias("component"))
        inside = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").filter("a = b")
        back = inside.select(F.struct(F.col("a").alias("c"), F.col("dst").alias("n")).alias("src"), F.struct(F.col("a").alias("c"), F.col("src").alias("n")).alias("dst"))
        starts = colour.filter("node = colour").select(F.struct(F.col("colour").alias("c"), F.col("node").alias("n")).alias("node"))
        member = cut(graph.expand(starts, back, [], []).select(F.col("node.n").alias("node"), F.col("node.c").alias("component")))
        sizes = member.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
        loops = left.filter("src = dst").select(F.col("src").alias("component"))
        found.append(member.join(sizes.union(loops).distinct(), "component", "left_semi").select("node", "component"))
        gone = member.select("node")
        left = cut(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that edges lead both to and from, until none is left out."""
    left, n = counted_cut(edges)
    while True:
        kept, m = counted_cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if m == n:
            return kept
        left, n = kept, m


def _least_above(edges: DataFrame) -> DataFrame:
    """(node, colour): the least node that reaches a node, itself included; only what changed in a round speaks in the next."""
    steps = laid_out(edges, "src")
    state = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().select("node", F.col("node").alias("colour")))
    news = state
    while True:
        heard = news.join(steps, news["node"] == steps["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("heard"))
        state, _ = counted_cut(state.select("node", "colour").join(heard, "node", "left").select("node", F.least("colour", "heard").alias("colour"), (F.coalesce("heard", "colour") < F.col("colour")).alias("changed")))
        news, n = counted_cut(state.filter("changed").select("node", "colour"))
        if not n:
            return state.select("node", "colour")


@tidied
def path_hops(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, hop, src, dst): the first shortest path of each (key, start, goal) that has one, hop by hop from 1. No hops lead from a node to itself."""
    pairs = cut(asked.select("key", "start", "goal").filter("start <> goal").distinct())
    plain = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    back = plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    away = cut(graph.expand(pairs.select("goal", F.col("goal").alias("node")).distinct(), back, ["goal"], []).select("goal", "node", "distance"))
    at = pairs.join(away, (pairs["goal"] == away["goal"]) & (pairs["start"] == away["node"])).select("key", pairs["goal"], F.col("start").alias("src"), "distance")
    return _walked(at, plain, away)


def _walked(at: DataFrame, edges: DataFrame, away: DataFrame) -> DataFrame:
    """Hops of (key, goal, src, distance) to the goal, over nodes (goal, node, distance)."""
    steps, hops, hop = laid_out(edges, "src"), [], 0
    at, n = counted_cut(at)
    nearer = away.select(F.col("goal").alias("to"), F.col("node").alias("dst"), F.col("distance").alias("rest"))
    while True:
        hop += 1
        on = at.join(steps, "src").join(nearer, (F.col("goal") == F.col("to")) & (steps["dst"] == nearer["dst"]) & (F.col("rest") == F.col("distance") - 1)).groupBy("key", "goal", "src", "distance").agg(F.min(steps["dst"]).alias("dst"))
        made, n = counted_cut(on)
        hops.append(made.select("key", F.lit(hop).alias("hop"), "src", "dst"))
        if not n:
            return union_all(hops)
        at = made.select("key", "goal", F.col("dst").alias("src"), (F.col("distance") - 1).alias("distance")).filter("distance > 0")


@tidied
def cycle_hops(edges: DataFrame) -> DataFrame:
    """(component, hop, src, dst): for each strongly connected part the first shortest cycle through its least node."""
    member = cut(strong_components(edges))
    inside = edges.select("src", "dst").distinct().join(member.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(member.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst").filter("a = b")
    plain = cut(inside.select("src", "dst", F.col("a").alias("component")))
    loops = plain.filter("src = dst AND src = component").select("component", F.lit(1).alias("hop"), "src", "dst")
    proper = plain.filter("src <> dst")
    back = proper.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    away = cut(graph.expand(member.select(F.col("component").alias("goal"), F.col("component").alias("node")).distinct(), back, ["goal"], []).select("goal", "node", "distance"))
    out = proper.filter("src = component").join(away, (F.col("component") == F.col("goal")) & (F.col("dst") == F.col("node"))).join(loops.select("component"), "component", "left_anti")
    first = cut(out.groupBy("component").agg(F.min(F.struct("distance", "dst")).alias("b")).select("component", F.col("b.dst").alias("dst"), F.col("b.distance").alias("distance")))
    rest = _walked(first.select(F.col("component").alias("key"), F.col("component").alias("goal"), F.col("dst").alias("src"), "distance"), proper.select("src", "dst"), away)
    start = first.select("component", F.lit(1).alias("hop"), F.col("component").alias("src"), "dst")
    return union_all([loops, start, rest.select(F.col("key").alias("component"), (F.col("hop") + 1).alias("hop"), "src", "dst")])
