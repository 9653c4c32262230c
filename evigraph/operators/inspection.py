"""Pages of a graph's slice: nodes by distance and id, each page with what it owns, and how to go on.

A page begins after a key, the distance and id of the last node before it; so a page costs its own rows, however deep it lies.
The continuation says which graph and which request it belongs to, and goes with no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ids import cursor, digest, read_cursor
from ..plans.iterate import cut

MAX_NODES = 10_000


def request_digest(targets: list[str], depth: int, direction: str, size: int) -> Column:
    return digest(F.lit("\x1f".join(sorted(set(targets)))), F.lit(depth), F.lit(direction), F.lit(size), domain="inspection/1")


def start_of(spark: SparkSession, continuation: str | None, graph_digest: str, request: Column) -> tuple[int, str] | None:
    """The key that a continuation goes on after; one of another graph or request is refused."""
    if continuation is None:
        return None
    row = spark.range(1).select(read_cursor(F.lit(continuation)).alias("c"), request.alias("r")).first()
    if len(row.c) < 4 or row.c[:2] != [graph_digest, row.r]:
        raise ValueError("the continuation belongs to another graph or request")
    return int(row.c[2]), "|".join(row.c[3:])


def page_nodes(ordered: DataFrame, size: int, after: tuple[int, str] | None = None) -> DataFrame:
    """(node, distance): the first ``size`` nodes by distance and id after a key."""
    if not 1 <= size <= MAX_NODES:
        raise ValueError(f"a page holds 1 to {MAX_NODES} nodes")
    rest = ordered if after is None else ordered.filter((F.col("distance") > after[0]) | ((F.col("distance") == after[0]) & (F.col("node") > after[1])))
    return cut(rest.select("node", "distance").orderBy("distance", "node").limit(size))


def continuation(ordered: DataFrame, page: DataFrame, graph_digest: str, request: Column) -> DataFrame:
    """(continuation, omitted_nodes): null where nothing comes after the page; omitted are all nodes of the slice but the page's."""
    last = page.agg(F.max(F.struct("distance", "node")).alias("last"), F.count("*").alias("shown"))
    ends = ordered.agg(F.max(F.struct("distance", "node")).alias("end"), F.count("*").alias("all"))
    both = last.join(F.broadcast(ends))  # one row each
    more = F.col("end") > F.col("last")
    return both.select(F.when(more, cursor(F.lit(graph_digest), request, F.col("last.distance"), F.col("last.node"))).alias("continuation"), (F.col("all") - F.col("shown")).alias("omitted_nodes"))


def owned(ordered: DataFrame, page: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(key, members, owned): things (key, node) with a node in the slice, how many of their nodes lie there, and whether the page holds the first of those."""
    first = members.select(key, "node").distinct().join(ordered.select("node", "distance"), "node").groupBy(key).agg(F.count("*").alias("members"), F.min_by("node", F.struct("distance", "node")).alias("node"))
    return first.join(page.select("node", F.lit(True).alias("here")), "node", "left").select(key, "members", F.coalesce("here", F.lit(False)).alias("owned"))


def owned_edges(ordered: DataFrame, page: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, target_kind) of the slice with ``owned``: to another node of it, or to what is no node; the page of the source owns one."""
    inside = edges.join(ordered.select(F.col("node").alias("src")), "src", "left_semi")
    nodes = inside.filter("target_kind = 'node' AND src <> dst").join(ordered.select(F.col("node").alias("dst")), "dst", "left_semi").select(*edges.columns)
    every = nodes.unionByName(inside.filter("target_kind <> 'node'").select(*edges.columns))
    return every.join(page.select(F.col("node").alias("src"), F.lit(True).alias("here")), "src", "left").select(*edges.columns, F.coalesce("here", F.lit(False)).alias("owned"))


def owned_boundaries(ordered: DataFrame, page: DataFrame, boundaries: DataFrame, projects: DataFrame) -> DataFrame:
    """Boundaries (project, node, kind) of the slice with ``owned``: at a node by its page, of a project by the page that owns it (project, owned)."""
    at = boundaries.filter("node IS NOT NULL").join(ordered.select("node"), "node", "left_semi").join(page.select("node", F.lit(True).alias("here")), "node", "left").select("project", "node", "kind", F.coalesce("here", F.lit(False)).alias("owned"))
    wide = boundaries.filter("node IS NULL").join(projects.select("project", "owned"), "project").select("project", F.lit(None).cast(boundaries.schema["node"].dataType).alias("node"), "kind", "owned")
    return at.unionByName(wide)
