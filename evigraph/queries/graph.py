"""Reachability, neighbourhoods, closures and findings over the derived graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import derive, ids
from ..derive import SQL, table
from ..functions import text
from ..operators import findings, graph, windows
from ..plans.iterate import cut

WITH = "WITH RECURSIVE " + SQL


def _reach(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachability(derive.edges(spark, d), derive.contexts(spark, d), derive.roots(spark, d), derive.symbols(spark, d))


def graph_dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    lost = table(spark, d, "part").filter("p_partkey % 50 = 0").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("node"))
    known = derive.nodes(spark, d).join(lost, "node", "left_anti")
    return graph.dangling(derive.edges(spark, d).distinct(), known).groupBy("kind", "missing").agg(F.count("*").alias("n_edges"))


def reach_region_witness(spark: SparkSession, d: str) -> DataFrame:
    return _reach(spark, d).select("context", "node", F.col("distance").cast("long").alias("distance"), F.col("root_index").cast("long").alias("root_index"), "root")


def reach_roles(spark: SparkSession, d: str) -> DataFrame:
    return graph.roles(_reach(spark, d), derive.contexts(spark, d))


def reach_targets_supplier(spark: SparkSession, d: str) -> DataFrame:
    targets = derive.nodes(spark, d).filter("kind = 'supplier' AND node LIKE '%7'").select("node")
    found = graph.reach_targets(derive.edges(spark, d), derive.roots(spark, d), targets, derive.contexts(spark, d), derive.symbols(spark, d))
    return found.select("context", "target", F.col("distance").cast("long").alias("distance"), F.col("root_index").cast("long").alias("root_index"), "root")


def unreachable_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = derive.nodes(spark, d).filter("kind = 'part'").select("node", "project")
    return parts.join(_reach(spark, d).select("node").distinct(), "node", "left_anti")


def public_dependency_closure(spark: SparkSession, d: str) -> DataFrame:
    public = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("node"))
    found = graph.expand(public, graph.traversable(derive.edges(spark, d)), [], [])
    return found.groupBy(F.element_at(F.split("node", "/"), 1).alias("kind"), F.col("distance").cast("long").alias("distance")).agg(F.count("*").alias("n_nodes"))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of files and symbols, and of all that a run needs: who is reached, how surely, and what public symbols lead to."""
    edges, symbols, roots = derive.edges(spark, d), derive.symbols(spark, d), derive.roots(spark, d)
    known = cut(derive.nodes(spark, d).filter("kind IN ('part', 'supplier', 'customer', 'order')"))
    files = known.filter("kind <> 'order'")
    roles = cut(graph.roles(_reach(spark, d), derive.contexts(spark, d)))
    confidence = cut(findings.node_confidence(known.select("node", "project", "file", "language"), derive.projects(spark, d), derive.boundaries(spark, d)))
    needed = findings.public_dependencies(symbols, edges)
    of_files = findings.reach_findings(files, roles, roots, confidence, needed)
    of_symbols = findings.symbol_findings(symbols, roles, roots, findings.unreported_files(files, roles), confidence, needed)
    return findings.reported(of_files.unionByName(of_symbols))


def check_code_findings(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).select("kind", "node", "confidence", "evidence", "gates", F.col("kind_ord").cast("long").alias("kind_ord"))


def check_code_summary(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).groupBy("kind", "confidence").agg(F.count("*").alias("n_findings"), F.sum(F.col("gates").cast("long")).alias("n_gates"))


def localized_confidence(spark: SparkSession, d: str) -> DataFrame:
    known = derive.nodes(spark, d).filter("kind IN ('part', 'supplier', 'customer', 'order')").select("node", "project", "file", "language")
    return findings.node_confidence(known, derive.projects(spark, d), derive.boundaries(spark, d))


def needed_by_public(spark: SparkSession, d: str) -> DataFrame:
    return findings.public_dependencies(derive.symbols(spark, d), derive.edges(spark, d)).distinct()


def project_completeness(spark: SparkSession, d: str) -> DataFrame:
    return findings.worst_completeness(derive.projects(spark, d), derive.boundaries(spark, d))


def _hood(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbourhood(derive.edges(spark, d), spark.createDataFrame([("nation/3",)], "node string"), 2)


def khop_both_page(spark: SparkSession, d: str) -> DataFrame:
    page = windows.page(_hood(spark, d), ["distance", "node"], offset=20, size=50)
    return page.select("node", F.col("distance").cast("long").alias("distance"), "place", "remaining", ids.cursor(F.col("distance"), F.col("node")).alias("cursor"))


def khop_induced_edges(spark: SparkSession, d: str) -> DataFrame:
    hood = cut(_hood(spark, d))
    page = cut(windows.page(hood, ["distance", "node"], offset=0, size=40))
    return graph.induced(derive.edges(spark, d), hood, page).distinct().groupBy("kind").agg(F.count("*").alias("n_edges"))


def _transitions(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = table(spark, d, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst"))
    return pairs.filter("dst IS NOT NULL").distinct()


def event_cycle_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(_transitions(spark, d)).select("src", "dst", F.col("hops").cast("long").alias("hops"))


def conversation_chain_depth(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    node = F.concat_ws("/", "conv_id", "turn")
    links = turns.select(node.alias("src"), F.concat_ws("/", "conv_id", F.col("turn") + 1).alias("dst"))
    links = links.join(turns.select(node.alias("dst")), "dst", "left_semi").select("src", "dst")
    heads = turns.groupBy("conv_id").agg(F.min("turn").alias("turn")).select("conv_id", node.alias("node"))
    found = graph.expand(heads, links, ["conv_id"], [])
    return found.groupBy("conv_id").agg(F.max("distance").cast("long").alias("depth"), F.count("*").alias("n_turns"))


def components_shared_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = F.explode(F.array_distinct(text.tokens(F.col("p_name")))).alias("term")
    parts = table(spark, d, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("src"), terms)
    links = parts.select("src", F.concat_ws("/", F.lit("term"), "term").alias("dst"))
    return graph.connected(links).groupBy("component").agg(F.count("*").alias("n_nodes"))


def quotient_region_deps(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    where = nation.select(F.col("n_nationkey").alias("k"), F.concat(F.lit("region/"), F.col("n_regionkey").cast("string")).alias("owner"))
    orders = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k")), "o_custkey").join(where, "k")
    owners = orders.select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("node"), "owner")
    suppliers = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "k").join(where, "k").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("node"), "owner")
    return graph.quotient(derive.edges(spark, d).distinct(), owners.unionByName(suppliers))


def shortest_path_regions(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "region").select(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("node"))
    found = graph.shortest_paths(derive.edges(spark, d), sources)
    return found.select("source", "node", F.col("hops").cast("long").alias("hops"), F.array_join("path", " ").alias("path"))


def effect_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    bad = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("node"), F.when(F.col("s_acctbal") < -800, "unknown").otherwise("writes").alias("kind"), F.lit("direct").alias("evidence"))
    found = graph.propagate_facts(bad, graph.traversable(derive.edges(spark, d)))
    return found.groupBy("node", "kind", "evidence").agg(F.countDistinct("origin").alias("n_origins"))


QUERIES = {
    f.__name__: f
    for f in (graph_dangling_edges, reach_region_witness, reach_roles, reach_targets_supplier, unreachable_parts, public_dependency_closure, check_code_findings, check_code_summary, localized_confidence, needed_by_public,
              project_completeness, khop_both_page, khop_induced_edges, event_cycle_closure, conversation_chain_depth, components_shared_terms, quotient_region_deps, shortest_path_regions, effect_fixpoint)
}

_FINDINGS = """, met AS (
  SELECT s.node, s.file, s.is_file, roles.roles, c, s.node IN (SELECT node FROM needed) AS needed, s.node IN (SELECT node FROM roots) AS is_root, visibility
  FROM subjects s LEFT JOIN roles USING (node) LEFT JOIN confidence USING (node) LEFT JOIN symbols USING (node)
), kinds AS (
  SELECT node, CASE WHEN roles IS NOT NULL THEN CASE WHEN roles NOT LIKE '%production%' AND NOT is_root THEN CASE roles WHEN 'test' THEN 'test_only' ELSE 'tooling_only' END END
    WHEN is_file THEN 'unreachable_file' WHEN visibility IN ('private', 'internal') THEN 'unused_private_symbol' WHEN visibility = 'public' THEN 'unreferenced_public' END AS kind,
    CASE WHEN needed OR coalesce(visibility = 'public', false) THEN greatest(c, 1) ELSE c END AS c
  FROM met WHERE is_file OR file IN (SELECT node FROM roles WHERE roles LIKE '%production%')
), report AS (
  SELECT kind, node, ['high', 'medium', 'low'][1 + c] AS confidence, CASE WHEN c > 0 OR kind = 'unreferenced_public' THEN 'boundary_limited' ELSE 'inferred' END AS evidence,
    kind IN ('unreachable_file', 'unused_private_symbol') AND c = 0 AS gates,
    list_position(['unreachable_file', 'unused_private_symbol', 'test_only', 'tooling_only', 'unreferenced_public'], kind)::BIGINT - 1 AS kind_ord FROM kinds WHERE kind IS NOT NULL
)"""

_HOOD = """, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges
), hood_walk AS (
  SELECT 'nation/3' AS node, 0 AS distance UNION SELECT dst, distance + 1 FROM hood_walk JOIN both_ways ON node = src WHERE distance < 2 AND src <> dst
), hood AS (SELECT node, CAST(min(distance) AS BIGINT) AS distance FROM hood_walk GROUP BY node
), placed AS (SELECT node, distance, row_number() OVER (ORDER BY distance, node) AS place, count(*) OVER () AS total FROM hood
)"""

ORACLE_SQL = {
    "graph_dangling_edges": WITH + """, known AS (SELECT node FROM nodes WHERE node NOT IN (SELECT 'part/' || p_partkey FROM part WHERE p_partkey % 50 = 0)
), e AS (SELECT DISTINCT * FROM edges)
SELECT kind, 'src' AS missing, count(*) AS n_edges FROM e WHERE src NOT IN (SELECT node FROM known) GROUP BY kind
UNION ALL SELECT kind, 'dst', count(*) FROM e WHERE dst NOT IN (SELECT node FROM known) GROUP BY kind""",
    "reach_region_witness": WITH + " SELECT context, node, CAST(distance AS BIGINT) AS distance, root_index, root FROM reach",
    "reach_roles": WITH + " SELECT * FROM roles",
    "reach_targets_supplier": WITH + """ SELECT context, node AS target, CAST(distance AS BIGINT) AS distance, root_index, root FROM reach
WHERE node LIKE 'supplier/%7'""",
    "localized_confidence": WITH + " SELECT node, ['high', 'medium', 'low'][1 + c] AS confidence FROM confidence",
    "needed_by_public": WITH + " SELECT node FROM needed",
    "unreachable_parts": WITH + " SELECT node, project FROM nodes WHERE kind = 'part' AND node NOT IN (SELECT node FROM reach)",
    "public_dependency_closure": WITH + """, public_walk AS (
  SELECT 'customer/' || c_custkey AS node, 0 AS distance FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION SELECT dst, distance + 1 FROM public_walk JOIN edges ON node = src WHERE kind NOT IN ('contains', 're_export')
), least_walk AS (SELECT node, min(distance) AS distance FROM public_walk GROUP BY node)
SELECT split_part(node, '/', 1) AS kind, CAST(distance AS BIGINT) AS distance, count(*) AS n_nodes FROM least_walk GROUP BY ALL""",
    "check_code_findings": WITH + _FINDINGS + " SELECT * FROM report",
    "check_code_summary": WITH + _FINDINGS + " SELECT kind, confidence, count(*) AS n_findings, CAST(sum(gates::INT) AS BIGINT) AS n_gates FROM report GROUP BY kind, confidence",
    "project_completeness": WITH + """, every AS (SELECT project, o FROM projects UNION ALL SELECT project, o FROM boundaries)
SELECT project, ['complete', 'partial', 'unsupported'][1 + max(o)] AS completeness FROM every GROUP BY project""",
    "khop_both_page": WITH + _HOOD + """ SELECT node, distance, place, greatest(total - 70, 0) AS remaining,
  rtrim(translate(to_base64(encode(distance || '|' || node)), '+/', '-_'), '=') AS cursor FROM placed WHERE place > 20 AND place <= 70""",
    "khop_induced_edges": WITH + _HOOD + """ SELECT kind, count(*) AS n_edges FROM (SELECT DISTINCT * FROM edges)
WHERE src <> dst AND src IN (SELECT node FROM placed WHERE place <= 40) AND dst IN (SELECT node FROM hood) GROUP BY kind""",
    "event_cycle_closure": """WITH RECURSIVE p AS (
  SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events
), e AS (SELECT DISTINCT src, dst FROM p WHERE dst IS NOT NULL
), w AS (SELECT src, dst, 1 AS hops FROM e UNION SELECT w.src, e.dst, hops + 1 FROM w JOIN e ON w.dst = e.src WHERE hops < 30)
SELECT src, dst, CAST(min(hops) AS BIGINT) AS hops FROM w GROUP BY src, dst""",
    "conversation_chain_depth": """WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations
), w AS (
  SELECT conv_id, min(turn) AS turn, 0 AS depth FROM t GROUP BY conv_id UNION SELECT t.conv_id, t.turn, depth + 1 FROM w JOIN t ON t.conv_id = w.conv_id AND t.turn = w.turn + 1
) SELECT conv_id, CAST(max(depth) AS BIGINT) AS depth, count(*) AS n_turns FROM w GROUP BY conv_id""",
    "quotient_region_deps": """WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT 'region/' || a.n_regionkey AS src_owner, 'region/' || b.n_regionkey AS dst_owner, count(*) AS edges
FROM l JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = c_nationkey
JOIN supplier ON s_suppkey = l_suppkey JOIN nation b ON b.n_nationkey = s_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY ALL""",
    "effect_fixpoint": WITH + """, fact AS (
  SELECT 'supplier/' || s_suppkey AS node, 'supplier/' || s_suppkey AS origin, CASE WHEN s_acctbal < -800 THEN 'unknown' ELSE 'writes' END AS kind, true AS direct FROM supplier WHERE s_acctbal < 0
  UNION SELECT src, origin, fact.kind, false FROM fact JOIN edges ON node = dst WHERE edges.kind NOT IN ('contains', 're_export') AND src <> origin)
SELECT node, kind, CASE WHEN direct THEN 'direct' WHEN kind = 'unknown' THEN 'boundary_limited' ELSE 'inferred' END AS evidence, count(DISTINCT origin) AS n_origins FROM fact GROUP BY ALL""",
}
