"""Orders, cycles, forbidden paths and pages over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import derive
from ..derive import table
from ..operators import graph, inspection, order, sources
from ..plans.iterate import cut
from .graph import WITH


def _page_folders(spark: SparkSession, d: str) -> DataFrame:
    """(node, parent): every prefix of a page's place and the one above it; blogs' hosts hang from their folders too."""
    place = F.concat_ws("/", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1), F.regexp_replace("url", r"^[a-z]+://[^/]*/?|[?#].*$|/$", ""))
    parts = F.split(F.regexp_replace(place, "/+$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("node"), F.when(n > 1, F.array_join(F.slice(parts, F.lit(1), n - 1), "/")).alias("parent")))
    return table(spark, d, "pages").select(F.explode(above).alias("x")).select("x.*").distinct()


def folder_layers(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(_page_folders(spark, d))
    down = rows.filter("parent IS NOT NULL").select("node", F.col("parent").alias("dependency"))
    up = rows.filter("parent LIKE 'blog.%' AND parent NOT LIKE '%/%'").select(F.col("parent").alias("node"), F.col("node").alias("dependency"))
    return order.layers(rows.select("node"), down.unionByName(up)).select("node", F.col("layer").cast("long").alias("layer"))


def _part_transitions(spark: SparkSession, d: str) -> DataFrame:
    """From the kind of an order's part to that of its next line: to later brands, or anywhere among small or large ones."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, "l_partkey")
    following = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = lines.select("p_brand", "p_type", F.lead("p_brand").over(following).alias("b"), F.lead("p_type").over(following).alias("t"))
    kept = pairs.filter("b IS NOT NULL").filter((F.col("p_brand") < F.col("b")) | ((F.col("p_type") == F.col("t")) & F.col("t").isin("SMALL", "LARGE") & (F.col("p_brand") != F.col("b"))))
    return kept.select(F.concat_ws("/", "p_brand", "p_type").alias("src"), F.concat_ws("/", "b", "t").alias("dst")).distinct()


def part_cycles(spark: SparkSession, d: str) -> DataFrame:
    return order.strong_components(_part_transitions(spark, d))


def part_cycle_paths(spark: SparkSession, d: str) -> DataFrame:
    return order.cycle_hops(_part_transitions(spark, d)).select("component", F.col("hop").cast("long").alias("hop"), "src", "dst")


def forbidden_paths(spark: SparkSession, d: str) -> DataFrame:
    """Nations depend on the next one and the fifth after them where lines lead from the one's suppliers to the other's; parts forbid some of the ways."""
    supplier = table(spark, d, "supplier").select(F.concat(F.lit("s/"), F.col("s_suppkey").cast("string")).alias("node"), F.concat(F.lit("nation/"), F.col("s_nationkey").cast("string")).alias("project"), "s_nationkey", "s_suppkey")
    lines = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 100).alias("t"))
    ends = lines.join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a")), "l_suppkey").join(supplier.select(F.col("s_suppkey").alias("t"), F.col("s_nationkey").alias("b")), "t")
    kind = F.when((F.col("b") - F.col("a")).isin(1, 5), "module_dependency").otherwise("import")
    edges = ends.select(F.concat(F.lit("s/"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("s/"), F.col("t").cast("string")).alias("dst"), kind.alias("kind"), F.lit("node").alias("target_kind"), F.concat_ws(".", F.col("l_suppkey").cast("string"), F.col("t").cast("string")).alias("path"))
    roles = supplier.select("node", F.lit("production").alias("roles"))
    found = cut(sources.workspace_dependencies(edges, supplier.select("node", "project"), roles))
    rule = F.when(F.col("p_partkey") % 3 == 0, "forbids_relation").when(F.col("p_partkey") % 3 == 1, "no_path").otherwise("must_reference_contract")
    rules = table(spark, d, "part").select(F.col("p_partkey").alias("constraint"), rule.alias("rule"), (F.col("p_size") % 25).cast("int").alias("subject"), F.floor(F.col("p_partkey") / 3 % 25).cast("int").alias("object"), F.lit("error").alias("severity"))
    bindings = table(spark, d, "nation").filter("n_nationkey < 24").select(F.col("n_nationkey").alias("object"), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("package"))
    return sources.forbidden_dependencies(sources.constraint_states(rules, bindings), found).select("constraint", F.col("hop").cast("long").alias("hop"), "src", "dst", "evidence")


def slice_page(spark: SparkSession, d: str) -> DataFrame:
    """What the second page of a nation's neighbourhood owns: contexts, projects, edges and boundaries, of how many in the slice."""
    edges = derive.edges(spark, d).withColumn("target_kind", F.lit("node"))
    hood = cut(graph.neighbourhood(edges, spark.createDataFrame([("nation/3",)], "node string"), 2))
    first = inspection.page_nodes(hood, 30).agg(F.max(F.struct("distance", "node")).alias("k")).first().k
    page = inspection.page_nodes(hood, 60, (first.distance, first.node))
    projects = inspection.owned(hood, page, derive.nodes(spark, d).select("project", "node"), "project")
    contexts = inspection.owned(hood, page, derive.roots(spark, d), "context")
    boundaries = inspection.owned_boundaries(hood, page, derive.boundaries(spark, d), projects)
    rows = [projects.select(F.lit("project").alias("thing"), "owned"), contexts.select(F.lit("context").alias("thing"), "owned"), inspection.owned_edges(hood, page, edges).distinct().select(F.lit("edge").alias("thing"), "owned"), boundaries.select(F.lit("boundary").alias("thing"), "owned")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("thing").agg(F.count("*").alias("in_slice"), F.sum(F.col("owned").cast("long")).alias("owned"))


QUERIES = {f.__name__: f for f in (folder_layers, part_cycles, part_cycle_paths, forbidden_paths, slice_page)}

_FOLDERS = r"""place AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^[a-z]+://([^/]*)', 1) || '/' || regexp_replace(url, '^[a-z]+://[^/]*/?|[?#].*$|/$', '', 'g'), '/+$', '') AS p FROM pages),
folders AS (SELECT DISTINCT array_to_string(string_split(p, '/')[:n], '/') AS node, n - 1 AS depth FROM place, unnest(range(1, len(string_split(p, '/')) + 1)) AS t(n))"""
_TRANSITIONS = """kinds AS (
  SELECT l_orderkey, p_brand, p_type, lead(p_brand) OVER w AS b, lead(p_type) OVER w AS t FROM lineitem JOIN part ON p_partkey = l_partkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)
), e AS (
  SELECT DISTINCT p_brand || '/' || p_type AS src, b || '/' || t AS dst FROM kinds WHERE b IS NOT NULL AND (p_brand < b OR p_type = t AND t IN ('SMALL', 'LARGE') AND p_brand <> b)
), reach AS (SELECT src, dst FROM e UNION SELECT reach.src, e.dst FROM reach JOIN e ON reach.dst = e.src
), strong AS (SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)"""

ORACLE_SQL = {
    "folder_layers": f"""
WITH {_FOLDERS}, cyclic AS (SELECT DISTINCT split_part(node, '/', 1) AS host FROM folders WHERE node LIKE 'blog.%' AND depth > 0)
SELECT node, CASE WHEN split_part(node, '/', 1) IN (SELECT host FROM cyclic) THEN NULL ELSE depth END::BIGINT AS layer FROM folders
""",
    "part_cycles": f"WITH RECURSIVE {_TRANSITIONS} SELECT node, component FROM strong",
    "part_cycle_paths": f"""
WITH RECURSIVE {_TRANSITIONS}, inner_ AS (SELECT e.* , a.component FROM e JOIN strong a ON a.node = e.src JOIN strong b ON b.node = e.dst WHERE a.component = b.component
), walk AS (
  SELECT component, dst, [component, dst] AS path FROM inner_ WHERE src = component
  UNION ALL SELECT walk.component, inner_.dst, list_append(path, inner_.dst) FROM walk JOIN inner_ ON inner_.src = walk.dst WHERE walk.dst <> walk.component AND len(path) < 4
), best AS (SELECT component, min(struct_pack(n := len(path), path := path)) AS b FROM walk WHERE dst = component GROUP BY component)
SELECT component, hop::BIGINT AS hop, b.path[hop] AS src, b.path[hop + 1] AS dst FROM best, unnest(range(1, b.n)) AS t(hop)
""",
    "forbidden_paths": """
WITH RECURSIVE dep AS (
  SELECT 'nation/' || a.s_nationkey AS src, 'nation/' || b.s_nationkey AS dst, min(a.s_suppkey || '.' || b.s_suppkey) AS evidence
  FROM lineitem JOIN supplier a ON a.s_suppkey = l_suppkey JOIN supplier b ON b.s_suppkey = l_partkey % 100 WHERE b.s_nationkey - a.s_nationkey IN (1, 5) GROUP BY ALL
), rules AS (
  SELECT p_partkey, p_partkey % 3 AS rule, 'nation/' || p_size % 25 AS start, 'nation/' || (p_partkey // 3) % 25 AS goal FROM part WHERE p_partkey % 3 < 2 AND p_size % 25 < 24 AND (p_partkey // 3) % 25 < 24
), walk AS (
  SELECT src AS start, dst AS node, [src, dst] AS path FROM dep UNION ALL SELECT walk.start, dst, list_append(path, dst) FROM walk JOIN dep ON src = node WHERE len(path) < 12
), best AS (SELECT start, node, min(struct_pack(n := len(path), path := path)) AS b FROM walk GROUP BY start, node
), hops AS (
  SELECT p_partkey, 1 AS hop, start AS src, goal AS dst FROM rules WHERE rule = 0
  UNION ALL SELECT p_partkey, hop, b.path[hop], b.path[hop + 1] FROM rules JOIN best ON best.start = rules.start AND best.node = rules.goal AND rules.start <> rules.goal, unnest(range(1, b.n)) AS t(hop) WHERE rule = 1
)
SELECT p_partkey AS "constraint", hop::BIGINT AS hop, src, dst, evidence FROM hops JOIN dep USING (src, dst)
""",
    "slice_page": WITH + """, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges
), hood_walk AS (SELECT 'nation/3' AS node, 0 AS distance UNION SELECT dst, distance + 1 FROM hood_walk JOIN both_ways ON node = src WHERE distance < 2 AND src <> dst
), hood AS (SELECT node, min(distance) AS distance FROM hood_walk GROUP BY node
), placed AS (SELECT node, row_number() OVER (ORDER BY distance, node) AS place FROM hood
), p AS (SELECT project, min(place) AS place FROM nodes JOIN placed USING (node) GROUP BY project
), things AS (
  SELECT 'project' AS thing, place FROM p UNION ALL SELECT 'context', min(place) FROM roots JOIN placed USING (node) GROUP BY context
  UNION ALL SELECT 'edge', a.place FROM (SELECT DISTINCT src, dst, kind FROM edges WHERE src <> dst) e JOIN placed a ON a.node = e.src JOIN placed b ON b.node = e.dst
  UNION ALL SELECT 'boundary', placed.place FROM boundaries JOIN placed USING (node) UNION ALL SELECT 'boundary', p.place FROM boundaries JOIN p USING (project) WHERE boundaries.node IS NULL
)
SELECT thing, count(*) AS in_slice, count(*) FILTER (place > 30 AND place <= 90)::BIGINT AS owned FROM things GROUP BY thing
""",
}
