"""Evidence tables derived from the star schema: entities are files or symbols, foreign keys edges, regions contexts.

Customers, suppliers, parts, nations and regions are files; orders are symbols of their customer's file. Every line makes
two edges; those to large parts are containment, so some parts are reached by nobody.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.iterate import beside, union_all

#: Parts above this size are only contained in what refers to them.
LARGE = 40
SEGMENT_LANGUAGES = {"AUTOMOBILE": "rust", "BUILDING": "svelte", "FURNITURE": "python", "HOUSEHOLD": "javascript", "MACHINERY": "typescript"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind): containment of suppliers in nations is no reference; two regions re-export the next one.

    Parts are counted before they meet lines: a small file may hold more of them than the driver can send to all tasks.
    """

    def of(name: str, src: Column, dst: Column, kind: str, where: str = "true") -> DataFrame:
        return table(spark, sf_dir, name).filter(where).select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))

    next_region = F.concat(F.lit("region/"), ((F.col("r_regionkey") + 1) % 5).cast("string"))
    sized = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") > LARGE, "contains").otherwise("lexical_reference").alias("kind"))
    to_parts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(beside(sized, sized.count()), "l_partkey")
    return union_all(
        [
            of("nation", _id("region", "n_regionkey"), _id("nation", "n_nationkey"), "module_dependency"),
            of("customer", _id("nation", "c_nationkey"), _id("customer", "c_custkey"), "import"),
            of("orders", _id("customer", "o_custkey"), _id("order", "o_orderkey"), "import"),
            to_parts.select(_id("order", "l_orderkey").alias("src"), _id("part", "l_partkey").alias("dst"), "kind"),
            of("lineitem", _id("order", "l_orderkey"), _id("supplier", "l_suppkey"), "lexical_reference"),
            of("supplier", _id("nation", "s_nationkey"), _id("supplier", "s_suppkey"), "contains"),
            of("region", _id("region", "r_regionkey"), next_region, "re_export", "r_regionkey < 2"),
        ]
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, kind, project, file, language): customers, their orders and suppliers belong to their nation's project, all else to the entity's own kind."""

    def of(name: str, kind: str, key: str, project: Column, language: Column | None = None) -> DataFrame:
        node = _id(kind, key)
        return table(spark, sf_dir, name).select(node.alias("node"), F.lit(kind).alias("kind"), project.alias("project"), node.alias("file"), (F.lit(None).cast("string") if language is None else language).alias("language"))

    segment = F.element_at(F.create_map(*[F.lit(x) for kv in SEGMENT_LANGUAGES.items() for x in kv]), F.col("c_mktsegment"))
    customers = of("customer", "customer", "c_custkey", _id("nation", "c_nationkey"), segment)
    orders = table(spark, sf_dir, "orders").select(_id("order", "o_orderkey").alias("node"), _id("customer", "o_custkey").alias("file")).join(customers.select("file", "project", "language"), "file")
    return union_all(
        [
            of("region", "region", "r_regionkey", F.lit("world")),
            of("nation", "nation", "n_nationkey", F.lit("world")),
            customers,
            of("supplier", "supplier", "s_suppkey", _id("nation", "s_nationkey"), F.when(F.col("s_acctbal") > 5000, "rust").otherwise("typescript")),
            of("part", "part", "p_partkey", _id("brand", "p_brand")),
            orders.select("node", F.lit("order").alias("kind"), "project", "file", "language"),
        ]
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, file, visibility): orders, private when filled, public when open, else internal; unknown where their priority is low."""
    status = F.when(F.col("o_orderpriority") == "5-LOW", "unknown").when(F.col("o_orderstatus") == "F", "private").when(F.col("o_orderstatus") == "O", "public").otherwise("internal")
    return table(spark, sf_dir, "orders").select(_id("order", "o_orderkey").alias("node"), _id("customer", "o_custkey").alias("file"), status.alias("visibility"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(context, role, scope): one a region; regions 0 and 1 produce, 2 and 4 test, 3 is tooling; region 0 shows its surface."""
    key = F.col("r_regionkey")
    role = F.when(key < 2, "production").when(key == 3, "tooling").otherwise("test")
    return table(spark, sf_dir, "region").select(_id("context", "r_regionkey").alias("context"), role.alias("role"), F.when(key == 0, "public_surface").otherwise("runtime").alias("scope"))


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(context, node): each region but the last, and its nations whose key is a multiple of 5; the last region's other nations are reached by nobody."""
    own = table(spark, sf_dir, "region").filter("r_regionkey < 4").select(_id("context", "r_regionkey").alias("context"), _id("region", "r_regionkey").alias("node"))
    more = table(spark, sf_dir, "nation").filter("n_nationkey % 5 = 0").select(_id("context", "n_regionkey").alias("context"), _id("nation", "n_nationkey").alias("node"))
    return own.unionByName(more)


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, node, kind, effect): suppliers and customers in debt limit themselves, suppliers far in debt their whole project."""
    s = table(spark, sf_dir, "supplier").filter("s_acctbal < 0")
    far = F.col("s_acctbal") < -950
    of_suppliers = s.select(
        _id("nation", "s_nationkey").alias("project"), F.when(~far, _id("supplier", "s_suppkey")).alias("node"), F.when(far, "reflection").otherwise("dynamic_import").alias("kind"), F.when(far, "unsupported").otherwise("partial").alias("effect")
    )
    kind = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "macro_expansion").when(F.col("c_mktsegment") == "BUILDING", "reflection").otherwise("unsupported_syntax")
    of_customers = table(spark, sf_dir, "customer").filter("c_acctbal < -900").select(_id("nation", "c_nationkey").alias("project"), _id("customer", "c_custkey").alias("node"), kind.alias("kind"), F.lit("partial").alias("effect"))
    return of_suppliers.unionByName(of_customers)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, root, completeness, languages): nations, every fourth of them partial, and brands; the first nation lies at the workspace's root."""
    key = F.col("n_nationkey")
    languages = F.when(key % 3 == 1, F.array(F.lit("rust"))).otherwise(F.array(F.lit("rust"), F.lit("typescript")))
    brands = table(spark, sf_dir, "part").select(_id("brand", "p_brand").alias("project"), F.concat(F.lit("parts/"), F.col("p_brand")).alias("root"), F.lit("complete").alias("completeness"), F.array(F.lit("typescript")).alias("languages")).distinct()
    nations = table(spark, sf_dir, "nation").select(_id("nation", "n_nationkey").alias("project"), F.when(key == 0, ".").otherwise(F.concat(F.lit("apps/"), F.col("n_name"))).alias("root"), F.when(key % 4 == 3, "partial").otherwise("complete").alias("completeness"), languages.alias("languages"))
    return nations.unionByName(brands)


#: The same tables in SQL. Walks end after STEPS steps: no shortest one is longer, and symbols lead back to their files.
STEPS = 8
SQL = f"""edges AS (
  SELECT 'region/' || n_regionkey AS src, 'nation/' || n_nationkey AS dst, 'module_dependency' AS kind FROM nation
  UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey, 'import' FROM customer
  UNION ALL SELECT 'customer/' || o_custkey, 'order/' || o_orderkey, 'import' FROM orders
  UNION ALL SELECT 'order/' || l_orderkey, 'part/' || l_partkey, CASE WHEN p_size > {LARGE} THEN 'contains' ELSE 'lexical_reference' END FROM lineitem JOIN part ON p_partkey = l_partkey
  UNION ALL SELECT 'order/' || l_orderkey, 'supplier/' || l_suppkey, 'lexical_reference' FROM lineitem
  UNION ALL SELECT 'nation/' || s_nationkey, 'supplier/' || s_suppkey, 'contains' FROM supplier
  UNION ALL SELECT 'region/' || r_regionkey, 'region/' || (r_regionkey + 1) % 5, 're_export' FROM region WHERE r_regionkey < 2
), nodes AS (
  SELECT 'region/' || r_regionkey AS node, 'region' AS kind, 'world' AS project, 'region/' || r_regionkey AS file, NULL AS language FROM region
  UNION ALL SELECT 'nation/' || n_nationkey, 'nation', 'world', 'nation/' || n_nationkey, NULL FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, 'customer', 'nation/' || c_nationkey, 'customer/' || c_custkey,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'rust' WHEN 'BUILDING' THEN 'svelte' WHEN 'FURNITURE' THEN 'python' WHEN 'HOUSEHOLD' THEN 'javascript' WHEN 'MACHINERY' THEN 'typescript' END FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'supplier', 'nation/' || s_nationkey, 'supplier/' || s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'rust' ELSE 'typescript' END FROM supplier
  UNION ALL SELECT 'part/' || p_partkey, 'part', 'brand/' || p_brand, 'part/' || p_partkey, NULL FROM part
  UNION ALL SELECT 'order/' || o_orderkey, 'order', 'nation/' || c_nationkey, 'customer/' || c_custkey,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'rust' WHEN 'BUILDING' THEN 'svelte' WHEN 'FURNITURE' THEN 'python' WHEN 'HOUSEHOLD' THEN 'javascript' WHEN 'MACHINERY' THEN 'typescript' END
    FROM orders JOIN customer ON c_custkey = o_custkey
), symbols AS (
  SELECT 'order/' || o_orderkey AS node, 'customer/' || o_custkey AS file,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown' WHEN o_orderstatus = 'F' THEN 'private' WHEN o_orderstatus = 'O' THEN 'public' ELSE 'internal' END AS visibility FROM orders
), contexts AS (
  SELECT 'context/' || r_regionkey AS context, CASE WHEN r_regionkey < 2 THEN 'production' WHEN r_regionkey = 3 THEN 'tooling' ELSE 'test' END AS role,
    CASE WHEN r_regionkey = 0 THEN 'public_surface' ELSE 'runtime' END AS scope FROM region
), roots AS (
  SELECT 'context/' || r_regionkey AS context, 'region/' || r_regionkey AS node FROM region WHERE r_regionkey < 4
  UNION ALL SELECT 'context/' || n_regionkey, 'nation/' || n_nationkey FROM nation WHERE n_nationkey % 5 = 0
), ranked AS (
  SELECT context, node, row_number() OVER (PARTITION BY context ORDER BY node) - 1 AS root_index FROM roots
), surface AS (
  SELECT context, root_index, node FROM ranked JOIN contexts USING (context) WHERE scope = 'public_surface'
  UNION SELECT context, root_index, dst FROM surface JOIN edges ON node = src WHERE kind = 're_export'
), seeds AS (
  SELECT context, root_index, node FROM surface
  UNION SELECT context, root_index, node FROM ranked JOIN contexts USING (context) WHERE scope <> 'public_surface'
), steps AS (
  SELECT DISTINCT src, dst FROM edges WHERE kind NOT IN ('contains', 're_export') UNION SELECT node, file FROM symbols
), walk AS (
  SELECT context, node, 0 AS distance, root_index FROM seeds
  UNION SELECT context, dst, distance + 1, root_index FROM walk JOIN steps ON node = src WHERE distance < {STEPS}
), best AS (
  SELECT context, node, min(struct_pack(distance := distance, root_index := root_index)) AS b FROM walk GROUP BY context, node
), reach AS (
  SELECT best.context, best.node, b.distance AS distance, b.root_index AS root_index, ranked.node AS root
  FROM best JOIN ranked ON ranked.context = best.context AND ranked.root_index = b.root_index
), roles AS (
  SELECT node, count(DISTINCT context) AS contexts, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM reach JOIN contexts USING (context) GROUP BY node
), projects AS (
  SELECT 'nation/' || n_nationkey AS project, CASE WHEN n_nationkey = 0 THEN '.' ELSE 'apps/' || n_name END AS root, CASE WHEN n_nationkey % 4 = 3 THEN 1 ELSE 0 END AS o, n_nationkey % 3 = 1 AS only_rust FROM nation
  UNION ALL SELECT DISTINCT 'brand/' || p_brand, 'parts/' || p_brand, 0, false FROM part
), boundaries AS (
  SELECT 'nation/' || s_nationkey AS project, CASE WHEN s_acctbal >= -950 THEN 'supplier/' || s_suppkey END AS node,
    CASE WHEN s_acctbal < -950 THEN 2 ELSE 1 END AS o, CASE WHEN s_acctbal < -950 THEN 'reflection' ELSE 'dynamic_import' END AS kind FROM supplier WHERE s_acctbal < 0
  UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey, 1, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'macro_expansion' WHEN 'BUILDING' THEN 'reflection' ELSE 'unsupported_syntax' END FROM customer WHERE c_acctbal < -900
), needed AS (
  SELECT node FROM symbols WHERE visibility = 'public' UNION SELECT dst FROM needed JOIN edges ON node = src WHERE kind NOT IN ('contains', 're_export')
), bearing AS (
  SELECT b.*, n.file, CASE WHEN n.language IN ('javascript', 'typescript', 'svelte') THEN 'ecmascript' ELSE n.language END AS family FROM boundaries b LEFT JOIN nodes n ON n.node = b.node
), subjects AS (
  SELECT node, project, file, node = file AS is_file, CASE WHEN language IN ('javascript', 'typescript', 'svelte') THEN 'ecmascript' ELSE language END AS family FROM nodes WHERE kind IN ('part', 'supplier', 'customer', 'order')
), confidence AS (
  SELECT s.node, CASE
    WHEN NOT any_value(s.is_file) AND any_value(s.family) = 'rust' AND max(CASE WHEN b.kind IN ('macro_expansion', 'conditional_compilation', 'unsupported_syntax') AND (b.node IS NULL OR b.family = 'rust') THEN b.o END) > 0
      THEN max(CASE WHEN b.kind IN ('macro_expansion', 'conditional_compilation', 'unsupported_syntax') AND (b.node IS NULL OR b.family = 'rust') THEN b.o END)
    WHEN any_value(p.project) IS NULL THEN 2
    ELSE greatest(CASE WHEN any_value(p.o) = 1 AND count(b.project) = 0 THEN 1 ELSE 0 END, coalesce(max(CASE WHEN b.node IS NULL
      OR s.is_file AND (b.file = s.node OR b.kind IN ('dynamic_import', 'reflection') AND b.family = s.family)
      OR NOT s.is_file AND (b.node = s.node OR b.kind = 'reflection' AND b.family = s.family OR b.node = s.file AND b.kind IN ('macro_expansion', 'conditional_compilation', 'unsupported_syntax')) THEN b.o END), 0)) END AS c
  FROM subjects s LEFT JOIN projects p ON p.project = s.project LEFT JOIN bearing b ON b.project = s.project AND p.project IS NOT NULL GROUP BY s.node
)"""
