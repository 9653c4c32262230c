"""Joins, differences, lexicon, impact, conformance and events over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..derive import table
from ..functions import text
from ..ids import digest
from ..operators import conformance, diff, events, impact, joins, lexicon, windows
from ..plans.iterate import MOST_BROADCAST, counted_cut, cut, union_all

PATTERNS = [("warm", "*red*"), ("warm", "*o?ange*"), ("cold", "*blue*"), ("cold", "{navy,sky}*"), ("size", "part*[0-9]"), ("all", "**")]
CUTOFF = "1997-01-01"


def term_usage(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.term_usage(table(spark, d, "documents"), "doc_id", "text")


def name_collisions(spark: SparkSession, d: str) -> DataFrame:
    shaped = table(spark, d, "part").select("p_name", F.concat_ws("/", "p_type", "p_size").alias("shape"), "p_brand")
    return lexicon.collisions(shaped, "p_name", "shape", "p_brand")


def shape_aliases(spark: SparkSession, d: str) -> DataFrame:
    shaped = table(spark, d, "part").select("p_name", F.concat_ws("/", "p_type", "p_size").alias("shape"))
    return lexicon.aliases(shaped, "p_name", "shape")


def _subject_terms(spark: SparkSession, d: str, distinct: bool = True) -> DataFrame:
    """(term, subject, owner). Terms are distinct in a row; only owners of several rows are made distinct by a shuffle, if asked for."""
    parts = [("documents", "doc_id", "text", "code"), ("pages", "page_id", "url", "http"), ("conversations", "conv_id", "text", "postgres")]
    found = []
    for name, key, column, subject in parts:
        rows = table(spark, d, name).select(F.col(key).alias("owner"), column)

        def terms(of: DataFrame, column=column, subject=subject) -> DataFrame:
            each = of.select("owner", F.explode(F.array_distinct(text.tokens(F.col(column)))).alias("term"))
            return each.filter(text.reportable(F.col("term"))).select("term", F.lit(subject).alias("subject"), "owner")

        if not distinct:
            found.append(terms(rows))
            continue
        often, n = counted_cut(rows.filter("owner IS NOT NULL").groupBy("owner").agg(F.count("*").alias("n")).filter("n > 1").select("owner"))
        if n > MOST_BROADCAST:
            found.append(terms(rows).distinct())
            continue
        once = rows.filter("owner IS NOT NULL").join(F.broadcast(often), "owner", "left_anti")
        more = rows.filter("owner IS NULL").unionByName(rows.join(F.broadcast(often), "owner", "left_semi"))
        found += [terms(once), terms(more).distinct()]
    return union_all(found)


def cross_subject_terms(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.shared_terms(_subject_terms(spark, d))


def term_relationships(spark: SparkSession, d: str) -> DataFrame:
    """What ties the terms of documents, pages and conversations: the terms themselves, stems as concepts, and that one follows another in its place of the alphabet."""
    terms = cut(lexicon.counted_terms(_subject_terms(spark, d)))  # texts are read once, all else comes from the counts
    shown = cut(terms.select("term").distinct())
    owners = shown.select("term", F.substring("term", 1, 4).alias("concept")).filter(F.length("term") % 2 == 0)
    following = shown.select(F.col("term").alias("b"), F.lead("term").over(Window.partitionBy(F.substring("term", 1, 2)).orderBy("term")).alias("a")).filter("a IS NOT NULL")
    rhyming = following.filter(F.substring("a", -1, 1) == F.substring("b", -1, 1))
    domain = following.withColumn("relation", F.lit("follows")).unionByName(rhyming.withColumn("relation", F.lit("rhymes")))
    general = following.filter(F.length("a") == F.length("b")).withColumn("relation", F.lit("as long"))
    never = following.filter(F.length("a") > F.length("b") + 4).withColumn("reason", F.lit("length"))
    apart = owners.alias("x").join(following, F.col("x.term") == F.col("a")).join(owners.alias("y"), F.col("y.term") == F.col("b")).filter(F.col("x.concept").startswith("t") & (F.col("x.concept") != F.col("y.concept")))
    distinct = apart.select(F.least("x.concept", "y.concept").alias("a"), F.greatest("x.concept", "y.concept").alias("b")).distinct().withColumn("reason", F.lit("declared"))
    found = lexicon.repository_relationships(terms, owners, domain, general, distinct, never)
    return found.select("basis", F.array_join("terms", ",").alias("terms"), F.array_join("concepts", ",").alias("concepts"), F.col("n_subjects").cast("long").alias("n_subjects"), "n_evidence", "n_domain", "n_general")


def evidence_round_robin(spark: SparkSession, d: str) -> DataFrame:
    first = windows.first_keys(_subject_terms(spark, d, distinct=False), ["term", "subject"], ["owner"], 4)
    return windows.round_robin(first, ["term"], "subject", ["owner"], 4).select("term", "subject", "owner", F.col("pick").cast("long").alias("pick"))


def sibling_nominations(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_brand", F.col("p_size").alias("key"), F.lit(0).alias("kind_ord"))
    types = table(spark, d, "part").select("p_brand", F.length("p_type").alias("key"), F.lit(1).alias("kind_ord"))
    members = part.unionByName(types).groupBy("kind_ord", "key", "p_brand").agg(F.count("*").alias("n"))
    pairs = members.groupBy("kind_ord", "key").agg(F.count("*").alias("members"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("possible"))
    found = windows.nominations(pairs.filter("members >= 2"), 32, 1000)
    return found.select(F.col("kind_ord").cast("long").alias("kind_ord"), F.col("key").cast("long").alias("key"), "possible", F.col("allowed").cast("long").alias("allowed"), "omission")


HEADS, TAILS = ("load", "parse", "is", "has", "repo", "req", "can_read", "supports", "writer"), ("loader", "parsing", "cfg", "resolution", "ctx", "writer", "x")


def grammar_anchors(spark: SparkSession, d: str) -> DataFrame:
    head, tail = (F.get(F.array(*[F.lit(x) for x in words]), (F.col(c) % len(words)).cast("int")) for words, c in ((HEADS, "p_partkey"), (TAILS, "p_size")))
    names = table(spark, d, "part").select(F.concat_ws("_", head, F.regexp_replace("p_name", " ", "_"), tail).alias("name")).distinct()
    anchors = lexicon.action_anchors(lexicon.parsed(names, "name"), "name")
    return anchors.select("name", "predicate", "action", "object", "qualifiers", "construction", F.col("normalisations").cast("long").alias("normalisations"))


def term_windows(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("the of",), ("and the",), ("of the",), ("the",), ("thing",)], "term string")
    return lexicon.term_matches(table(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text"), "id", "text", known, 2)


def url_route_inventory(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace("url", r"^[a-z]+://[^/]*", "")
    return table(spark, d, "pages").select(text.route_key(F.lit("get"), path).alias("route")).groupBy("route").agg(F.count("*").alias("n_pages"))


def contract_set_diff(spark: SparkSession, d: str) -> DataFrame:
    routes = table(spark, d, "pages").select("page_id", text.route(F.regexp_replace("url", r"^[a-z]+://[^/]*", "")).alias("route"))
    return joins.unmatched(routes.filter("page_id % 2 = 0"), routes.filter("page_id % 2 = 1"), ["route"])


def _customer_state(spark: SparkSession, d: str, where: str) -> DataFrame:
    orders = table(spark, d, "orders").filter(where)
    return orders.groupBy("o_custkey").agg(F.max("o_orderpriority").alias("priority"), F.min("o_orderstatus").alias("status"))


def baseline_diff_orders(spark: SparkSession, d: str) -> DataFrame:
    before, after = _customer_state(spark, d, f"o_orderdate < '{CUTOFF}'"), _customer_state(spark, d, f"o_orderdate >= '{CUTOFF}'")
    return diff.public_api(before, after, ["o_custkey"], ["priority", "status"])


def diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return diff.summary(baseline_diff_orders(spark, d))


def http_diff(spark: SparkSession, d: str) -> DataFrame:
    def state(where: str) -> DataFrame:
        rows = table(spark, d, "orders").filter(where).groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("o_orderstatus")).alias("responses"))
        return rows.select("o_custkey", (F.col("n") > 3).alias("secured"), "responses")

    return diff.http_operations(state("o_orderkey % 2 = 0"), state("o_orderkey % 2 = 1"), ["o_custkey"], ["secured"], "responses")


def migration_append(spark: SparkSession, d: str) -> DataFrame:
    def state(where: str) -> DataFrame:
        return table(spark, d, "orders").filter(where).groupBy(F.date_format("o_orderdate", "yyyyMMdd").alias("name")).agg(F.count("*").cast("string").alias("digest"))

    return diff.migrations(state("o_orderkey % 3 <> 0 AND o_orderdate < '1998-01-01'"), state("o_orderkey % 5 <> 0"), "name", "digest")


def catalog_diff_rules(spark: SparkSession, d: str) -> DataFrame:
    """Parts as items of a catalog by name and kind: smaller ones before, larger ones after."""
    kind = F.get(F.array(*[F.lit(k) for k in ("table", "column", "constraint", "index")]), (F.col("p_partkey") % 4).cast("int"))

    def state(where: str) -> DataFrame:
        rows = table(spark, d, "part").filter(where).groupBy(kind.alias("kind"), F.concat_ws("/", "p_name", "p_type").alias("key"))
        return rows.agg(F.max("p_size").cast("string").alias("digest"), F.bool_or(F.col("p_brand") < "Brand#2").alias("nullable"), F.bool_or(F.col("p_retailprice") < 950).alias("has_default"), F.bool_and(F.col("p_size") % 2 == 0).alias("is_unique"))

    return diff.catalog_items(state("p_size <= 30"), state("p_size >= 15"))


def unique_match_join(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "part").select(
        F.col("p_partkey").alias("ref"), F.col("p_size"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("p_brand"), F.when(F.col("p_partkey") % 5 < 3, F.col("p_type")).alias("p_type")
    )
    return joins.wildcard_match(refs, table(spark, d, "part"), "ref", ["p_size"], ["p_brand", "p_type"], "p_partkey").withColumnRenamed("object", "p_partkey")


def owning_prefix(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    parts = F.split("path", "/")
    roots = pages.filter("page_id % 3 = 0").select(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), "/").alias("root")).distinct()
    return joins.longest_prefix(pages, roots).select("page_id", "root")


def point_in_interval(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate"), F.lit("1992-01-01").cast("date"))
    points = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey"), day.alias("at"))
    opened = F.datediff(F.col("l_shipdate"), F.lit("1992-01-01").cast("date"))
    spans = table(spark, d, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("owner_line"), opened.alias("begin"), (opened + F.col("l_quantity").cast("int") * 4).alias("end"))
    found = joins.narrowest_interval(points, spans, ["l_suppkey"], "at", "begin", "end", 100, ["owner", "owner_line"])
    return found.select("l_orderkey", "l_linenumber", "owner", "owner_line")


def glob_subject_match(spark: SparkSession, d: str) -> DataFrame:
    return joins.glob_join(table(spark, d, "part").select("p_partkey", "p_name"), PATTERNS, "p_name").groupBy("subject", "pattern").agg(F.count("*").alias("n_parts"))


def _observed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as symbols: returned lines were seen in their supplier's nation, accepted ones were declared there."""
    context = lambda key: F.concat(F.lit("nation/"), F.col(key).cast("string")).alias("context")
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").select(F.col("l_orderkey").alias("node"), context("s_nationkey"), "l_returnflag")
    seen, said = (lines.filter(F.col("l_returnflag") == flag).select("node", "context").distinct() for flag in ("R", "A"))
    priority = F.col("o_orderpriority")
    confidence = F.when(priority == "1-URGENT", "low").when(priority == "2-HIGH", "medium").otherwise("high")
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("project/"), F.col("c_nationkey").cast("string")).alias("owner"))
    state = table(spark, d, "orders").join(customer, "o_custkey").select(F.col("o_orderkey").alias("node"), F.when(priority != "5-LOW", F.col("owner")).alias("project"), confidence.alias("confidence"), F.col("o_orderstatus").alias("status"))
    return seen, said, state


def impact_selection(spark: SparkSession, d: str) -> DataFrame:
    seen, said, state = _observed(spark, d)
    nation = table(spark, d, "nation").select(F.concat(F.lit("project/"), F.col("n_nationkey").cast("string")).alias("project"), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("context"))
    return impact.impact(state.filter("status = 'P'"), seen, said, nation, nation.select("context"))


def witness_status(spark: SparkSession, d: str) -> DataFrame:
    seen, said, state = _observed(spark, d)
    return impact.witness_status(state.select("node", "confidence"), seen, said).groupBy("status").agg(F.count("*").alias("n_symbols"))


def duplicate_scripts(spark: SparkSession, d: str) -> DataFrame:
    return impact.duplicate_scripts(table(spark, d, "documents").select(F.col("text").alias("command")), "command")


def constraint_exactly_one(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return conformance.exactly_one(customers, table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


def conformance_states(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    adapter = F.concat_ws("/", "o_orderstatus", (F.col("o_custkey") % 11).cast("string"))
    modes = F.array(*[F.lit(m) for m in ("exactly_one", "at_most_one", "one_or_more", "any")])
    bindings = orders.select(F.col("o_orderkey").alias("binding"), F.col("o_custkey").alias("target"), F.lit("R").alias("kind"), F.get(modes, (F.col("o_orderkey") % 4).cast("int")).alias("cardinality"), adapter.alias("adapter"))
    lines = table(spark, d, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("target")), "l_orderkey").filter("l_returnflag <> 'A'")
    facts = lines.select("target", F.when(F.col("l_linenumber") < 7, F.col("l_orderkey")).alias("binding"), F.col("l_returnflag").alias("kind"), (F.col("l_discount") > 0.09).alias("inferred"))
    level = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "partial").otherwise("unsupported")
    coverage = orders.filter("o_custkey % 11 <> 5").select(adapter.alias("feature"), level.alias("level")).distinct()
    return conformance.states(bindings, facts, coverage).groupBy("state").agg(F.count("*").alias("n_bindings"))


def exception_asof(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("result"), (F.col("s_suppkey") % 7).alias("constraint"), F.lit(2).alias("version"), F.col("s_nationkey").alias("scope"), F.when(F.col("s_acctbal") < 4000, "error").otherwise("advisory").alias("severity")
    )
    rules = table(spark, d, "part").select(
        F.col("p_partkey").alias("exception"), (F.col("p_partkey") % 7).alias("constraint"), F.when(F.col("p_size") > 10, 2).otherwise(1).alias("version"), (F.col("p_partkey") % 25).cast("int").alias("scope"),
        (F.col("p_partkey") % 13 != 0).alias("approved"), F.when(F.col("p_partkey") % 8 == 0, "2024-01-01T00:00:00Z").otherwise("2026-01-01T00:00:00Z").alias("expires"),
    )
    return conformance.exceptions(results, rules, F.lit("2025-01-01T00:00:00Z"))


def _event_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(k % 10 < 5, 200).when(k % 10 < 6, 302).when(k % 10 < 7, 401).when(k % 10 < 9, 404).otherwise(500)
    rows = table(spark, d, "events").withColumn("operation", F.concat_ws("/", "event_type", (F.col("user_id") % 50).cast("string")))
    return rows.select("operation", "event_id", F.when(F.col("user_id") % 3 == 0, F.least(status, F.lit(404))).otherwise(status).alias("status"), (F.col("value") > 99).alias("failed_check"))


def event_fold_ops(spark: SparkSession, d: str) -> DataFrame:
    return events.fold(_event_rows(spark, d), "operation")


def event_totals_rollup(spark: SparkSession, d: str) -> DataFrame:
    return events.totals(_event_rows(spark, d).withColumn("operation", F.element_at(F.split("operation", "/"), 1)), "operation")


def lru_prune(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"), F.floor("o_totalprice").cast("long").alias("bytes"))
    return windows.prune_oldest(entries, 500_000_000).select("path", "bytes")


def pairwise_cases(spark: SparkSession, d: str) -> DataFrame:
    """Brands vary their parts' types, sizes and names; the first cases of each brand."""
    sizes = table(spark, d, "part").groupBy("p_brand").agg(*[F.countDistinct(c).alias(c) for c in ("p_type", "p_size", "p_name")])
    dimensions = sizes.select(F.col("p_brand").alias("owner"), F.posexplode(F.array("p_type", "p_size", "p_name")).alias("dimension", "size"))
    case = F.array_join(F.transform("case", lambda x: F.concat_ws("=", x["d"].cast("string"), x["v"].cast("string"))), ",")
    return windows.pairwise_cases(dimensions, 1_000).select("owner", case.alias("case"), "complete")


def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.count(k).alias("n_k"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", digest(F.col("p_brand"), F.col("p_name"), domain="part/1").alias("id"))


def project_language_counts(spark: SparkSession, d: str) -> DataFrame:
    langs = ["de", "en", "es", "fr"]
    return table(spark, d, "documents").groupBy("source").pivot("lang", langs).agg(F.count(F.lit(1))).na.fill(0)


def worst_of_and_first_docs(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.groupBy("p_brand", "p_type").agg(F.bool_and(F.col("p_size") > 5).alias("referenced"), F.min_by("p_name", "p_partkey").alias("first_docs"), F.countDistinct("p_size").alias("n_exports"))


QUERIES = {
    f.__name__: f
    for f in (
        term_usage, term_relationships, name_collisions, shape_aliases, cross_subject_terms, evidence_round_robin, sibling_nominations, grammar_anchors, term_windows, url_route_inventory, contract_set_diff,
        baseline_diff_orders, diff_summary, http_diff, migration_append, catalog_diff_rules, unique_match_join, owning_prefix, point_in_interval, glob_subject_match, impact_selection,
        witness_status, duplicate_scripts, constraint_exactly_one, conformance_states, exception_asof, event_fold_ops, event_totals_rollup, lru_prune, pairwise_cases, json_props,
        stable_ids, project_language_counts, worst_of_and_first_docs,
    )
}


def _tokens(column: str) -> str:
    spaced = f"regexp_replace({column}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    spaced = f"regexp_replace({spaced}, '([\\p{{Ll}}0-9])(\\p{{Lu}})', '\\1 \\2', 'g')"
    spaced = f"regexp_replace({spaced}, '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')"
    return f"string_split(trim(lower({spaced})), ' ')"


_REPORTABLE = "strlen(term) >= 3 AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN ('and', 'for', 'from', 'the', 'with')"
_ROUTE = "'/' || array_to_string(list_transform(list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> ''), lambda x: CASE WHEN starts_with(x, ':') THEN '{' || x[2:] || '}' WHEN starts_with(x, '[') AND ends_with(x, ']') THEN '{' || x[2:-2] || '}' ELSE x END), '/')"
_SUBJECTS = "WITH raw AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT {key} AS owner, '{subject}' AS subject, unnest({_tokens(column)}) AS term FROM {name}"
    for name, key, column, subject in (("documents", "doc_id", "text", "code"), ("pages", "page_id", "url", "http"), ("conversations", "conv_id", "text", "postgres"))
) + f"), terms AS (SELECT DISTINCT term, subject, owner FROM raw WHERE {_REPORTABLE})"
_CUSTOMERS = f"""before AS (SELECT o_custkey, max(o_orderpriority) AS priority, min(o_orderstatus) AS status FROM orders WHERE o_orderdate < '{CUTOFF}' GROUP BY o_custkey
), after AS (SELECT o_custkey, max(o_orderpriority) AS priority, min(o_orderstatus) AS status FROM orders WHERE o_orderdate >= '{CUTOFF}' GROUP BY o_custkey
), found AS (
  SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'added' WHEN a.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM before b FULL JOIN after a ON a.o_custkey = b.o_custkey WHERE b.o_custkey IS NULL OR a.o_custkey IS NULL OR b.priority <> a.priority OR b.status <> a.status
), named AS (SELECT o_custkey, change, CASE change WHEN 'added' THEN 'additive' WHEN 'removed' THEN 'breaking' ELSE 'review' END AS severity FROM found)"""
_SEEN = """lines AS (SELECT DISTINCT l_orderkey AS node, 'nation/' || s_nationkey AS context, l_returnflag FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
), seen AS (SELECT node, context FROM lines WHERE l_returnflag = 'R'
), said AS (SELECT node, context FROM lines WHERE l_returnflag = 'A'
), state AS (
  SELECT o_orderkey AS node, o_orderstatus AS status, CASE WHEN o_orderpriority <> '5-LOW' THEN c_nationkey END AS project, CASE o_orderpriority WHEN '1-URGENT' THEN 'low' WHEN '2-HIGH' THEN 'medium' ELSE 'high' END AS confidence
  FROM orders JOIN customer ON c_custkey = o_custkey)"""
_EVENTS = """raw AS (
  SELECT event_type || '/' || (user_id % 50) AS operation, event_type, user_id, value > 99 AS failed, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS k FROM events
), coded AS (SELECT *, CASE WHEN k < 5 THEN 200 WHEN k < 6 THEN 302 WHEN k < 7 THEN 401 WHEN k < 9 THEN 404 ELSE 500 END AS s FROM raw
), rows_ AS (SELECT operation, event_type, failed, CASE WHEN user_id % 3 = 0 THEN least(s, 404) ELSE s END AS status FROM coded)"""
_SUMS = """count(*) AS cases, count(*) FILTER (status BETWEEN 200 AND 399) AS successes, count(*) FILTER (status IN (401, 403)) AS auth_rejections,
  count(*) FILTER (status BETWEEN 400 AND 499) AS client_errors, count(*) FILTER (status BETWEEN 500 AND 599) AS server_errors, count(*) FILTER (failed) AS check_failures"""

ORACLE_SQL = {
    "term_usage": f"WITH raw AS (SELECT DISTINCT doc_id, unnest({_tokens('text')}) AS term FROM documents) SELECT term, count(*) AS n_subjects FROM raw WHERE {_REPORTABLE} GROUP BY term HAVING count(*) >= 2",
    "name_collisions": "SELECT p_name, count(DISTINCT p_type || '/' || p_size) AS n_shapes, count(DISTINCT p_brand) AS n_files FROM part GROUP BY p_name HAVING n_shapes >= 2 AND n_files >= 2",
    "shape_aliases": "SELECT p_type || '/' || p_size AS shape, count(DISTINCT p_name) AS n_names, min(p_name) AS first_name, max(p_name) AS last_name FROM part GROUP BY ALL HAVING count(DISTINCT p_name) >= 2",
    "cross_subject_terms": _SUBJECTS + " SELECT term, count(DISTINCT subject) AS n_subjects, string_agg(DISTINCT subject, ',' ORDER BY subject) AS subjects, count(*) AS n_evidence FROM terms GROUP BY term HAVING count(DISTINCT subject) >= 2",
    "term_relationships": _SUBJECTS + """, used AS (SELECT term, list(DISTINCT subject) AS subjects, count(*) AS n FROM terms GROUP BY term
), owned AS (SELECT *, CASE WHEN length(term) % 2 = 0 THEN term[1:4] END AS concept FROM used
), f AS (SELECT * FROM (SELECT term AS low, lead(term) OVER (PARTITION BY term[1:2] ORDER BY term) AS high FROM used) WHERE high IS NOT NULL
), apart AS (
  SELECT DISTINCT least(x.concept, y.concept) AS a, greatest(x.concept, y.concept) AS b FROM f JOIN owned x ON x.term = f.high JOIN owned y ON y.term = f.low WHERE starts_with(x.concept, 't') AND x.concept <> y.concept
), met AS (
  SELECT l.term AS low, h.term AS high, l.subjects AS ls, h.subjects AS hs, l.n + h.n AS n, l.concept AS lc, h.concept AS hc, 1 + (l.term[-1:] = h.term[-1:])::INT AS n_domain, (length(l.term) = length(h.term))::INT AS n_general
  FROM f JOIN owned l ON l.term = f.low JOIN owned h ON h.term = f.high
)
SELECT 'exact_normalized_term' AS basis, term AS terms, coalesce(concept, '') AS concepts, len(subjects) AS n_subjects, n AS n_evidence, 0::BIGINT AS n_domain, 0::BIGINT AS n_general FROM owned WHERE len(subjects) >= 2
UNION ALL SELECT 'declared_concept', string_agg(term, ',' ORDER BY term), concept, len(list_distinct(flatten(list(subjects)))), sum(n)::BIGINT, 0, 0 FROM owned WHERE concept IS NOT NULL GROUP BY concept HAVING count(*) >= 2 AND len(list_distinct(flatten(list(subjects)))) >= 2
UNION ALL SELECT 'pinned_domain_relation', low || ',' || high, array_to_string(list_sort(list_distinct(list_filter([lc, hc], lambda x: x IS NOT NULL))), ','), len(list_distinct(list_concat(ls, hs))), n, n_domain, n_general FROM met
WHERE NOT (len(ls) = 1 AND len(hs) = 1 AND ls[1] = hs[1]) AND length(high) <= length(low) + 4 AND NOT (lc IS NOT NULL AND hc IS NOT NULL AND lc <> hc AND (least(lc, hc), greatest(lc, hc)) IN (SELECT (a, b) FROM apart))""",
    "evidence_round_robin": _SUBJECTS + """, turns AS (SELECT *, row_number() OVER (PARTITION BY term, subject ORDER BY owner) AS turn FROM terms
), picks AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY turn, subject) AS pick FROM turns) SELECT term, subject, owner, pick FROM picks WHERE pick <= 4""",
    "sibling_nominations": """WITH m AS (
  SELECT 0 AS kind_ord, p_size AS key, p_brand, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 1, length(p_type), p_brand, count(*) FROM part GROUP BY ALL
), k AS (SELECT kind_ord, key, CAST((sum(n) * sum(n) - sum(n * n)) / 2 AS BIGINT) AS possible FROM m GROUP BY ALL HAVING count(*) >= 2
), w AS (SELECT *, least(possible, 32) AS wish, greatest(1000 - coalesce(sum(least(possible, 32)) OVER (ORDER BY kind_ord, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS room FROM k)
SELECT CAST(kind_ord AS BIGINT) AS kind_ord, CAST(key AS BIGINT) AS key, possible, CAST(least(wish, room) AS BIGINT) AS allowed,
  CASE WHEN possible <= least(wish, room) THEN 'none' WHEN room < wish THEN 'comparison_set' ELSE 'per_key' END AS omission FROM w""",
    "grammar_anchors": f"""WITH n AS (SELECT DISTINCT concat_ws('_', {list(HEADS)}[p_partkey % {len(HEADS)} + 1], replace(p_name, ' ', '_'), {list(TAILS)}[p_size % {len(TAILS)} + 1]) AS name FROM part
), t AS (SELECT name, {_tokens('name')} AS w, {list(lexicon.ABBREVIATIONS)} AS short, {list(lexicon.ABBREVIATIONS.values())} AS long,
  {list(lexicon.ACTORS)} AS ak, {list(lexicon.ACTORS.values())} AS av, {list(lexicon.RESULTS)} AS rk, {list(lexicon.RESULTS.values())} AS rv FROM n
), f AS (SELECT *, list_transform(w, lambda x: coalesce(long[list_position(short, x)], x)) AS x FROM t
), g AS (SELECT *, x[1] IN {lexicon.PREDICATES} AS p, CASE WHEN p THEN 2 ELSE 1 END AS place, coalesce(list_contains(av, x[place]), false) AS acts, coalesce(av[list_position(ak, x[-1])], rv[list_position(rk, x[-1])]) AS of_last,
  CASE WHEN acts THEN x[place + 1:] ELSE x[:-2] END AS subject FROM f WHERE len(x) > 0
), h AS (SELECT name, CASE WHEN acts AND p THEN x[1] END AS predicate, CASE WHEN acts THEN x[place] ELSE of_last END AS action, subject[1] AS object, array_to_string(subject[2:], ' ') AS qualifiers,
  CASE WHEN acts THEN CASE WHEN p THEN 'predicate' ELSE 'action' END WHEN list_contains(ak, x[-1]) THEN 'actor' ELSE 'result' END AS construction,
  CAST(len(list_distinct(list_filter(w, lambda y: list_contains(short, y)))) + CASE WHEN acts THEN 0 ELSE 1 END AS BIGINT) AS normalisations FROM g WHERE acts <> (of_last IS NOT NULL) AND len(subject) > 0)
SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY predicate, action, object, qualifiers ORDER BY normalisations, name) = 1""",
    "term_windows": f"""WITH w AS (SELECT conv_id || '/' || turn AS id, {_tokens('text')} AS t FROM conversations
), r AS (SELECT DISTINCT id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM w)
SELECT id, term FROM r WHERE term IN ('the of', 'and the', 'of the', 'the', 'thing')""",
    "url_route_inventory": f"SELECT 'GET ' || {_ROUTE} AS route, count(*) AS n_pages FROM pages GROUP BY ALL",
    "contract_set_diff": f"""WITH r AS (SELECT page_id, {_ROUTE} AS route FROM pages), a AS (SELECT DISTINCT route FROM r WHERE page_id % 2 = 0), b AS (SELECT DISTINCT route FROM r WHERE page_id % 2 = 1)
SELECT route, 'left' AS only FROM a WHERE route NOT IN (SELECT route FROM b) UNION ALL SELECT route, 'right' FROM b WHERE route NOT IN (SELECT route FROM a)""",
    "baseline_diff_orders": f"WITH {_CUSTOMERS} SELECT * FROM named",
    "diff_summary": f"WITH {_CUSTOMERS} SELECT change, severity, count(*) AS n_changes FROM named GROUP BY ALL",
    "http_diff": """WITH b AS (SELECT o_custkey, count(*) > 3 AS s, list_sort(list(DISTINCT o_orderstatus)) AS r FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey
), a AS (SELECT o_custkey, count(*) > 3 AS s, list_sort(list(DISTINCT o_orderstatus)) AS r FROM orders WHERE o_orderkey % 2 = 1 GROUP BY o_custkey)
SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'added' WHEN a.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN b.o_custkey IS NULL THEN 'additive' WHEN a.o_custkey IS NULL THEN 'breaking' WHEN a.s = b.s AND list_has_all(a.r, b.r) AND len(a.r) > len(b.r) THEN 'additive' ELSE 'breaking' END AS severity
FROM b FULL JOIN a ON a.o_custkey = b.o_custkey WHERE b.o_custkey IS NULL OR a.o_custkey IS NULL OR a.s <> b.s OR a.r <> b.r""",
    "migration_append": """WITH b AS (SELECT strftime(o_orderdate, '%Y%m%d') AS name, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderdate < '1998-01-01' GROUP BY 1
), a AS (SELECT strftime(o_orderdate, '%Y%m%d') AS name, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1)
SELECT coalesce(b.name, a.name) AS name, CASE WHEN b.name IS NULL THEN 'added' WHEN a.name IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN b.name IS NULL AND a.name > (SELECT max(name) FROM b) THEN 'additive' ELSE 'breaking' END AS severity
FROM b FULL JOIN a ON a.name = b.name WHERE b.name IS NULL OR a.name IS NULL OR a.n <> b.n""",
    "catalog_diff_rules": """WITH s AS (SELECT ['table', 'column', 'constraint', 'index'][p_partkey % 4 + 1] AS kind, p_name || '/' || p_type AS key, * FROM part),
b AS (SELECT kind, key, max(p_size) AS digest, bool_or(p_brand < 'Brand#2') AS nullable, bool_or(p_retailprice < 950) AS has_default, bool_and(p_size % 2 = 0) AS is_unique FROM s WHERE p_size <= 30 GROUP BY ALL),
a AS (SELECT kind, key, max(p_size) AS digest, bool_or(p_brand < 'Brand#2') AS nullable, bool_or(p_retailprice < 950) AS has_default, bool_and(p_size % 2 = 0) AS is_unique FROM s WHERE p_size >= 15 GROUP BY ALL)
SELECT coalesce(b.kind, a.kind) AS kind, coalesce(b.key, a.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN b.key IS NULL AND (a.kind = 'table' OR a.kind = 'column' AND (a.nullable OR a.has_default) OR a.kind = 'index' AND NOT a.is_unique) THEN 'additive' ELSE 'breaking' END AS severity
FROM b FULL JOIN a ON a.kind = b.kind AND a.key = b.key WHERE b.key IS NULL OR a.key IS NULL OR (a.digest, a.nullable, a.has_default, a.is_unique) <> (b.digest, b.nullable, b.has_default, b.is_unique)""",
    "unique_match_join": """WITH r AS (SELECT p_partkey AS ref, p_size, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS b, CASE WHEN p_partkey % 5 < 3 THEN p_type END AS t FROM part
), m AS (SELECT ref, count(p_partkey) AS matches, min(p_partkey) AS o FROM r LEFT JOIN part ON part.p_size = r.p_size AND (b IS NULL OR b = p_brand) AND (t IS NULL OR t = p_type) GROUP BY ref)
SELECT ref, matches, CASE matches WHEN 1 THEN 'touch' WHEN 0 THEN 'no_static_definition' ELSE 'ambiguous' END AS outcome, CASE WHEN matches = 1 THEN o END AS p_partkey FROM m""",
    "owning_prefix": """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages
), s AS (SELECT page_id, path, string_split(path, '/') AS x FROM p
), r AS (SELECT DISTINCT array_to_string(x[1:greatest(len(x) - 1, 1)], '/') AS root FROM s WHERE page_id % 3 = 0)
SELECT page_id, max_by(root, length(root)) AS root FROM p JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY page_id""",
    "point_in_interval": """WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey, datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS t FROM lineitem
), s AS (SELECT l_suppkey, l_orderkey AS owner, l_linenumber AS owner_line, datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS b, b + CAST(trunc(l_quantity) AS INT) * 4 AS e FROM lineitem
), m AS (SELECT p.l_orderkey, p.l_linenumber, owner, owner_line, row_number() OVER (PARTITION BY p.l_orderkey, p.l_linenumber, p.l_suppkey, p.t ORDER BY e - b, owner, owner_line) AS n FROM p JOIN s ON p.l_suppkey = s.l_suppkey AND t BETWEEN b AND e)
SELECT l_orderkey, l_linenumber, owner, owner_line FROM m WHERE n = 1""",
    "glob_subject_match": """WITH g(subject, pattern, rx) AS (VALUES ('warm', '*red*', '[^/]*red[^/]*'), ('warm', '*o?ange*', '[^/]*o[^/]ange[^/]*'), ('cold', '*blue*', '[^/]*blue[^/]*'), ('cold', '{navy,sky}*', '(?:navy|sky)[^/]*'),
  ('size', 'part*[0-9]', 'part[^/]*\\[0-9\\]'), ('all', '**', '.*')) SELECT subject, pattern, count(*) AS n_parts FROM part JOIN g ON regexp_full_match(p_name, rx) GROUP BY ALL""",
    "impact_selection": f"""WITH {_SEEN}, changed AS (SELECT * FROM state WHERE status = 'P'), every AS (SELECT n_nationkey AS project, 'nation/' || n_nationkey AS context FROM nation)
SELECT context, 'observed' AS reason FROM changed JOIN seen USING (node) UNION SELECT context, 'declared' FROM changed JOIN said USING (node)
UNION SELECT context, 'project' FROM changed JOIN every USING (project) WHERE confidence = 'medium'
UNION SELECT context, 'workspace' FROM every WHERE EXISTS (SELECT 1 FROM changed WHERE confidence = 'low' OR project IS NULL)""",
    "witness_status": f"""WITH {_SEEN} SELECT CASE WHEN node IN (SELECT node FROM seen) THEN 'witnessed' WHEN node IN (SELECT node FROM said) THEN 'declared_only' WHEN confidence = 'high' THEN 'unwitnessed' ELSE 'unknown' END AS status, count(*) AS n_symbols FROM state GROUP BY 1""",
    "duplicate_scripts": "SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS command, count(*) AS n_scripts FROM documents GROUP BY 1 HAVING count(*) > 1",
    "constraint_exactly_one": "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) <> 1",
    "conformance_states": """WITH f AS (SELECT o_custkey AS target, CASE WHEN l_linenumber < 7 THEN l_orderkey END AS b, l_returnflag AS kind, l_discount > 0.09 AS inferred FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'A'
), m AS (SELECT o_orderkey, count(f.target) AS n, count(*) FILTER (kind <> 'R') AS other, count(*) FILTER (inferred) AS inferred FROM orders LEFT JOIN f ON target = o_custkey AND (b IS NULL OR b = o_orderkey) GROUP BY o_orderkey
), c AS (SELECT n, other, inferred, o_custkey % 11 = 5 OR o_orderstatus NOT IN ('F', 'O') AS lacking, o_orderstatus = 'O' AS partial, o_orderkey % 4 AS mode FROM m JOIN orders USING (o_orderkey))
SELECT CASE WHEN inferred > 0 THEN 'ambiguous' WHEN lacking THEN 'unobserved' WHEN partial THEN CASE WHEN n > 0 THEN 'partial' ELSE 'unobserved' END WHEN other > 0 THEN 'conflicting'
  WHEN n = 0 AND mode IN (0, 2) THEN 'absent' WHEN n > 1 AND mode IN (0, 1) THEN 'conflicting' ELSE 'matched' END AS state, count(*) AS n_bindings FROM c GROUP BY 1""",
    "exception_asof": """WITH r AS (SELECT s_suppkey AS result, s_suppkey % 7 AS c, s_nationkey AS scope, s_acctbal < 4000 AS error FROM supplier
), x AS (SELECT p_partkey AS exception, p_partkey % 7 AS c, p_size > 10 AS current, p_partkey % 25 AS scope, p_partkey % 13 <> 0 AS approved, p_partkey % 8 = 0 AS expired FROM part
), m AS (SELECT *, coalesce(error, false) AND approved AND NOT expired AND current AS fits FROM x LEFT JOIN r ON x.c = r.c AND x.scope = r.scope
), n AS (SELECT *, row_number() OVER (PARTITION BY result, fits ORDER BY exception) AS place FROM m)
SELECT result, exception, CASE WHEN NOT approved THEN 'rejected' WHEN expired THEN 'expired' WHEN result IS NULL OR NOT error THEN 'irrelevant' WHEN NOT current THEN 'stale' WHEN place > 1 THEN 'irrelevant' ELSE 'applied' END AS state FROM n""",
    "event_fold_ops": f"""WITH {_EVENTS}, sums AS (SELECT operation, {_SUMS} FROM rows_ GROUP BY operation
), codes AS (SELECT operation, status, count(*) AS n FROM rows_ GROUP BY ALL), hist AS (SELECT operation, string_agg(status || ':' || n, ' ' ORDER BY status) AS histogram FROM codes GROUP BY operation)
SELECT sums.*, CASE WHEN cases = 0 THEN 'not_exercised' WHEN server_errors > 0 THEN 'server_error' WHEN check_failures > 0 THEN 'check_failure' WHEN successes > 0 THEN 'exercised' WHEN auth_rejections = cases THEN 'auth_only' ELSE 'rejected' END AS coverage, histogram
FROM sums JOIN hist USING (operation)""",
    "event_totals_rollup": f"WITH {_EVENTS} SELECT event_type AS operation, {_SUMS} FROM rows_ GROUP BY ROLLUP (event_type)",
    "lru_prune": """WITH e AS (SELECT o_orderkey AS path, o_orderdate AS mtime, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders
), r AS (SELECT *, sum(bytes) OVER () - coalesce(sum(bytes) OVER (ORDER BY mtime, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM e) SELECT path, bytes FROM r WHERE remaining > 500000000""",
    "pairwise_cases": """WITH z AS (SELECT p_brand AS owner, count(DISTINCT p_type) AS n0, count(DISTINCT p_size) AS n1, count(DISTINCT p_name) AS n2 FROM part GROUP BY p_brand),
g AS (SELECT owner, 0 AS turn, 0 AS l, 0 AS r, 0 AS a, 0 AS b FROM z
  UNION ALL SELECT owner, 1, 0, 0, i, 0 FROM z, range(n0) t(i) UNION ALL SELECT owner, 1, 1, 0, i, 0 FROM z, range(n1) t(i) UNION ALL SELECT owner, 1, 2, 0, i, 0 FROM z, range(n2) t(i)
  UNION ALL SELECT owner, 2, 0, 1, i, j FROM z, range(n0) t(i), range(n1) u(j) UNION ALL SELECT owner, 2, 0, 2, i, j FROM z, range(n0) t(i), range(n2) u(j) UNION ALL SELECT owner, 2, 1, 2, i, j FROM z, range(n1) t(i), range(n2) u(j)
), c AS (SELECT owner, concat_ws(',', CASE WHEN turn > 0 AND a > 0 THEN l || '=' || a END, CASE WHEN turn = 2 AND b > 0 THEN r || '=' || b END) AS "case", struct_pack(turn, l, r, a, b) AS rank FROM g
), f AS (SELECT owner, "case", min(rank) AS rank FROM c GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY rank) AS place, count(*) OVER (PARTITION BY owner) AS total FROM f)
SELECT owner, "case", total <= 1000 AS complete FROM n WHERE place <= 1000""",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(json_extract_string(props, '$.k')) AS n_k FROM events GROUP BY event_type",
    "stable_ids": "SELECT p_partkey, sha256('part/1|' || strlen(p_brand) || ':' || p_brand || '|' || strlen(p_name) || ':' || p_name) AS id FROM part",
    "project_language_counts": "SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source",
    "worst_of_and_first_docs": "SELECT p_brand, p_type, bool_and(p_size > 5) AS referenced, min_by(p_name, p_partkey) AS first_docs, count(DISTINCT p_size) AS n_exports FROM part GROUP BY ALL",
}
