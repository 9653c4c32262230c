"""Sinks and streams: what they write is what was asked, again and again."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from evigraph.operators import conformance, events, joins
from evigraph.sinks import reports
from evigraph.streaming import events as streams

SCHEMA = "operation string, status int, failed_check boolean"


def test_json_lines_are_ordered(spark, tmp_path):
    rows = spark.createDataFrame([(k * 7 % 50, f"n{k}") for k in range(50)], "k int, a string").repartition(6)
    reports.json_lines(rows, ["k"], f"{tmp_path}/out")
    lines = [line for f in sorted(glob.glob(f"{tmp_path}/out/part-*")) for line in open(f)]
    assert [json.loads(x)["k"] for x in lines] == list(range(50)) and all(list(json.loads(x)) == ["a", "k"] for x in lines)


def test_text_and_charts(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "name string, n int")
    assert list(reports.text_lines(rows, ["name"], "{name}: {n}")) == ["a: 1", "b: 2"]
    edges = spark.createDataFrame([("x/y", "z"), ("x/y", "z"), ("z", "z")], "a string, b string")
    assert list(reports.mermaid(edges, "a", "b")) == ["graph TD", '  n_x_2f_y["x/y"] --> n_z["z"]']


def test_artifacts_are_written_once(spark, tmp_path):
    path = f"{tmp_path}/store"
    first = spark.createDataFrame([(1, "x"), (2, "y"), (1, "x")], "k int, body string")
    assert reports.artifacts(first, ["k", "body"], path).count() == 2
    assert reports.artifacts(spark.createDataFrame([(2, "y"), (3, "z")], "k int, body string"), ["body", "k"], path).count() == 3
    with pytest.raises(Exception, match="UNRESOLVED|cannot be resolved"):
        reports.artifacts(first, ["nothing"], path)


def test_the_stream_folds_what_the_batch_folds(spark, tmp_path):
    parts = [[("a", 200, False), ("a", 404, True), ("b", 401, False)], [("a", 500, False), ("c", 403, False)], [("b", 401, False), ("c", 200, False)]]
    for k, rows in enumerate(parts[:2]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    read = lambda: streams.event_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], SCHEMA).schema, 1)
    run = lambda: streams.start(read(), "operation", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    run()
    spark.createDataFrame(parts[2], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    run()  # goes on where it stopped
    got = streams.latest(spark, f"{tmp_path}/out")
    whole = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    want = whole.groupBy("operation").agg(*events.outcome_sums()).withColumn("coverage", events.coverage())
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_joins_keep_columns_of_any_name(spark):
    paths = spark.createDataFrame([("a/b", 1, 2, 3), ("a/b", 1, 2, 3), ("z", 1, 2, 3)], "path string, copies int, __depth int, best int")
    roots = spark.createDataFrame([("a", 5, 6), ("a/b", 7, 8)], "root string, at int, copies_of int")
    assert [tuple(r) for r in joins.longest_prefix(paths, roots).collect()] == [("a/b", 1, 2, 3, "a/b", 7, 8)] * 2
    points = spark.createDataFrame([(1, 5, 0), (1, 5, 0)], "k int, at int, copies int")
    spans = spark.createDataFrame([(1, 0, 9, "wide", 1), (1, 4, 6, "thin", 2)], "k int, begin int, end int, name string, width int")
    assert [(r.name, r.width) for r in joins.narrowest_interval(points, spans, ["k"], "at", "begin", "end", 3, ["name"]).collect()] == [("thin", 2)] * 2


def test_states_and_exceptions_with_hot_keys(spark):
    """Facts about all bindings of a target, and about one; rules that meet no result."""
    bindings = spark.createDataFrame([(k, "t", "x", "exactly_one", "ad") for k in range(30)] + [(99, "u", "x", "any", "ad")], "binding int, target string, kind string, cardinality string, adapter string")
    facts = spark.createDataFrame([("t", None, "x", False), ("t", 3, "x", False), ("t", 4, "y", False), ("u", 3, "y", False)], "target string, binding int, kind string, inferred boolean")
    coverage = spark.createDataFrame([("ad", "full")], "feature string, level string")
    got = {r.binding: r.state for r in conformance.states(bindings, facts, coverage).collect()}
    assert got == {**{k: "matched" for k in range(30)}, 3: "conflicting", 4: "conflicting", 99: "matched"}
    results = spark.createDataFrame([(1, "c", 1, "s", "error"), (2, "d", 1, "s", "error")], "result int, constraint string, version int, scope string, severity string")
    rules = [(f"e{k}", "none", 1, "s", True, "2030-01-01") for k in range(40)] + [("a2", "c", 1, "s", True, "2030-01-01"), ("a1", "c", 1, "s", True, "2030-01-01"), ("a0", "c", 1, "s", False, "2030-01-01"), ("a3", "d", 2, "s", True, "2030-01-01")]
    met = conformance.exceptions(results, spark.createDataFrame(rules, "exception string, constraint string, version int, scope string, approved boolean, expires string"), F.lit("2026-01-01"))
    assert {(r.result, r.exception, r.state) for r in met.collect() if r.result} == {(1, "a1", "applied"), (1, "a2", "irrelevant"), (1, "a0", "rejected"), (2, "a3", "stale")}
    assert met.filter("result IS NULL AND state = 'irrelevant'").count() == 40
