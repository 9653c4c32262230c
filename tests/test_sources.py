"""Sources, functions and sinks on small fixtures of our own."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evigraph.functions import text
from evigraph.operators import windows
from evigraph.sources import files, http, manifests, python_source, sql_text


def test_python_facts():
    got = python_source.facts("a.py", "import os\nfrom subprocess import run as go\n__all__ = ['f']\n\ndef f(x):\n    'Doc.'\n    os.remove(x)\n    def g():\n        go(x)\nclass _C:\n    def m(self): pass\n")
    kinds = {(r[1], r[2], r[3]) for r in got}
    assert {("function", "f", None), ("function", "g", "f"), ("class", "_C", None), ("function", "m", "_C"), ("import", "os", None)} <= kinds
    effects = {(r[3], r[2], r[4]) for r in got if r[1] == "call" and r[8]}
    assert effects == {("f", "os.remove", "filesystem"), ("f.g", "subprocess.run", "process")}
    assert [r[7] for r in got if r[1] == "function" and r[2] == "f"] == [True]
    assert python_source.facts("b.py", "def (")[0][1] == "skipped"


def test_sql_text():
    assert [t for _, t in sql_text.lex("a /* x /* y */ z */ 'it''s' $$b;c$$ -- d\n$1")] == ["a", "'it''s'", "$$b;c$$", "$1"]
    assert len(sql_text.statements("select 1; ; select ';'")) == 2
    kinds = {"select 1": "select", "with a as (select 1) update t set x = 1": "dml", "with a as (delete from t returning 1) select * from a": "dml", "select 1 into t": "ddl", "select (select 1) from t": "select", "vacuum t": "session", "foo": "unknown"}
    assert {q: sql_text.classify(sql_text.lex(q)) for q in kinds} == kinds
    query = "with c as (select count(*) from s.t) select lower(x) from c join u on true, lateral f(1) where y in (select 1 from v)"
    assert sql_text.functions(sql_text.lex(query)) == ["count", "f", "lower"]
    assert {"s.t", "u", "v"} == set(sql_text.relations(sql_text.lex(query)))
    assert sql_text.numbered("select ${b}, :a, ${b}, x::int") == ("select $1, $2, $1, x::int", ["b", "a"])
    assert sql_text.eligibility("select lower('x')") == ("eligible", [])
    assert sql_text.eligibility("select pg_sleep(1)")[0] == "blocked" and sql_text.eligibility("insert into t values (1)")[0] == "requires_policy"
    assert sql_text.eligibility("select my_f(1)")[0] == "requires_evidence" and sql_text.eligibility("select 1; select 2")[0] == "blocked"
    ddl = "create table s.t (id int primary key, \"N\" text, constraint c unique (id, x)); create unique index if not exists i on s.t (id); comment on table s.t is 'x'; alter table t add y int"
    assert sql_text.definitions(ddl) == [("table", "s.t", ""), ("column", "id", "s.t"), ("column", "n", "s.t"), ("index", "i", "s"), ("comment", "s.t", "table"), ("unknown", "alter", "")]


def test_openapi():
    document = {
        "openapi": "3.0.1", "paths": {"/users/{id}": {"get": {"operationId": "u", "parameters": [{"$ref": "#/components/parameters/id"}], "responses": {"200": {"content": {"application/json": {}}}, "404": {}}, "security": [{"key": []}]}},
                                      "/x/{y}": {"post": {"operationId": "u", "responses": {}}}},
        "components": {"parameters": {"id": {"in": "path", "name": "id", "required": True, "schema": {"$ref": "#/components/schemas/N"}}}, "schemas": {"N": {"properties": {"next": {"$ref": "#/components/schemas/N"}}}}},
    }
    got = http.operations("a.json", json.dumps(document))
    assert [(r["method"], r["path"]) for r in got if not r["problem"]] == [("GET", "/users/{id}"), ("POST", "/x/{y}")]
    assert {r["problem"] for r in got if r["path"] == "/x/{y}"} == {None, "operation_id_duplicate", "path_parameter_undeclared", "success_response_missing", "client_error_response_missing", "security_missing"}
    assert http.operations("b", "{")[0]["problem"] == "schema_unreadable"
    assert http.resolve(document, {"$ref": "#/components/schemas/N"}) == {"properties": {"next": {"$recursiveRef": "#/components/schemas/N"}}}
    assert http.schema_digest({}, {"type": "x", "title": "a"}) == http.schema_digest({}, {"title": "b", "type": "x"})


def plain_pairwise(sizes, cap):
    """Cases in the order they come, as sets of (dimension, value)."""
    seen = []
    steps = [[()]] + [[((d, v),) for v in range(n)] for d, n in enumerate(sizes)]
    steps += [[((l, a), (r, b)) for a in range(sizes[l]) for b in range(sizes[r])] for l in range(len(sizes)) for r in range(l + 1, len(sizes))]
    for step in steps:
        for changes in step:
            case = tuple(c for c in changes if c[1])
            if case not in seen:
                seen.append(case)
    return set(seen[:cap]), len(seen) <= cap


@pytest.mark.parametrize("cap", [1, 3, 9, 40, 1_000])
def test_pairwise_cases(spark, cap):
    owners = {"a": [3, 4, 2, 3], "b": [2, 2], "c": [1], "d": [5, 1, 2]}
    rows = spark.createDataFrame([(o, d, n) for o, sizes in owners.items() for d, n in enumerate(sizes)], "owner string, dimension int, size long")
    got = {}
    for r in windows.pairwise_cases(rows, cap).collect():
        got.setdefault((r.owner, r.complete), set()).add(tuple((x.d, x.v) for x in r.case))
    assert got == {(o, plain_pairwise(sizes, cap)[1]): plain_pairwise(sizes, cap)[0] for o, sizes in owners.items()}



def test_text_functions(spark):
    row = spark.range(1).select(
        text.tokens(F.lit("HTTPServer request2Body x")).alias("t"), text.normal_term(F.lit(" C++ / Foo_bar ")).alias("n"), text.route(F.lit("/a//:id/[slug]/42")).alias("r"),
        text.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2).alias("g"), F.lit("src/a/b.ts").rlike(text.glob_regex("src/**/*.{ts,js}")).alias("m"),
    ).first()
    assert row.t == ["http", "server", "request2", "body", "x"] and row.n == "c++ foo bar" and row.r == "/a/{id}/{slug}/42" and row.g == ["a", "a b", "b", "b c", "c"] and row.m


def test_files_routes_and_manifests(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.ts").write_text("app.get('/users/:id', f)\nrouter.post(`/x`)\n")
    (tmp_path / "src/b.py").write_text("@app.get('/users/{id}')\ndef f(): pass\n")
    (tmp_path / "node_modules/c.js").write_text("app.get('/no')")
    found = files.discover(spark, str(tmp_path)).cache()
    assert {r.path for r in found.collect()} == {"src/a.ts", "src/b.py"}
    assert {(r.path, r.key) for r in http.scan_routes(found).collect()} == {("src/a.ts", "GET /users/{id}"), ("src/a.ts", "POST /x"), ("src/b.py", "GET /users/{id}")}
    assert python_source.scan(found).filter("fact = 'function'").count() == 1
    package = spark.createDataFrame([("package.json", json.dumps({"name": "p", "exports": {".": "./i.js", "./x": "./x.js"}, "scripts": {"test": "vitest", "b": "tsc"}, "dependencies": {"q": "workspace:*"}}))], "path string, text string")
    assert {(r.entry, r.target) for r in manifests.manifests(package).collect()} == {(".", "./i.js"), ("./x", "./x.js")}
    assert {r.script: r.is_test for r in manifests.scripts(package).collect()} == {"test": True, "b": False}
    assert manifests.dependencies(package).first().local
    relations = tmp_path / "r.csv"
    relations.write_text("a,broader,b\n")
    digest = hashlib.sha256(relations.read_bytes()).hexdigest()
    assert manifests.relation_provider(spark, str(relations), digest, "csv").first().object == "b"
    with pytest.raises(ValueError):
        manifests.relation_provider(spark, str(relations), "0" * 64, "csv")
