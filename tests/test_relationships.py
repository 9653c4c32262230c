"""Relationships of terms and types across packages, on small fixtures and against plain versions."""

import random

from evigraph.operators import lexicon, usage


def test_three_bases(spark):
    used = [("order", "code", 1), ("order", "http", 2), ("order", "code", 3), ("client", "code", 1), ("customer", "http", 1), ("buyer", "http", 2), ("ship", "code", 1), ("vessel", "code", 2), ("boat", "http", 1), ("port", "code", 1), ("harbour", "http", 1), ("cart", "code", 4), ("basket", "http", 4)]
    owners = [("client", "party"), ("customer", "party"), ("buyer", "sale"), ("ship", "s1"), ("vessel", "s1"), ("port", "p1"), ("harbour", "p2"), ("order", "o")]
    domain = [("vessel", "ship", "narrower"), ("boat", "ship", "broader"), ("ship", "boat", "related"), ("boat", "ship", "broader"), ("harbour", "port", "same"), ("cart", "basket", "same"), ("order", "buyer", "part"), ("lost", "order", "x")]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    none = "a string, b string, reason string"
    found = lexicon.repository_relationships(
        make(used, "term string, subject string, owner int"), make(owners, "term string, concept string"), make(domain, "a string, b string, relation string"), make([("ship", "boat", "seen")], "a string, b string, relation string"), make([("p2", "p1", "differ")], none), make([("basket", "cart", "never")], none)
    )
    got = {(r.basis, tuple(r.terms), tuple(r.concepts), r.n_subjects, r.n_evidence, r.n_domain, r.n_general) for r in found.collect()}
    assert got == {
        ("exact_normalized_term", ("order",), ("o",), 2, 3, 0, 0), ("declared_concept", ("client", "customer"), ("party",), 2, 2, 0, 0), ("pinned_domain_relation", ("boat", "ship"), ("s1",), 2, 2, 2, 1), ("pinned_domain_relation", ("buyer", "order"), ("o", "sale"), 2, 4, 1, 0),
    }


def test_types_across_packages_against_a_queue(spark):
    rng = random.Random(3)
    packages, names = ["root", "a", "b", "c"], [f"n{k}" for k in range(8)]
    pick = lambda n, *of: sorted({tuple(rng.choice(x) for x in of) for _ in range(n)})
    references, requests = pick(45, packages, names, names), pick(40, packages, names, packages[1:], names)
    exports, reexports = pick(30, packages[1:], names, names), pick(20, packages[1:], names, packages[1:], names)
    seen, queue = set(), [("symbol", "root", "n0"), ("symbol", "root", "n1")]
    while queue:
        at = queue.pop()
        if at in seen:
            continue
        seen.add(at)
        kind, p, n = at
        if kind == "symbol":
            queue += [("symbol", p, t) for q, s, t in references if (q, s) == (p, n)] + [("name", t, i) for q, s, t, i in requests if (q, s) == (p, n)]
        else:
            queue += [("symbol", p, s) for q, x, s in exports if (q, x) == (p, n)] + [("name", t, i) for q, x, t, i in reexports if (q, x) == (p, n)]
    make = lambda rows, *columns: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    found = usage.dependency_types(
        make([("root", "n0"), ("root", "n1")], "package", "symbol"), make(references, "package", "symbol", "target"), make(requests, "package", "symbol", "to_package", "imported"), make(exports, "package", "name", "symbol"), make(reexports, "package", "name", "to_package", "imported")
    )
    want = {(p, n) for kind, p, n in seen if kind == "symbol" and p != "root"}
    assert {(r.package, r.symbol) for r in found.collect()} == want and len(want) > 3


def test_texts_are_read_once(spark):
    """What is left to do when terms are counted reads no texts."""
    from evigraph.queries import relations

    left = relations.term_relationships(spark, "/root/testdata/sf0.001").inputFiles()
    assert left and not [f for f in left if "testdata" in f]


def test_terms_of_owners_with_several_rows_or_none(spark, tmp_path):
    from evigraph.queries import relations

    texts = [(1, "alpha beta alpha"), (2, "alpha"), (2, "alpha gamma"), (None, "beta"), (None, "beta"), (3, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "/alpha/delta")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(7, "alpha"), (7, "alpha")], "conv_id long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in relations._subject_terms(spark, str(tmp_path)).collect()), key=str)
    want = [("alpha", "code", 1), ("alpha", "code", 2), ("beta", "code", 1), ("beta", "code", None), ("gamma", "code", 2), ("alpha", "http", 1), ("delta", "http", 1), ("alpha", "postgres", 7)]
    assert got == sorted(want, key=str)
    picks = relations.evidence_round_robin(spark, str(tmp_path))
    assert sorted((r.owner, r.subject, r.pick) for r in picks.filter("term = 'alpha'").collect()) == [(1, "code", 1), (1, "http", 2), (2, "code", 4), (7, "postgres", 3)]
    rows_dealt = [line for line in picks._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line or "WindowGroupLimit" in line]
    assert "WindowGroupLimit" in rows_dealt[-1]  # the first keys are taken before the first shuffle
