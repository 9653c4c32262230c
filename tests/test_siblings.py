"""Evidence about siblings against a plain version, pair by pair."""

import random

from evigraph.operators import siblings

FACTS = "callable string, project string, visibility string, shape string, typed boolean, results array<string>, unknown_results boolean, models array<string>, effects array<string>, unknown_effects boolean, unknown_types boolean, lifecycle string, concepts array<string>, incomplete boolean"


def plain(nomination, key, a, b, apart):
    speaks = []
    if nomination != "same_declared_contract" and a["typed"] and b["typed"] and a["shape"] == b["shape"]:
        speaks.append("implementation_role_match")
    if not a["unknown_effects"] and not b["unknown_effects"] and a["effects"] and set(a["effects"]) == set(b["effects"]):
        speaks.append("effect_set_match")
    if (set(a["models"]) & set(b["models"])) - ({key} if nomination == "named_model_role" else set()):
        speaks.append("model_role_match")
    speaks += [name for name, c in (("producer_position_match", "producers"), ("consumer_position_match", "consumers"), ("dependency_role_match", "externals")) if a[c] and a[c] == b[c]]
    if nomination != "canonical_action_object" and a["lifecycle"] and a["lifecycle"] == b["lifecycle"]:
        speaks.append("lifecycle_role_match")
    state = lambda unknown, absent: "unknown" if unknown else "absent" if absent else "present"
    x, y = (f["producers"] | f["consumers"] for f in (a, b))
    incomplete = a["incomplete"] or b["incomplete"]
    against = [
        state(a["unknown_effects"] or b["unknown_effects"], set(a["effects"]) == set(b["effects"])), state("unknown" in (a["visibility"], b["visibility"]), (a["project"], a["visibility"]) == (b["project"], b["visibility"])),
        state(not a["lifecycle"] or not b["lifecycle"], a["lifecycle"] == b["lifecycle"]), state(not a["results"] or not b["results"] or a["unknown_results"] or b["unknown_results"], set(a["results"]) == set(b["results"])),
        state(incomplete or not x or not y, bool(x & y)), state(incomplete, a["externals"] == b["externals"]), state(False, not any({p, q} in apart for p in a["concepts"] for q in b["concepts"])), state(False, not (incomplete or a["unknown_types"] or b["unknown_types"])),
    ]
    if "present" in against[:-1]:
        verdict = "separate_by_evidence"
    elif "unknown" in against or against[-1] == "present" or len(speaks) < 2:
        verdict = "inconclusive"
    else:
        verdict = "review_candidate"
    return tuple(speaks), tuple(against), verdict


def test_evidence_pair_by_pair(spark):
    rng = random.Random(11)
    some = lambda n, p=0.5: sorted(x for x in "abc"[:n] if rng.random() < p)
    names = [f"f{k}" for k in range(24)]
    facts = [(f, rng.choice("pp q".split()), rng.choice(["public", "public", "unknown"]), rng.choice("st"), rng.random() < 0.8, some(2, 0.8), rng.random() < 0.1, some(3), some(1, 0.7), rng.random() < 0.1, rng.random() < 0.1, rng.choice(["open", "open", "close", None]), some(2), rng.random() < 0.05) for f in names]
    edges = [(rng.choice(names), rng.choice(["n1", "n2"]), "lexical_reference", "node") for _ in range(40)] + [(rng.choice(["n1", "n3"]), rng.choice(names), "lexical_reference", "node") for _ in range(40)]
    edges += [(rng.choice(names), "net", "lexical_reference", "external") for _ in range(6)] + [(rng.choice(names), "?", "lexical_reference", "dynamic_unknown") for _ in range(2)] + [(f, "net", "import", "external") for f in names]
    roles = [("n1", "core"), ("n2", "io"), ("n3", "io")]
    make = spark.createDataFrame
    held = siblings.sibling_facts(make(facts, FACTS), make(edges, "src string, dst string, kind string, target_kind string"), make(roles, "node string, role string"))
    known = {}
    for row in facts:
        f = dict(zip([c.split()[0] for c in FACTS.split(", ")], row))
        uses = [e for e in edges if e[2] == "lexical_reference"]
        f["producers"] = {r for s, t, _, k in uses for n, r in roles if s == f["callable"] and k == "node" and t == n}
        f["consumers"] = {r for s, t, _, k in uses for n, r in roles if t == f["callable"] and s == n}
        f["externals"] = {t for s, t, _, k in uses if s == f["callable"] and k == "external"}
        f["incomplete"] = f["incomplete"] or any(s == f["callable"] and k not in ("node", "external") for s, t, _, k in uses)
        known[f["callable"]] = f
    kinds = ["same_declared_contract", "named_model_role", "canonical_action_object"]
    pairs = [(rng.choice(kinds), rng.choice("abc"), a, b) for a in names for b in names if a < b]
    found = siblings.sibling_evidence(make(pairs, "nomination string, key string, left string, right string"), held, make([("a", "b")], "a string, b string")).collect()
    got = {(r.nomination, r.key, r.left, r.right): (tuple(r.corroborations), tuple(x.state for x in r.counters), r.disposition) for r in found}
    want = {p: plain(p[0], p[1], known[p[2]], known[p[3]], [{"a", "b"}]) for p in pairs}
    assert got == want and {v[2] for v in want.values()} == {"separate_by_evidence", "inconclusive", "review_candidate"}


def test_references_are_distinct_before_they_are_gathered(spark):
    make = spark.createDataFrame
    edges = make([("f", "n1", "lexical_reference", "node"), ("n1", "f", "lexical_reference", "node"), ("f", "net", "lexical_reference", "external"), ("f", "?", "lexical_reference", "unsupported")] * 3, "src string, dst string, kind string, target_kind string")
    held = siblings.sibling_facts(make([("f", False), ("g", False)], "callable string, incomplete boolean"), edges, make([("n1", "core")], "node string, role string"))
    assert sorted((r.callable, r.incomplete, r.producers, r.consumers, r.externals) for r in held.collect()) == [("f", True, ["core"], ["core"], ["net"]), ("g", False, [], [], [])]
    plan = held._jdf.queryExecution().optimizedPlan().toString().splitlines()
    gathered = [k for k, line in enumerate(plan) if "collect_list" in line]
    assert len(gathered) == 3 and all("Aggregate [" in plan[k + 1] for k in gathered)
