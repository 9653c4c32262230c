"""Callables of sibling members that may do the same: what speaks for it, what against, and what can't be told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What may speak for two callables being one, and what against it.
CORROBORATIONS = ("implementation_role_match", "effect_set_match", "model_role_match", "producer_position_match", "consumer_position_match", "dependency_role_match", "lifecycle_role_match")
COUNTERS = (
    "conflicting_or_unknown_effects", "different_authority_or_security_boundaries", "different_lifecycle_or_cleanup_ownership", "incompatible_result_or_error_semantics",
    "disjoint_producer_or_consumer_roles", "different_externally_owned_protocol_obligations", "distinct_configured_concepts", "incomplete_graph_or_type_evidence",
)
SETS = ("results", "models", "effects", "concepts")


def sibling_facts(callables: DataFrame, edges: DataFrame, node_roles: DataFrame) -> DataFrame:
    """The callables (callable, incomplete, ...) with producers, consumers and externals, arrays of what their lexical references lead to and
    from: roles (node, role) of known nodes, names of external ones. References that end at any other boundary make a callable incomplete.

    ``edges``: (src, dst, kind, target_kind). Each side is summed up by callable before it meets the others, and its rows are made
    distinct before they are gathered as lists: sets over all references would be sorted and spilled, and before a set
    Spark leaves out what makes them distinct.
    """
    used = edges.filter("kind = 'lexical_reference'")
    roles = node_roles.select("node", "role").distinct()
    to_nodes = used.filter("target_kind = 'node'").select("src", "dst")
    up = to_nodes.join(roles, F.col("dst") == F.col("node")).select(F.col("src").alias("callable"), "role").distinct().groupBy("callable").agg(_listed("role", "producers"))
    down = to_nodes.join(roles, F.col("src") == F.col("node")).select(F.col("dst").alias("callable"), "role").distinct().groupBy("callable").agg(_listed("role", "consumers"))
    outside = F.col("target_kind") == "external"
    ends = used.filter("target_kind <> 'node'").select(F.col("src").alias("callable"), F.when(outside, F.col("dst")).alias("external"), (~outside).alias("cut_off")).distinct()
    out = ends.groupBy("callable").agg(_listed("external", "externals"), F.max("cut_off").alias("cut_off"))
    rows = callables
    for side in (up, down, out):
        rows = rows.join(side, "callable", "left")
    none = F.array().cast("array<string>")
    held = [c for c in callables.columns if c != "incomplete"]
    return rows.select(*held, (F.col("incomplete") | F.coalesce("cut_off", F.lit(False))).alias("incomplete"), *[F.coalesce(c, none).alias(c) for c in ("producers", "consumers", "externals")])


def _listed(column: str, name: str) -> Column:
    return F.array_sort(F.collect_list(column)).alias(name)


def sibling_evidence(pairs: DataFrame, facts: DataFrame, distinct_concepts: DataFrame) -> DataFrame:
    """(nomination, key, left, right, corroborations, counters, disposition) of pairs (nomination, key, left, right).

    ``facts``: (callable, project, visibility, shape, typed, results, unknown_results, models, effects, unknown_effects,
    unknown_types, lifecycle, concepts, incomplete, producers, consumers, externals), sets as arrays; ``distinct_concepts``: (a, b), either way. A
    counter is present, absent or unknown. One that is present keeps the two apart, but incomplete evidence, and any that is unknown, leaves it open; so do
    fewer than two corroborations.
    """
    held = facts.select("callable", F.struct(*[c if c not in SETS else F.array_sort(F.array_distinct(c)).alias(c) for c in facts.columns if c != "callable"]).alias("f"))
    met = pairs.select("nomination", "key", "left", "right").join(held.select(F.col("callable").alias("left"), F.col("f").alias("l")), "left").join(held.select(F.col("callable").alias("right"), F.col("f").alias("r")), "right")
    apart = distinct_concepts.select("a", "b").union(distinct_concepts.select("b", "a")).distinct()
    crossed = met.select("nomination", "key", "left", "right", F.explode("l.concepts").alias("a"), "r.concepts").select("nomination", "key", "left", "right", "a", F.explode("concepts").alias("b")).join(apart, ["a", "b"]).select("nomination", "key", "left", "right").distinct().withColumn("declared_apart", F.lit(True))
    met = met.join(crossed, ["nomination", "key", "left", "right"], "left")
    left, right = (lambda c: F.col("l")[c]), (lambda c: F.col("r")[c])
    same = lambda c: (F.size(left(c)) > 0) & (left(c) == right(c))
    either = lambda c: left(c) | right(c)
    other = lambda name: F.col("nomination") != name
    shared = F.array_intersect(left("models"), right("models"))
    more = F.when(other("named_model_role"), shared).otherwise(F.filter(shared, lambda x: x != F.col("key")))
    speaks = (
        other("same_declared_contract") & left("typed") & right("typed") & (left("shape") == right("shape")), ~either("unknown_effects") & same("effects"), F.size(more) > 0, same("producers"), same("consumers"), same("externals"),
        other("canonical_action_object") & F.coalesce(left("lifecycle") == right("lifecycle"), F.lit(False)),
    )
    state = lambda unknown, absent: F.when(unknown, "unknown").when(absent, "absent").otherwise("present")
    places = [F.array_union(side("producers"), side("consumers")) for side in (left, right)]
    unseen = F.lit(False)
    against = (
        state(either("unknown_effects"), left("effects") == right("effects")), state((left("visibility") == "unknown") | (right("visibility") == "unknown"), (left("project") == right("project")) & (left("visibility") == right("visibility"))),
        state(left("lifecycle").isNull() | right("lifecycle").isNull(), left("lifecycle") == right("lifecycle")), state((F.size(left("results")) == 0) | (F.size(right("results")) == 0) | either("unknown_results"), left("results") == right("results")),
        state(either("incomplete") | (F.size(places[0]) == 0) | (F.size(places[1]) == 0), F.arrays_overlap(*places)), state(either("incomplete"), left("externals") == right("externals")), state(unseen, F.col("declared_apart").isNull()),
        state(unseen, ~(either("incomplete") | either("unknown_types"))),
    )
    corroborations = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in zip(CORROBORATIONS, speaks, strict=True)]))
    counters = F.array(*[F.struct(F.lit(n).alias("kind"), c.alias("state")) for n, c in zip(COUNTERS, against, strict=True)])
    found = met.select("nomination", "key", "left", "right", corroborations.alias("corroborations"), counters.alias("counters"))
    lacking = F.lit(COUNTERS[-1])
    separate = F.exists("counters", lambda x: (x["state"] == "present") & (x["kind"] != lacking))
    open_ = F.exists("counters", lambda x: (x["state"] == "unknown") | ((x["state"] == "present") & (x["kind"] == lacking)))
    disposition = F.when(separate, "separate_by_evidence").when(~open_ & (F.size("corroborations") >= 2), "review_candidate").otherwise("inconclusive")
    return found.select("*", disposition.alias("disposition"))
