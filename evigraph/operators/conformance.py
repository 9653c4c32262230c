"""Declared constraints, observed facts, exceptions, approved providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import any_rows, cut, shuffled, union_all

#: Pairs of a rule and a result that a task joins of one group.
PART = 1_000_000


def exactly_one(objects: DataFrame, relations: DataFrame, key: str) -> DataFrame:
    """(key, n): objects without exactly one incoming relation."""
    counted = relations.groupBy(key).agg(F.count("*").alias("n"))
    return objects.select(key).join(counted, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")).filter("n <> 1")


def required(objects: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return objects.select(key).join(present.select(key).distinct(), key, "left_anti")


def forbidden_present(constraints: DataFrame, relations: DataFrame) -> DataFrame:
    """(constraint): forbidden relations (constraint, predicate, subject, object) that are there."""
    return constraints.join(relations.select("predicate", "subject", "object").distinct(), ["predicate", "subject", "object"], "left_semi").select("constraint").distinct()


def without_contract(constraints: DataFrame, objects: DataFrame) -> DataFrame:
    """(constraint, object): objects (object, kind, visibility, contract) of the constraint's kind, and visibility if it gives
    one, that name no contract. The optional column splits the constraints, so both parts are joins on equality."""
    lacking = objects.filter("contract IS NULL")
    any_ = constraints.filter("visibility IS NULL").select("constraint", "kind").join(lacking, "kind")
    one = constraints.filter("visibility IS NOT NULL").select("constraint", "kind", "visibility").join(lacking, ["kind", "visibility"])
    return any_.select("constraint", "object").unionByName(one.select("constraint", "object")).distinct()


def prohibited_paths(constraints: DataFrame, via: DataFrame, relations: DataFrame) -> DataFrame:
    """(constraint): constraints (constraint, start, goal) whose goal can be reached from their start over relations of their
    own predicates (``via``: constraint, predicate). A node reaches itself. Only what is new in a round goes on."""
    steps = cut(relations.select("predicate", F.col("subject").alias("node"), F.col("object").alias("next")).distinct())
    allowed = cut(via.select("constraint", "predicate").distinct())
    frontier = cut(constraints.select("constraint", F.col("start").alias("node")).distinct())
    seen = frontier
    while True:
        reached = frontier.join(allowed, "constraint").join(steps, ["predicate", "node"]).select("constraint", F.col("next").alias("node")).distinct()
        frontier = cut(reached.join(seen, ["constraint", "node"], "left_anti"))
        if not any_rows(frontier):
            break
        seen = seen.unionByName(frontier)
    return constraints.join(seen.select("constraint", F.col("node").alias("goal")), ["constraint", "goal"], "left_semi").select("constraint").distinct()


def cyclic_predicates(relations: DataFrame) -> DataFrame:
    """(predicate): predicates with a cycle among their relations (predicate, subject, object).

    Edges whose subject nobody points to, or whose object points to nobody, lie on no cycle and go, until none is left to
    go; a predicate has a cycle where edges stay. No pairs of a closure are built.
    """
    left, before = cut(relations.select("predicate", "subject", "object").distinct()), None
    while True:
        now = left.count()
        if now == before:
            return left.select("predicate").distinct()
        before = now
        targets = left.select("predicate", F.col("object").alias("subject")).distinct()
        sources = left.select("predicate", F.col("subject").alias("object")).distinct()
        left = cut(left.join(targets, ["predicate", "subject"], "left_semi").join(sources, ["predicate", "object"], "left_semi").select("predicate", "subject", "object"))


def eligible(status: Column, governing: Column, approval: Column, review: bool) -> Column:
    """Declarations that count: under review those accepted, proposed or unresolved; else accepted ones with a governing
    authority (an array) whose approval is granted or not required."""
    if review:
        return F.coalesce(status.isin("accepted", "proposed", "unresolved"), F.lit(False))
    return F.coalesce((status == "accepted") & (F.size(governing) > 0) & approval.isin("granted", "not_required"), F.lit(False))


def dangling_references(references: DataFrame, declared: DataFrame, exported: DataFrame) -> DataFrame:
    """(source, target, problem): references (source, target, document, target_document) to what nobody declares, or to
    what another document declares without exporting it. ``declared``, ``exported``: (target)."""
    missing = references.join(declared.select("target").distinct(), "target", "left_anti").select("source", "target", F.lit("missing").alias("problem"))
    foreign = references.filter(F.col("document") != F.col("target_document")).join(declared.select("target").distinct(), "target", "left_semi")
    hidden = foreign.join(exported.select("target").distinct(), "target", "left_anti").select("source", "target", F.lit("not_exported").alias("problem"))
    return union_all([missing, hidden]).distinct()


def states(bindings: DataFrame, facts: DataFrame, coverage: DataFrame) -> DataFrame:
    """(binding, state) by the first rule that fits: inferred facts are ambiguous; without coverage, or with some that is
    unsupported or unknown, nothing is observed; partial coverage gives partial if there are facts, else unobserved; a fact of
    another kind conflicts; too few or too many facts conflict, but are absent where one is required and none is there.

    ``bindings``: (binding, target, kind, cardinality, adapter), cardinality being exactly_one, at_most_one, one_or_more or any;
    ``facts``: (target, binding, kind, inferred), one without a binding being about every binding of its target;
    ``coverage``: (feature, level), any number of rows for an adapter. Facts are summed up before they meet bindings.
    """
    summed = facts.groupBy(F.col("target").alias("t"), F.col("binding").alias("b"), F.col("kind").alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("inferred").cast("int")).alias("inferred"))
    named = bindings.select("binding", "target", "kind")
    of_all = named.join(summed.filter("b IS NULL"), F.col("t") == F.col("target"))
    of_one = named.join(summed.filter("b IS NOT NULL"), (F.col("t") == F.col("target")) & (F.col("b") == F.col("binding")))
    counted = of_all.unionByName(of_one).groupBy("binding").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("k") != F.col("kind"), F.col("n")).otherwise(0)).alias("other"), F.sum("inferred").alias("inferred"))
    covered = coverage.groupBy(F.col("feature").alias("adapter")).agg(F.max(F.col("level").isin("unsupported", "unknown")).alias("lacking"), F.max(F.col("level") == "partial").alias("partial"))
    n = F.coalesce("n", F.lit(0))
    fits = F.when(F.col("cardinality") == "exactly_one", n == 1).when(F.col("cardinality") == "at_most_one", n <= 1).when(F.col("cardinality") == "one_or_more", n >= 1).otherwise(True)
    state = (
        F.when(F.col("inferred") > 0, "ambiguous")
        .when(F.coalesce("lacking", F.lit(True)), "unobserved")
        .when(F.col("partial"), F.when(n > 0, "partial").otherwise("unobserved"))
        .when(F.col("other") > 0, "conflicting")
        .when(~fits, F.when((n == 0) & F.col("cardinality").isin("exactly_one", "one_or_more"), "absent").otherwise("conflicting"))
        .otherwise("matched")
    )
    return bindings.join(covered, "adapter", "left").join(counted, "binding", "left").select("binding", state.alias("state"))


def unexpected(facts: DataFrame, *declared: DataFrame) -> DataFrame:
    """Facts (target, ...) about nothing that is declared."""
    out = facts
    for d in declared:
        out = out.join(d.select("target").distinct(), "target", "left_anti")
    return out


def exceptions(results: DataFrame, rules: DataFrame, as_of: Column, part: int = PART) -> DataFrame:
    """(result, exception, state): applied, stale, expired, irrelevant or rejected.

    ``results``: (result, constraint, version, scope, severity), a result once; ``rules``: (exception, constraint, version, scope, approved, expires).
    Only an error can be excepted and the first that applies, by id, does; a further one is irrelevant. The first is the same for all
    results of a constraint, scope and version, so it is found before rules and results meet, and nothing is shuffled after. Rules of a constraint and scope
    are dealt in parts, so that a task gives out about ``part`` rows of it; the result itself is as large as such groups make it.
    """
    keys = ["constraint", "scope"]
    first = rules.filter(F.col("approved") & (as_of < F.col("expires"))).groupBy(*keys, "version").agg(F.min("exception").alias("first"))
    sizes = cut(rules.groupBy(*keys).agg(F.count("*").alias("n")).join(results.groupBy(*keys).agg(F.count("*").alias("m")), keys))
    pairs = sizes.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    tasks = max(-(-pairs // part), int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # as many as the result needs, since both sides are small
    dealt = shuffled(sizes.filter(F.col("n") * F.col("m") > part).select(*keys, F.least(F.col("n"), F.ceil(F.col("n") * F.col("m") / part)).cast("int").alias("parts")))
    many = F.coalesce("parts", F.lit(1))
    left = rules.join(dealt, keys, "left").withColumn("part", F.pmod(F.xxhash64("exception"), many).cast("int")).drop("parts")
    right = results.join(first, [*keys, "version"], "left").join(dealt, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), many - 1))).drop("parts")
    left, right = (rows.repartition(tasks, *keys, "part") for rows in (left, right))
    met = shuffled(left).alias("x").join(right.alias("r"), [F.col(f"x.{k}") == F.col(f"r.{k}") for k in (*keys, "part")], "left")
    state = (
        F.when(~F.col("x.approved"), "rejected")
        .when(as_of >= F.col("x.expires"), "expired")
        .when(F.col("r.result").isNull() | (F.col("r.severity") != "error"), "irrelevant")
        .when(F.col("x.version") != F.col("r.version"), "stale")
        .when(F.col("x.exception") != F.col("r.first"), "irrelevant")
        .otherwise("applied")
    )
    return met.select("r.result", "x.exception", state.alias("state"))


def approved_providers(relations: DataFrame) -> DataFrame:
    """(capability, provider, contract, owner, duplicate) from relations (predicate, subject, object)."""

    def of(predicate: str, subject: str, object_: str) -> DataFrame:
        return relations.filter(F.col("predicate") == predicate).select(F.col("subject").alias(subject), F.col("object").alias(object_)).distinct()

    found = of("approves", "approval", "provider").join(of("covers", "approval", "capability"), "approval").join(of("provides", "provider", "capability"), ["provider", "capability"])
    full = found.join(of("contract", "provider", "contract"), "provider", "left").join(of("owned_by", "provider", "owner"), "provider", "left")
    several = F.count("*").over(Window.partitionBy("capability")) > 1
    return full.select("capability", "provider", "contract", "owner", several.alias("duplicate"))
