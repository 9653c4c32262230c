"""Names and terms: usage, collisions, aliases, corroborated candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ngrams, pair, reportable, tokens
from ..plans.iterate import cut

# Abbreviations, predicates, and words for who does an action or what comes of it.
ABBREVIATIONS = {"cfg": "config", "ctx": "context", "repo": "repository", "req": "request", "resp": "response"}
ACTORS = {
    "builder": "build", "collector": "collect", "converter": "convert", "formatter": "format", "loader": "load", "parser": "parse",
    "planner": "plan", "reader": "read", "renderer": "render", "resolver": "resolve", "validator": "validate", "writer": "write",
}
RESULTS = {
    "building": "build", "collection": "collect", "conversion": "convert", "formatting": "format", "loading": "load", "parsing": "parse",
    "planning": "plan", "reading": "read", "rendering": "render", "resolution": "resolve", "validation": "validate", "writing": "write",
}
PREDICATES = ("can", "has", "is", "supports")


def term_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term): distinct reportable terms of each row."""
    return rows.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).filter(reportable(F.col("term")))


def term_usage(rows: DataFrame, key: str, text: str, at_least: int = 2) -> DataFrame:
    """(term, n_subjects) of terms in at least so many rows. Terms are distinct in a row before the shuffle, so a count is enough."""
    return term_rows(rows, key, text).groupBy("term").agg(F.count("*").alias("n_subjects")).filter(F.col("n_subjects") >= at_least)


def collisions(symbols: DataFrame, name: str, shape: str, file: str) -> DataFrame:
    """Names with two shapes and two files at least."""
    return symbols.groupBy(name).agg(F.countDistinct(shape).alias("n_shapes"), F.countDistinct(file).alias("n_files")).filter("n_shapes >= 2 AND n_files >= 2")


def aliases(symbols: DataFrame, name: str, shape: str) -> DataFrame:
    """Shapes under two names at least, with the first and last name."""
    return symbols.groupBy(shape).agg(F.countDistinct(name).alias("n_names"), F.min(name).alias("first_name"), F.max(name).alias("last_name")).filter("n_names >= 2")


def shared_terms(terms: DataFrame, subject: str = "subject", at_least: int = 2) -> DataFrame:
    """(term, n_subjects, subjects, n_evidence): terms that several kinds of subjects use. Subjects are few kinds."""
    return (
        terms.groupBy("term", subject).agg(F.count("*").alias("n"))
        .groupBy("term").agg(F.count("*").alias("n_subjects"), F.array_join(F.array_sort(F.collect_set(subject)), ",").alias("subjects"), F.sum("n").alias("n_evidence"))
        .filter(F.col("n_subjects") >= at_least)
    )


def _looked_up(table: dict[str, str], word):
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), word)


def parsed(names: DataFrame, name: str) -> DataFrame:
    """Identifiers that name an action: predicate, action, object, qualifiers, construction and how many words were changed.

    Abbreviations are spelt out in every word. An action's own word comes first, or second after a predicate, and the rest is
    its subject; or else the last word says who acts or what comes of it, and all before is the subject. The subject's
    first word is the object. Names with neither, with both, or without a subject give no row.
    """
    rows = names.select("*", tokens(F.col(name)).alias("__words"))
    rows = rows.withColumn("__full", F.transform("__words", lambda w: F.coalesce(_looked_up(ABBREVIATIONS, w), w))).filter(F.size("__full") > 0)
    predicate = F.get("__full", F.lit(0)).isin(*PREDICATES)
    place = F.when(predicate, 2).otherwise(1)
    form, last = F.get("__full", place - 1), F.element_at("__full", -1)
    acts = F.coalesce(form.isin(*{**ACTORS, **RESULTS}.values()), F.lit(False))
    of_last = F.coalesce(_looked_up(ACTORS, last), _looked_up(RESULTS, last))
    size = F.size("__full")
    subject = F.when(acts, F.slice("__full", place + 1, F.greatest(size - place, F.lit(0)))).otherwise(F.slice("__full", F.lit(1), size - 1))
    spelt = F.size(F.array_distinct(F.filter("__words", lambda w: w.isin(*ABBREVIATIONS))))
    construction = F.when(acts, F.when(predicate, "predicate").otherwise("action")).when(_looked_up(ACTORS, last).isNotNull(), "actor").otherwise("result")
    found = rows.filter(acts != of_last.isNotNull()).filter(F.size(subject) > 0)
    return found.select(
        *names.columns, F.when(acts & predicate, F.get("__full", F.lit(0))).alias("predicate"), F.when(acts, form).otherwise(of_last).alias("action"), F.get(subject, F.lit(0)).alias("object"),
        F.array_join(F.slice(subject, F.lit(2), F.size(subject)), " ").alias("qualifiers"), construction.alias("construction"), (spelt + F.when(acts, 0).otherwise(1)).alias("normalisations"),
    )


def action_anchors(parsed_names: DataFrame, name: str) -> DataFrame:
    """For each (predicate, action, object, qualifiers) the surface with fewest changed words, then the first by name."""
    order = Window.partitionBy("predicate", "action", "object", "qualifiers").orderBy("normalisations", name)
    return parsed_names.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def term_matches(rows: DataFrame, key: str, text: str, known: DataFrame, longest: int) -> DataFrame:
    """(key, term): known terms among all runs of up to ``longest`` words of each row."""
    runs = rows.select(key, F.explode(F.array_distinct(ngrams(tokens(F.col(text)), longest))).alias("term"))
    return runs.join(known.select("term").distinct(), "term", "left_semi").select(key, "term")


def semantic_scope(path: Column) -> Column:
    """The folder up to two levels below the first ``src`` above a file; null without one, or directly in it."""
    parts = F.split(path, "/")
    above = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    at = F.array_position(above, "src").cast("int")
    end = F.least(at + 2, F.size(above))
    return F.when((at > 0) & (end > at), F.array_join(F.slice(above, F.lit(1), F.greatest(end, F.lit(0))), "/"))


def suppressions(candidates: DataFrame, distinct_concepts: DataFrame, never_suggest: DataFrame) -> DataFrame:
    """(candidate, kind, reason): why a candidate is not suggested; what is said of its two concepts comes before its terms.

    ``candidates``: (candidate, term_a, term_b, concept_a, concept_b), concepts null where there are not two; the other tables:
    (a, b, reason), once a pair. Pairs are the same whichever way they are written.
    """

    def ordered(rows: DataFrame, name: str) -> DataFrame:
        low, high = pair(F.col("a"), F.col("b"))
        return rows.select(low.alias(f"{name}_low"), high.alias(f"{name}_high"), F.col("reason").alias(f"{name}_reason"))

    both = F.col("concept_a").isNotNull() & F.col("concept_b").isNotNull()
    t, c = pair(F.col("term_a"), F.col("term_b")), pair(F.col("concept_a"), F.col("concept_b"))
    rows = candidates.select("candidate", t[0].alias("term_low"), t[1].alias("term_high"), F.when(both, c[0]).alias("concept_low"), F.when(both, c[1]).alias("concept_high"))
    met = rows.join(ordered(distinct_concepts, "concept"), ["concept_low", "concept_high"], "left").join(ordered(never_suggest, "term"), ["term_low", "term_high"], "left")
    kind = F.when(F.col("concept_reason").isNotNull(), "distinct_from").when(F.col("term_reason").isNotNull(), "never_suggest")
    return met.select("candidate", kind.alias("kind"), F.coalesce("concept_reason", "term_reason").alias("reason")).filter("kind IS NOT NULL")


def sibling_pairs(members: DataFrame, most: int) -> DataFrame:
    """(key, left, right): the first ``most`` pairs of each key across its members, in the order of (left member, right member,
    left, right).

    ``members``: (key, member, item), no row null. Members are counted first; only pairs of members that hold one of the
    first pairs meet, so a key of many items makes no more rows than it gives out, but for its last pair of members.
    """
    items = members.select("key", "member", "item").distinct()
    by_key = Window.partitionBy("key").orderBy("member")
    sizes = items.groupBy("key", "member").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("key")
    ranked = cut(
        sizes.select("*", F.row_number().over(by_key).alias("place"), F.count("*").over(whole).alias("places"), (F.sum("n").over(whole) - F.sum("n").over(by_key)).alias("after")).withColumn("before", F.sum(F.col("n") * F.col("after")).over(by_key) - F.col("n") * F.col("after"))
    )
    lefts = ranked.filter((F.col("before") < most) & (F.col("place") < F.col("places")))
    last = F.least(F.col("places"), F.col("place") + (F.lit(most) - F.col("before")))
    reach = lefts.select("key", "member", "n", "before", F.explode(F.sequence(F.col("place").cast("long") + 1, last.cast("long"))).alias("place"))
    met = reach.join(ranked.select("key", F.col("place").cast("long").alias("place"), F.col("member").alias("other"), F.col("n").alias("m")), ["key", "place"])
    run = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("key", "member").orderBy("place")) - F.col("n") * F.col("m")
    wanted = met.withColumn("before", F.col("before") + run).filter(F.col("before") < most).select("key", "member", "other", "m", "before")
    inside = items.withColumn("r", F.row_number().over(Window.partitionBy("key", "member").orderBy("item")))
    left = wanted.join(inside.withColumnRenamed("item", "left"), ["key", "member"]).filter(F.col("before") + (F.col("r") - 1) * F.col("m") < most)
    right = inside.select("key", F.col("member").alias("other"), F.col("item").alias("right"), F.col("r").alias("s"))
    at = F.col("before") + (F.col("r") - 1) * F.col("m") + F.col("s")
    return left.join(right, ["key", "other"]).filter(at <= most).select("key", "left", "right")


def counted_terms(terms: DataFrame) -> DataFrame:
    """(term, subject, n) of terms (term, subject, owner)."""
    return terms.groupBy("term", "subject").agg(F.count("*").alias("n"))


def repository_relationships(terms: DataFrame, owners: DataFrame, domain: DataFrame, general: DataFrame, distinct_concepts: DataFrame, never_suggest: DataFrame) -> DataFrame:
    """(basis, terms, concepts, n_subjects, n_evidence, n_domain, n_general): what ties the terms that several kinds of subjects use.

    ``terms``: (term, subject, owner), or counted (term, subject, n) as by ``counted_terms``; ``owners``: (term, concept), one a term; ``domain`` and ``general``: (a, b, relation) between terms;
    the last two: (a, b, reason), pairs of concepts or terms that are not suggested. exact_normalized_term: one term of two kinds of
    subjects. declared_concept: two terms or more of a concept, of two kinds. pinned_domain_relation: two terms that a
    relation pins, one of them used by a kind of subject that the other has besides or instead. Terms are summed up by subject before any join, so a
    relation meets one row a term, however often that is used.
    """
    empty, low, high = F.array().cast("array<string>"), *pair(F.col("a"), F.col("b"))
    used = terms if "n" in terms.columns else cut(counted_terms(terms))
    by_term = cut(used.groupBy("term").agg(F.collect_set("subject").alias("subjects"), F.sum("n").alias("n")).join(owners.select("term", "concept"), "term", "left"))
    concepts_of = lambda *c: F.array_sort(F.array_distinct(F.array_compact(F.array(*c))))
    exact = by_term.filter(F.size("subjects") >= 2).select(F.lit("exact_normalized_term").alias("basis"), F.array("term").alias("terms"), concepts_of("concept").alias("concepts"), F.size("subjects").alias("n_subjects"), F.col("n").alias("n_evidence"), F.lit(0).cast("long").alias("n_domain"), F.lit(0).cast("long").alias("n_general"))
    held = by_term.filter("concept IS NOT NULL").groupBy("concept").agg(F.array_sort(F.collect_set("term")).alias("terms"), F.array_distinct(F.flatten(F.collect_list("subjects"))).alias("subjects"), F.sum("n").alias("n"))
    declared = held.filter((F.size("terms") >= 2) & (F.size("subjects") >= 2)).select(F.lit("declared_concept").alias("basis"), "terms", F.array("concept").alias("concepts"), F.size("subjects").alias("n_subjects"), F.col("n").alias("n_evidence"), F.lit(0).cast("long").alias("n_domain"), F.lit(0).cast("long").alias("n_general"))

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(low.alias("low"), high.alias("high"), "relation").distinct().groupBy("low", "high").agg(F.count("*").alias(name))

    ends = [by_term.select(F.col("term").alias(end), F.col("subjects").alias(f"{end}_subjects"), F.col("n").alias(f"{end}_n"), F.col("concept").alias(f"{end}_concept")) for end in ("low", "high")]
    met = counted(domain, "n_domain").join(ends[0], "low").join(ends[1], "high").join(counted(general, "n_general"), ["low", "high"], "left")
    alone = (F.size("low_subjects") == 1) & (F.size("high_subjects") == 1) & (F.get("low_subjects", F.lit(0)) == F.get("high_subjects", F.lit(0)))
    named = met.filter(~alone).withColumn("candidate", F.concat_ws("\x1f", "low", "high"))
    two = (F.col("low_concept") != F.col("high_concept")) & F.col("low_concept").isNotNull() & F.col("high_concept").isNotNull()
    asked = named.select("candidate", F.col("low").alias("term_a"), F.col("high").alias("term_b"), F.when(two, F.col("low_concept")).alias("concept_a"), F.when(two, F.col("high_concept")).alias("concept_b"))
    left = named.join(suppressions(asked, distinct_concepts, never_suggest).select("candidate"), "candidate", "left_anti")
    pinned = left.select(F.lit("pinned_domain_relation").alias("basis"), F.array("low", "high").alias("terms"), concepts_of("low_concept", "high_concept").alias("concepts"), F.size(F.array_union("low_subjects", "high_subjects")).alias("n_subjects"), (F.col("low_n") + F.col("high_n")).alias("n_evidence"), "n_domain", F.coalesce("n_general", F.lit(0)).cast("long").alias("n_general"))
    return exact.withColumn("terms", F.coalesce("terms", empty)).unionByName(declared).unionByName(pinned)
