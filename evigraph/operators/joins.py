"""Joins with more than equality: longest prefix, pattern, wildcard, interval. Each is brought to an equi join or a checked broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_regex
from ..plans.iterate import fresh

#: Patterns that one pass over the paths may try.
MOST_PATTERNS = 10_000
#: Intervals of a bin that one row holds.
LIST = 256


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Each path with the deepest root that is the path itself or one of its ancestors; without one it is left out.

    Ancestors are exploded, so the join is on equality and each path yields as many rows as it is deep.
    """
    parts = F.split(F.col(path), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    keys, copies, depth, at, best = paths.columns, *(fresh(paths, n) for n in ("copies", "depth", "at", "best"))
    counted = paths.groupBy(*keys).agg(F.count("*").alias(copies))  # equal rows meet the roots once and come back as often as they were
    each = counted.select("*", F.posexplode(ancestors).alias(depth, at))
    held = F.struct(*[F.col(c) for c in roots.columns]).alias(best)
    met = each.join(roots.select(F.col(root).alias(at), held), at)
    found = met.groupBy(*keys, copies).agg(F.max(F.struct(F.col(depth), F.col(best))).alias(best))
    return repeated(found.select(*keys, copies, *[F.col(best)[best][c].alias(c) for c in roots.columns]), copies)


def repeated(rows: DataFrame, copies: str) -> DataFrame:
    """Each row as often as a column says, without that column."""
    held, copy = [c for c in rows.columns if c != copies], fresh(rows, "copy")
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).select(*held)


def glob_join(paths: DataFrame, patterns: list[tuple[str, str]], path: str = "path") -> DataFrame:
    """Rows of ``paths`` with each (subject, pattern) that matches: one pass, no join."""
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"{len(patterns)} patterns; at most {MOST_PATTERNS}")
    found = F.filter(
        F.array(*[F.when(F.col(path).rlike(glob_regex(p)), F.struct(F.lit(s).alias("subject"), F.lit(p).alias("pattern"))) for s, p in patterns]),
        lambda x: x.isNotNull(),
    )
    return paths.select("*", F.explode(found).alias("__m")).select(*paths.columns, "__m.subject", "__m.pattern")


def wildcard_match(references: DataFrame, objects: DataFrame, ref: str, equal: list[str], optional: list[str], name: str) -> DataFrame:
    """(ref, matches, outcome, object): ``optional`` columns of a reference match anything where they are null.

    One match is a touch, none is no_static_definition, more are ambiguous. References are split by which optional columns
    they give, so each part is an equi join on counted objects: a hot key meets one row, not all its objects.
    """
    parts = []
    for mask in range(1 << len(optional)):
        given = [c for i, c in enumerate(optional) if mask >> i & 1]
        which = F.lit(True)
        for c in optional:
            which = which & (F.col(c).isNotNull() if c in given else F.col(c).isNull())
        keys = [*equal, *given]
        counted = objects.groupBy(*keys).agg(F.count("*").alias("matches"), F.min(name).alias("object"))
        parts.append(references.filter(which).join(counted, keys, "left").select(ref, F.coalesce("matches", F.lit(0)).alias("matches"), "object"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    outcome = F.when(F.col("matches") == 1, "touch").when(F.col("matches") == 0, "no_static_definition").otherwise("ambiguous")
    return out.select(ref, "matches", outcome.alias("outcome"), F.when(F.col("matches") == 1, F.col("object")).alias("object"))


def narrowest_interval(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, begin: str, end: str, bin_size: Column | float, order: list[str]) -> DataFrame:
    """Each point with the narrowest interval of its keys that holds it (begin and end included), ties by ``order``.

    Intervals are exploded to the bins they touch and points fall in one bin, so the join is on equality. A bin's intervals
    are laid together in lists of at most LIST, the narrowest first: a point meets a row a list and keeps the first that
    holds it, so no row for each point and interval is made or sorted.
    """
    size = F.lit(bin_size) if not isinstance(bin_size, Column) else bin_size
    copies, bin_, best, place = (fresh(points, n) for n in ("copies", "bin", "best", "place"))
    width = fresh(intervals, "width")
    held = [c for c in intervals.columns if c not in keys]
    span = F.struct((F.col(end) - F.col(begin)).alias(width), *order, *[c for c in held if c not in order]).alias(best)
    bins = intervals.select(*keys, F.explode(F.sequence(F.floor(F.col(begin) / size), F.floor(F.col(end) / size))).alias(bin_), span)
    listed = bins.withColumn(place, F.floor((F.row_number().over(Window.partitionBy(*keys, bin_).orderBy(best)) - 1) / LIST))
    lists = listed.groupBy(*keys, bin_, place).agg(F.array_sort(F.collect_list(best)).alias(best))
    placed = points.groupBy(*points.columns).agg(F.count("*").alias(copies)).withColumn(bin_, F.floor(F.col(at) / size))
    first = F.get(F.filter(best, lambda s: F.col(at).between(s[begin], s[end])), F.lit(0))
    met = placed.join(lists, [*keys, bin_]).select(*points.columns, copies, bin_, first.alias(best)).filter(F.col(best).isNotNull())
    found = met.groupBy(*points.columns, copies, bin_).agg(F.min(best).alias(best))  # with the bin, rows stay where the join left them
    return repeated(found.select(*points.columns, copies, *[F.col(best)[c].alias(c) for c in held]), copies)


def full_outer(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Both sides by key with ``values`` as structs ``before`` and ``after``, null where a side has no row."""
    a = left.select(*keys, F.struct(*values).alias("before"))
    b = right.select(*keys, F.struct(*values).alias("after"))
    return a.join(b, keys, "full_outer")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Differences both ways: keys of one side only, with which."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("only", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("only", F.lit("right")))
