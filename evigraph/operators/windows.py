"""Operators over total orders: pages, caps, round robins, pruning, pairwise cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import fresh


def page(rows: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """Rows at places offset + 1 to offset + size of the order, with their place and how many are left after the page.

    The order is taken by top-k selection of offset + size rows, so no task sorts the whole table.
    """
    total = rows.groupBy().agg(F.count("*").alias("total"))
    head = rows.orderBy(*order).limit(offset + size)
    placed = head.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return placed.filter(F.col("place") > offset).join(F.broadcast(total)).withColumn("remaining", F.greatest(F.col("total") - (offset + size), F.lit(0).cast("long"))).drop("total")


def first_keys(rows: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """The distinct rows with the first ``most`` keys of each group. Each task drops what comes later before anything is shuffled."""
    place = fresh(rows, "place")
    placed = rows.withColumn(place, F.dense_rank().over(Window.partitionBy(*group).orderBy(*order)))
    return placed.filter(F.col(place) <= most).drop(place).distinct()


def round_robin(rows: DataFrame, group: list[str], subject: str, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each group, taken from its subjects in turn."""
    turn = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*group, subject).orderBy(*order))).filter(F.col("turn") <= most)
    return turn.withColumn("pick", F.row_number().over(Window.partitionBy(*group).orderBy("turn", subject))).filter(F.col("pick") <= most)


def nominations(keys: DataFrame, per_key: int, ceiling: int) -> DataFrame:
    """(kind_ord, key, possible, allowed, omission): pairs that each key may nominate, in (kind_ord, key) order.

    A key takes at most ``per_key`` and what the set's ceiling leaves. ``omission`` says which limit cut it. One row a key;
    only the cumulative sums cross partitions, by way of per-block totals.
    """
    wish = F.least("possible", F.lit(per_key))
    order = Window.partitionBy("kind_ord").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    kinds = keys.groupBy("kind_ord").agg(F.sum(wish).alias("kind_total"))
    before = kinds.select("kind_ord", F.coalesce(F.sum("kind_total").over(Window.orderBy("kind_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    taken = keys.join(F.broadcast(before), "kind_ord").withColumn("before", F.col("earlier") + F.coalesce(F.sum(wish).over(order), F.lit(0)))
    left = F.greatest(F.lit(ceiling) - F.col("before"), F.lit(0))
    allowed = F.least(wish, left)
    omission = F.when(F.col("possible") <= allowed, F.lit("none")).when(left < wish, F.lit("comparison_set")).otherwise(F.lit("per_key"))
    return taken.select("kind_ord", "key", "possible", allowed.alias("allowed"), omission.alias("omission"))


def prune_oldest(entries: DataFrame, most: int) -> DataFrame:
    """Entries (path, mtime, bytes) to delete: in (mtime, path) order while what is left is over ``most`` bytes."""
    total = entries.groupBy().agg(F.sum("bytes").alias("total"))
    day = entries.withColumn("day", F.to_date("mtime"))
    days = day.groupBy("day").agg(F.sum("bytes").alias("day_bytes"))
    earlier = days.select("day", F.coalesce(F.sum("day_bytes").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("day").orderBy("mtime", "path").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("earlier") + F.coalesce(F.sum("bytes").over(within), F.lit(0))
    return day.join(earlier, "day").withColumn("before", before).join(F.broadcast(total)).filter(F.col("total") - F.col("before") > most).select(*entries.columns)


def pairwise_cases(dimensions: DataFrame, cap: int) -> DataFrame:
    """(owner, case, complete): for each owner of dimensions (owner, dimension, size) the cases that try all pairs of values.

    A case is the array of (dimension, value) that differ from the baseline of zeros. First comes the baseline, then each dimension alone, then
    the grid of each two dimensions; a case counts where it comes first, and the first ``cap`` stay. ``complete`` tells if that is all.
    """
    point, count, kind = F.struct(F.col("dimension").alias("d"), F.col("v").alias("v")), dimensions.schema["size"].dataType, dimensions.schema["dimension"].dataType
    values = lambda size: F.explode(F.when(F.col(size) > 0, F.sequence(F.lit(0).cast(count), F.col(size) - 1)))
    zero = F.lit(0).cast(count)
    none, nowhere = F.array().cast(f"array<struct<d:{kind.simpleString()},v:{count.simpleString()}>>"), F.lit(-1).cast(kind)
    base = dimensions.select("owner").distinct().select("owner", none.alias("points"), F.struct(F.lit(0).alias("turn"), nowhere.alias("l"), nowhere.alias("r"), zero.alias("a"), zero.alias("b")).alias("rank"))
    single = dimensions.select("owner", "dimension", values("size").alias("v")).select("owner", F.array(point).alias("points"), F.struct(F.lit(1).alias("turn"), F.col("dimension").alias("l"), nowhere.alias("r"), F.col("v").alias("a"), zero.alias("b")).alias("rank"))
    left, right = (dimensions.select("owner", F.col("dimension").alias(n), F.col("size").alias(f"{n}_size")) for n in ("l", "r"))
    grid = left.join(right, "owner").filter("l < r").select("owner", "l", "r", values("l_size").alias("a"), "r_size").select("owner", "l", "r", "a", values("r_size").alias("b"))
    both = F.array(F.struct(F.col("l").alias("d"), F.col("a").alias("v")), F.struct(F.col("r").alias("d"), F.col("b").alias("v")))
    pairs = grid.select("owner", both.alias("points"), F.struct(F.lit(2).alias("turn"), "l", "r", "a", "b").alias("rank"))
    cases = base.unionByName(single).unionByName(pairs).select("owner", F.filter("points", lambda x: x["v"] > 0).alias("case"), "rank").groupBy("owner", "case").agg(F.min("rank").alias("rank"))
    placed = cases.select("owner", "case", F.row_number().over(Window.partitionBy("owner").orderBy("rank")).alias("place"), F.count("*").over(Window.partitionBy("owner")).alias("all"))
    return placed.filter(F.col("place") <= cap).select("owner", "case", (F.col("all") <= cap).alias("complete"))
