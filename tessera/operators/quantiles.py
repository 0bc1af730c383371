"""Exact quantiles of groups of any size, by distributed selection.

A round lays cuts of near equal depth through the interval of values in which a rank lies (from a sketch of bounded size),
counts the group's rows between them, and goes on with the one interval that holds the rank. When few enough rows are
left, they are sorted and the rank is read off. No group's values are held by one task, and no state grows with a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import checked, stored

GRID = 256  # intervals that a round lays through one


def exact_quantiles(df: DataFrame, by: list[str], value: str, percents: dict[str, float], most: int = 100_000) -> DataFrame:
    """(by..., one column for each of ``percents``): linear between the two nearest ranks, as doubles.

    Null values are left out; a group without any has nulls. Not-a-numbers are above all numbers. Groups of up to ``most``
    values are aggregated as they are, larger ones go by selection; ``most`` also bounds the rows of an interval that are
    sorted at a time. It changes no result.
    """
    keys = [f"_{i}" for i in range(len(by))]
    rows = df.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col(value).cast("double").alias("v"))
    counted = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest"))
    large = stored(counted.where(F.col("n") > most), "large-groups")
    plain = rows if not large.limit(1).count() else _joined(rows, checked(large.select(*keys)), keys, "left_anti")
    out = plain.groupBy(*keys).agg(*(F.percentile("v", F.lit(float(p))).alias(name) for name, p in percents.items()))
    if plain is not rows:
        out = out.unionByName(_selected(rows, large, keys, percents, most))
    return out.select(*(F.col(k).alias(b) for k, b in zip(keys, by, strict=True)), *percents)


def _selected(rows: DataFrame, sizes: DataFrame, keys: list[str], percents: dict[str, float], most: int) -> DataFrame:
    """The same for the groups of ``sizes``, by selection."""
    asked = F.inline(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in percents.items())))
    exact = sizes.where("n > 0").select(*keys, "n", "least", "greatest", asked).withColumn("at", F.col("p") * (F.col("n") - 1))
    floor = F.floor("at").cast("long")
    ranks = stored(exact.select(*keys, "n", "least", "greatest", F.inline(F.array(F.struct(floor.alias("rank")), F.struct(F.least(floor + 1, F.col("n") - 1).alias("rank"))))).distinct(), "ranks")
    # An interval is open below and closed above; null bounds are open ends. ``before`` counts the group's rows below it.
    none = F.lit(None).cast("double")
    open_ = ranks.select(*keys, "rank", F.lit(0).cast("long").alias("before"), "n", none.alias("lo"), none.alias("hi"), "least", "greatest")
    while True:
        done, large = open_.where(f"n <= {most} OR least = greatest"), open_.where(f"n > {most} AND least < greatest")
        if not large.limit(1).count():
            break
        inside = stored(large.select(*keys, "lo", "hi").distinct(), "intervals")
        met = _within(rows, inside, keys)
        cuts = met.groupBy(*keys, "lo", "hi").agg(F.array_distinct(F.percentile_approx("v", [i / GRID for i in range(1, GRID)], 16 * GRID)).alias("cuts"))
        cuts = stored(cuts, "cuts")
        k = F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("k")
        part = _within(rows, cuts, keys).groupBy(*keys, "lo", "hi", "cuts", k).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("a"), F.max("v").alias("b"))
        along = Window.partitionBy(*keys, "lo", "hi").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # GRID rows at most
        part = part.withColumn("below", F.coalesce(F.sum("m").over(along), F.lit(0)))
        part = part.select(*keys, "lo", "hi", F.when(F.col("k") > 0, F.get("cuts", F.col("k") - 1)).otherwise(F.col("lo")).alias("lo2"), F.coalesce(F.get("cuts", F.col("k")), F.col("hi")).alias("hi2"), "m", "a", "b", "below")
        joined = _joined(large, part, [*keys, "lo", "hi"]).where((F.col("rank") - F.col("before") >= F.col("below")) & (F.col("rank") - F.col("before") < F.col("below") + F.col("m")))
        nxt = joined.select(*keys, "rank", (F.col("before") + F.col("below")).alias("before"), F.col("m").alias("n"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("a").alias("least"), F.col("b").alias("greatest"))
        open_ = stored(done.unionByName(nxt), "intervals")
    one = done.where("least = greatest").select(*keys, "rank", F.col("least").alias("x"))
    left = done.where("least < greatest")
    order = Window.partitionBy(*keys, "lo", "hi").orderBy("v")
    sorted_ = _within(rows, left.select(*keys, "lo", "hi").distinct(), keys).withColumn("place", F.row_number().over(order) - 1)
    read = _joined(left, sorted_, [*keys, "lo", "hi"]).where(F.col("rank") - F.col("before") == F.col("place")).select(*keys, "rank", F.col("v").alias("x"))
    found = stored(one.unionByName(read), "found")
    at = lambda name: found.withColumnsRenamed({"x": name})
    low = _joined(exact.withColumn("rank", floor), at("x0"), [*keys, "rank"]).drop("rank")
    both = _joined(low.withColumn("rank", F.least(floor + 1, F.col("n") - 1)), at("x1"), [*keys, "rank"])
    part = F.col("at") - floor
    told = both.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.when(part == 0, F.col("x0")).otherwise(F.col("x0") + (F.col("x1") - F.col("x0")) * part))).alias(name) for name in percents))
    return told.select(*keys, *percents)


def _within(rows: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the interval of their group that they lie in; an interval's other columns come along."""
    side = checked(intervals).withColumnsRenamed({k: f"r{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"r{k}")) for k in keys), F.lit(True))
    inside = (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") <= F.col("hi")))
    return rows.where("v IS NOT NULL").join(side, same & inside).drop(*(f"r{k}" for k in keys))


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null; right columns of the same names go."""
    renamed = right.withColumnsRenamed({k: f"r{k}" for k in on})
    same = reduce(lambda a, b: a & b, (left[k].eqNullSafe(renamed[f"r{k}"]) for k in on), F.lit(True))
    return left.join(renamed, same, how).drop(*(f"r{k}" for k in on)) if how != "left_anti" else left.join(renamed, same, how)
