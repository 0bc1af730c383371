"""Joins that Spark has no single operator for, from its own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import BIN_ROWS, carried, running_sum


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], at: str, take: list[str], bin_rows: int = BIN_ROWS) -> DataFrame:
    """Every left row with the columns ``take`` of the last right row at or before it; nulls if there is none.

    Both sides are stacked and the last right row is carried forward: no pairs, and a key with very many rows goes in bins.
    """
    one = left.withColumn("side", F.lit(1))
    two = right.select(*by, at, F.lit(0).alias("side"), F.struct(*take).alias("found"))
    both = carried(one.unionByName(two, allowMissingColumns=True), by, [at, "side"], F.col("found"), "last_found", bin_rows=bin_rows)
    return both.where("side = 1").select(*left.columns, *(F.col("last_found")[c].alias(c) for c in take))


def interval_join(left: DataFrame, right: DataFrame, by: list[str], at: str, seconds: int) -> DataFrame:
    """Pairs with the same keys and left.at < right.at <= left.at + seconds, by an equi-join on time bins.

    A left row goes to the bin it lies in and the next one, a right row to its own, so a key's rows meet bin by bin.
    """
    bin_of = lambda c: F.floor(F.unix_micros(c) / F.lit(seconds * 1_000_000))
    one = left.withColumn("bin", F.explode(F.array(bin_of(at), bin_of(at) + 1))).withColumnRenamed(at, "left_at")
    two = right.withColumn("bin", bin_of(at)).withColumnRenamed(at, "right_at")
    near = (F.col("right_at") > F.col("left_at")) & (F.unix_micros("right_at") <= F.unix_micros("left_at") + seconds * 1_000_000)
    return one.join(two, [*by, "bin"]).where(near).drop("bin")


def counts_within(left: DataFrame, right: DataFrame, by: list[str], at: str, seconds: int, row_id: str, bin_rows: int = BIN_ROWS) -> DataFrame:
    """(row_id, n): for each left row, whose ids are distinct, the right rows with its keys and left.at < right.at <= left.at + seconds.

    The difference of two running counts, so no pairs are made: each left row asks at its own time and at the end of its span.
    """
    times = F.array(F.struct(F.unix_micros(at).alias("t"), F.lit(-1).alias("sign")), F.struct((F.unix_micros(at) + seconds * 1_000_000).alias("t"), F.lit(1).alias("sign")))
    asked = left.where(F.col(at).isNotNull()).select(*by, F.col(row_id).alias("id"), F.inline(times), F.lit(1).alias("side"))
    there = right.where(F.col(at).isNotNull()).select(*by, F.lit(None).cast(dict(left.dtypes)[row_id]).alias("id"), F.unix_micros(at).alias("t"), F.lit(0).alias("sign"), F.lit(0).alias("side"))
    counted = running_sum(asked.unionByName(there), by, ["t", "side"], 1 - F.col("side"), "upto", bin_rows).where("side = 1")
    return counted.groupBy(F.col("id").alias(row_id)).agg(F.sum(F.col("sign") * F.col("upto")).cast("long").alias("n"))
