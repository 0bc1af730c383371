"""Ordered scans of keys of any size, in two levels.

A key with more than ``bin_rows`` rows is cut into bins of time at quantiles of its own times. Bins are scanned like keys
of their own, each leaves a summary of bounded size, and a key's summaries, at most ``CUTS`` of them, are scanned in order;
what comes out is carried into the next bin. A key below that size is one bin. Rows of one instant are never parted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import checked, stored

BIN_ROWS = 100_000
CUTS = 1024  # bins of a key at most


def binned(df: DataFrame, by: list[str], at: str, bin_rows: int = BIN_ROWS, name: str = "bin") -> DataFrame:
    """Adds ``name``: null for rows of a key that is one bin, else the number of the row's bin, rising with the time ``at``."""
    times = F.unix_micros(at) if dict(df.dtypes)[at].startswith("timestamp") else F.col(at).cast("long")
    keys = [F.col(k).alias(f"_{k}") for k in by]
    large = stored(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > bin_rows), "large-keys")
    if not large.limit(1).count():
        return df.withColumn(name, F.lit(None).cast("int"))
    same = lambda side: reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(side[f"_{k}"]) for k in by))
    sent = checked(large)
    cuts = df.join(sent, same(sent)).groupBy(*(f"_{k}" for k in by), "_rows").agg(F.percentile_approx(times, [i / CUTS for i in range(1, CUTS)], 10 * CUTS).alias("_cuts"))
    cuts = checked(stored(cuts, "cuts"))
    # Of the finest bins as many are taken together as the key's size asks for.
    fine = F.size(F.filter("_cuts", lambda c: c < times))
    bins = F.floor(fine * F.least(F.lit(CUTS), F.ceil(F.col("_rows") / bin_rows)) / CUTS).cast("int")
    return df.join(cuts, same(cuts), "left").withColumn(name, bins).drop(*(f"_{k}" for k in by), "_rows", "_cuts")


def carried(df: DataFrame, by: list[str], order: list[str], value: Column, name: str, backwards: bool = False, inclusive: bool = True, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Adds ``name``: of each row's key the last ``value`` that is not null up to the row (``backwards``: the next one from it on); itself counts if ``inclusive``."""
    rows = binned(df, by, order[0], bin_rows, "_bin").withColumn("_value", F.struct(value.alias("v")))
    rows = rows.withColumn("_value", F.when(F.col("_value.v").isNotNull(), F.col("_value")))
    turned = [F.desc(c) for c in order] if backwards else list(order)
    along = Window.partitionBy(*by, "_bin").orderBy(*turned).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = F.last("_value", ignorenulls=True).over(along)
    if not _has_bins(rows):
        return rows.withColumn(name, own["v"]).drop("_bin", "_value")
    pick = F.min_by if backwards else F.max_by
    edges = rows.where("_bin IS NOT NULL AND _value IS NOT NULL").groupBy(*by, "_bin").agg(pick("_value", F.struct(*order)).alias("_edge"))
    # Bins without a value have no edge: every bin looks up the last edge before it.
    every = _joined(rows.where("_bin IS NOT NULL").select(*by, "_bin").distinct(), edges, [*by, "_bin"])
    before = Window.partitionBy(*by).orderBy(F.desc("_bin") if backwards else F.col("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    into = stored(every.withColumn("_into", F.last("_edge", ignorenulls=True).over(before)).select(*by, "_bin", "_into"), "edges")
    out = _joined(rows.withColumn("_own", own), checked(into), [*by, "_bin"])
    return out.withColumn(name, F.coalesce("_own", "_into")["v"]).drop("_bin", "_value", "_own", "_into")


def running_sum(df: DataFrame, by: list[str], order: list[str], value: Column, name: str, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Adds ``name``: the sum of a key's ``value`` up to the row, itself included; null values add nothing."""
    rows = binned(df, by, order[0], bin_rows, "_bin").withColumn("_value", F.coalesce(value, F.lit(0)))
    own = F.sum("_value").over(Window.partitionBy(*by, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if not _has_bins(rows):
        return rows.withColumn(name, own).drop("_bin", "_value")
    sums = rows.where("_bin IS NOT NULL").groupBy(*by, "_bin").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    into = stored(sums.withColumn("_into", F.sum("_sum").over(before)).drop("_sum"), "sums")
    out = _joined(rows.withColumn("_own", own), checked(into), [*by, "_bin"])
    return out.withColumn(name, F.col("_own") + F.coalesce("_into", F.lit(0))).drop("_bin", "_value", "_own", "_into")


def _has_bins(rows: DataFrame) -> bool:
    """False where binned found no large key: the column is a null in the plan, not a join's result."""
    return "_cuts" in rows._jdf.queryExecution().analyzed().toString()


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A left join on keys that may be null."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    same = reduce(lambda a, b: a & b, (left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in on))
    return left.join(renamed, same, "left").drop(*(f"_r_{k}" for k in on))


def runs_of(df: DataFrame, by: list[str], order: list[str], kind: str, steps: list[str], bin_rows: int = BIN_ROWS) -> DataFrame:
    """The rows that begin a strict run: the key's next rows have exactly the kinds ``steps``.

    Runs inside a bin are found in the bin. One that goes over borders begins in the last rows of a bin, and lies in the
    strips of len(steps) - 1 rows at both ends of the key's bins, whose rows are next to each other from there on.
    """
    rows = binned(df, by, order[0], bin_rows, "_bin")

    def hit(w) -> Column:
        return reduce(lambda a, b: a & b, (F.coalesce((F.col(kind) if i == 0 else F.lead(kind, i).over(w)) == s, F.lit(False)) for i, s in enumerate(steps)))

    inside = Window.partitionBy(*by, "_bin").orderBy(*order)
    found = rows.withColumn("_hit", hit(inside))
    whole = found.where("_hit").drop("_hit", "_bin")
    if not _has_bins(rows) or len(steps) < 2:
        return whole
    n = len(steps) - 1
    end = Window.partitionBy(*by, "_bin").orderBy(*(F.desc(c) for c in order))
    strips = rows.where("_bin IS NOT NULL").withColumns({"_from": F.row_number().over(inside), "_to": F.row_number().over(end)}).where((F.col("_from") <= n) | (F.col("_to") <= n))
    along = Window.partitionBy(*by).orderBy(*order)
    crossing = strips.withColumns({"_hit": hit(along), "_other": F.lead("_bin", n).over(along)}).where("_hit").where((F.col("_to") <= n) & (F.col("_other") != F.col("_bin")))
    return whole.unionByName(crossing.drop("_hit", "_bin", "_from", "_to", "_other"))


def _earliest(i: int, j: int) -> str:
    return f"e{j}_{i}"


def sequence_within(df: DataFrame, by: str, order: list[str], kind: str, steps: list[str], seconds: int, bin_rows: int = BIN_ROWS) -> DataFrame:
    """(key, matched) for keys with any of the kinds: whether they occur in order, from first to last within ``seconds``.

    A bin's events, in order, are folded to a map of states: for each step j that a match may have reached before the bin,
    the earliest time in the bin at which it gets to each later step i; and for matches that begin in the bin, the latest
    beginning that has come to each step. Such maps compose, so a key's bins are applied one after another to the state
    of a match: the latest beginning that has come to each step.
    """
    m, limit = len(steps), seconds * 1_000_000
    rows = binned(df.where(F.col(kind).isin(steps)), [by], order[0], bin_rows, "_bin")
    long = lambda c: c.cast("long")
    none = long(F.lit(None))
    at = lambda x: x["t"]
    pairs = [(j, i) for j in range(m) for i in range(j + 1, m)]
    zero = F.struct(*(none.alias(_earliest(i, j)) for j, i in pairs), *(none.alias(f"b{i}") for i in range(m)), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        is_ = [x["k"] == s for s in steps]
        early = {(j, i): F.when(a[_earliest(i, j)].isNull() & is_[i] & (F.lit(True) if i == j + 1 else a[_earliest(i - 1, j)].isNotNull()), at(x)).otherwise(a[_earliest(i, j)]) for j, i in pairs}
        begun = [F.when(is_[0], at(x)).otherwise(a["b0"])] + [F.when(is_[i] & (at(x) - a[f"b{i - 1}"] <= limit), a[f"b{i - 1}"]).otherwise(a[f"b{i}"]) for i in range(1, m)]
        last = is_[0] if m == 1 else is_[m - 1] & F.coalesce(at(x) - a[f"b{m - 2}"] <= limit, F.lit(False))
        return F.struct(*(long(early[j, i]).alias(_earliest(i, j)) for j, i in pairs), *(long(b).alias(f"b{i}") for i, b in enumerate(begun)), (a["done"] | last).alias("done"))

    events = F.transform(F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.unix_micros(order[0]).alias("t"), F.col(kind).alias("k")))), lambda x: F.struct(x["t"].alias("t"), x["k"].alias("k")))
    maps = rows.groupBy(by, "_bin").agg(events.alias("_events")).select(by, "_bin", F.aggregate("_events", zero, step).alias("_map"))

    state = F.struct(*(none.alias(f"s{i}") for i in range(m)), F.lit(False).alias("done"))

    def compose(a: Column, x: Column) -> Column:
        f = x["_map"]
        inside = lambda j, i: F.coalesce(f[_earliest(i, j)] - a[f"s{j}"] <= limit, F.lit(False))
        reached = [F.greatest(f[f"b{i}"], a[f"s{i}"], *(F.when(inside(j, i), a[f"s{j}"]) for j in range(i))) for i in range(m)]
        done = reduce(lambda p, q: p | q, (inside(j, m - 1) for j in range(m - 1)), a["done"] | f["done"])
        return F.struct(*(long(r).alias(f"s{i}") for i, r in enumerate(reached)), done.alias("done"))

    in_order = F.array_sort(F.collect_list(F.struct("_bin", "_map")))
    return maps.groupBy(by).agg(in_order.alias("_maps")).select(by, F.aggregate("_maps", state, compose)["done"].alias("matched"))
