"""Activity monitoring: metric statistics, time buckets, indicators, service levels, anomalies, heat and bottlenecks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COMPARISONS = {
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}


def metric_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, avg, min, max of each metric; a metric without values has zeros."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*by).agg(F.count(value).alias("n"), zero(F.avg(value)).alias("avg"), zero(F.min(value)).alias("min"), zero(F.max(value)).alias("max"))


def metric_aggregation(kind: str, value: str, ts: str = "ts", weight: str | None = None, percent: float = 0.95) -> Column:
    """The aggregations a metric may declare. rate: events per second between the first and the last."""
    v = F.col(value).cast("double")
    span = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6
    return {
        "sum": lambda: F.coalesce(F.sum(v), F.lit(0.0)), "avg": lambda: F.avg(v), "min": lambda: F.min(v), "max": lambda: F.max(v), "count": lambda: F.count(F.lit(1)),
        "distinct_count": lambda: F.count_distinct(value), "rate": lambda: F.try_divide(F.count(F.lit(1)), span), "percentile": lambda: F.percentile(v, F.lit(percent)),
        "median": lambda: F.median(v), "stddev": lambda: F.stddev_samp(v), "weighted_avg": lambda: F.try_divide(F.sum(v * F.col(weight)), F.sum(weight)),
        "first": lambda: F.min_by(v, F.struct(ts, "event_id")), "last": lambda: F.max_by(v, F.struct(ts, "event_id")),
    }[kind]()


def time_buckets(df: DataFrame, unit: str, aggregation: str, value: str, ts: str = "ts", metric: str = "metric") -> DataFrame:
    """bucket, metric, aggregation, value, record_count; rows without a time are dropped, no numbers give 0."""
    form = {"minute": "yyyy-MM-dd HH:mm", "hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd"}[unit]
    how = {"count": F.count(F.lit(1)).cast("double"), "sum": F.sum(value), "avg": F.avg(value), "min": F.min(value), "max": F.max(value)}[aggregation]
    return (
        df.where(F.col(ts).isNotNull()).groupBy(F.date_format(F.date_trunc(unit, ts), form).alias("bucket"), metric)
        .agg(F.coalesce(how, F.lit(0.0)).alias("value"), F.count(F.lit(1)).alias("record_count"))
        .withColumn("aggregation", F.lit(aggregation))
    )


def kpi_status(value: Column, target: float, warning: float, higher_is_better: bool = True) -> Column:
    """on_track, warning or critical; a missing value counts as 0."""
    v, sign = F.coalesce(value, F.lit(0.0)), 1 if higher_is_better else -1
    return F.when(sign * v >= sign * target, "on_track").when(sign * v >= sign * warning, "warning").otherwise("critical")


def sla_report(df: DataFrame, by: list[str], value: str, op: str, threshold: float) -> DataFrame:
    """Values that meet ``value op threshold`` and the rate of these; without values the rate is 1."""
    breach = ~COMPARISONS[op](F.col(value), F.lit(threshold))
    n, b = F.count(value), F.count_if(breach)
    return df.groupBy(*by).agg(n.alias("n"), b.alias("breaches"), F.coalesce(F.try_divide(n - b, n), F.lit(1.0)).alias("compliance"))


def anomalies(df: DataFrame, by: list[str], value: str, k: float = 2.0) -> DataFrame:
    """Rows further than k sample deviations from their group's mean, in groups of three or more values.

    Group statistics come from a pre-aggregated table and are joined back, so a large group is never in one task.
    """
    stats = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("dev"), F.count(value).alias("n")).where("n >= 3")
    return df.join(stats, by).where(F.abs(F.col(value) - F.col("mean")) > k * F.col("dev"))


def trend(df: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """Last minus first value; up is a warning. Groups of one row have no trend."""
    at = F.struct(*order)
    out = df.groupBy(*by).agg((F.max_by(value, at) - F.min_by(value, at)).alias("change"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return out.withColumn("severity", F.when(F.col("change") > 0, "warning").otherwise("info"))


def activity_metrics(df: DataFrame, by: str, ms: str, failed: str) -> DataFrame:
    """Executions, average, least and most duration, failures and their rate."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(ms).alias("avg_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"),
        F.count_if(F.col(failed)).alias("failures"), F.avg(F.col(failed).cast("int")).alias("failure_rate"),
    )


def heat(metrics: DataFrame) -> DataFrame:
    """Each activity's count over the largest count."""
    most = metrics.agg(F.max("n").alias("most"))  # one row
    return metrics.crossJoin(F.broadcast(most)).withColumn("heat", F.try_divide("n", "most")).drop("most")


def bottlenecks(metrics: DataFrame, rate: float = 0.1, slow_ms: float = 5000.0, spread: float = 5.0, least: int = 5) -> DataFrame:
    """Activities with reasons: failing often, slow, or with a worst case far above the average."""
    reasons = F.filter(
        F.array(
            F.when(F.col("failure_rate") >= rate, "high_failure_rate"), F.when(F.col("avg_ms") >= slow_ms, "slow"),
            F.when((F.col("max_ms") > spread * F.col("avg_ms")) & (F.col("n") > least), "outliers"),
        ), lambda x: x.isNotNull(),
    )
    return metrics.withColumn("reasons", F.array_join(reasons, ",")).where(F.col("reasons") != "")


def moving_average(df: DataFrame, by: list[str], order: list[str], value: str, rows: int) -> DataFrame:
    return df.withColumn("moving_avg", F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(rows - 1), 0)))


def last_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The last n rows of each key, as a ring buffer or a replay keeps them."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= n)
