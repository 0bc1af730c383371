"""Queries over events, orders and line items: predicates, aggregates, indicators, service levels, spreadsheets' filters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import query, small
from ..functions.predicates import CELL_IS, DAYS, FORMATS, OPERATORS, PERIODS, cell_format, condition, constraint, dynamic_filter, icon, key_violations, rule, scaled
from ..operators import monitoring as M
from ..operators import patterns as P
from ..operators.quantiles import exact_quantiles
from ..operators.scans import carried

OPS = {
    "eq": ("event_type", "eq", "click"), "neq": ("event_type", "neq", "click"), "gt": ("value", "gt", 50), "gte": ("value", "gte", 50), "lt": ("value", "lt", 10), "lte": ("value", "lte", 10),
    "in_": ("event_type", "in", ["click", "view"]), "not_in": ("event_type", "not_in", ["click", "view"]), "exists_": ("value", "exists"), "not_exists": ("value", "not_exists"), "contains_": ("props", "contains", '"k": 8'),
}
SPAN = "timestamp '2024-01-31 00:00:00'"


@query("predicate_matrix", """SELECT event_id, event_type = 'click' AS eq, event_type <> 'click' AS neq, value > 50 AS gt, value >= 50 AS gte, value < 10 AS lt, value <= 10 AS lte,
event_type IN ('click','view') AS in_, event_type NOT IN ('click','view') AS not_in, value IS NOT NULL AS exists_, value IS NULL AS not_exists, contains(props, '"k": 8') AS contains_ FROM events""")
def predicate_matrix(t):
    assert {v[1] for v in OPS.values()} == set(OPERATORS)
    return t.events.select("event_id", *(condition(*v).alias(k) for k, v in OPS.items()))


@query("predicate_missing_values", "SELECT event_id, coalesce(try_cast(v AS DOUBLE), 0) > -1 AND v IS DISTINCT FROM 'x' AS gt, coalesce(try_cast(v AS DOUBLE), 0) < 5 AND v IS DISTINCT FROM 'x' AS lt, v IS NULL AS eq_null FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'x' ELSE cast(value AS VARCHAR) END AS v FROM events)")
def predicate_missing_values(t):
    m = F.col("event_id") % 4
    v = F.when(m == 0, None).when(m == 1, "").when(m == 2, "x").otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", v.alias("v")).select("event_id", condition("v", "gt", -1).alias("gt"), condition("v", "lt", 5).alias("lt"), condition("v", "eq", None).alias("eq_null"))


@query("rules_batch", "SELECT 'costly_purchase' AS rule, event_id FROM events WHERE event_type = 'purchase' AND value > 100 UNION ALL SELECT 'any_error', event_id FROM events WHERE event_type = 'error'")
def rules_batch(t):
    """Every enabled rule in one pass over the events."""
    rules = {"costly_purchase": rule([("event_type", "eq", "purchase"), ("value", "gt", 100)]), "any_error": rule([("event_type", "eq", "error")]), "off": rule([("value", "gt", 0)], enabled=False)}
    hits = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return t.events.select(F.explode(hits).alias("rule"), "event_id")


@query("metric_rules_first_match", "SELECT event_id, CASE WHEN event_type = 'error' AND value > 60 THEN 'error_high' WHEN event_type = 'error' AND value > 20 THEN 'error_mid' WHEN event_type = 'purchase' AND value < 1 THEN 'tiny_purchase' END AS rule FROM events WHERE (event_type = 'error' AND value > 20) OR (event_type = 'purchase' AND value < 1)")
def metric_rules_first_match(t):
    """Rules as a table joined on the metric; the first registered that holds wins."""
    rules = t.spark.createDataFrame([(0, "error", "gt", 60.0, "error_high"), (1, "error", "gt", 20.0, "error_mid"), (2, "purchase", "lt", 1.0, "tiny_purchase")], "no int, metric string, op string, limit double, rule string")
    v, x = F.col("value"), F.col("limit")
    holds = F.when(F.col("op") == "gt", v > x).when(F.col("op") == "gte", v >= x).when(F.col("op") == "lt", v < x).when(F.col("op") == "lte", v <= x).when(F.col("op") == "eq", v == x).when(F.col("op") == "neq", v != x).otherwise(False)
    met = t.events.join(small(rules), F.col("event_type") == F.col("metric")).where(holds)
    return met.groupBy("event_id").agg(F.min_by("rule", "no").alias("rule"))


@query("event_store_filter", "SELECT event_id, event_type, value FROM events WHERE user_id = 7 AND event_type = 'view' AND ts >= TIMESTAMP '2024-01-10 00:00:00'")
def event_store_filter(t):
    return t.events.where("user_id = 7 AND event_type = 'view' AND ts >= timestamp'2024-01-10 00:00:00'").select("event_id", "event_type", "value")


@query("audit_query_page", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20")
def audit_query_page(t):
    """One page, newest first: the page size is the feature."""
    return t.orders.where("o_orderstatus = 'F' AND o_orderdate >= timestamp'1995-01-01'").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(50).select("o_orderkey", "o_orderstatus")


@query("key_prefix_scan", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#0000001')")
def key_prefix_scan(t):
    return t.customer.where(F.col("c_name").startswith("Customer#0000001")).select("c_custkey", "c_name")


@query("operation_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def operation_counts(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("metric_stats", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def metric_stats(t):
    return M.metric_stats(t.events, ["event_type"], "value").withColumn("avg", F.round("avg", 6))


@query("metric_aggregations", """SELECT event_type, round(sum(value), 4) AS v_sum, round(avg(value), 6) AS v_avg, min(value) AS v_min, max(value) AS v_max, count(*) AS v_count, count(DISTINCT value) AS v_distinct,
round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS v_rate, round(quantile_cont(value, 0.95), 6) AS v_percentile, round(median(value), 6) AS v_median, round(stddev_samp(value), 6) AS v_stddev,
round(sum(value * user_id) / sum(user_id), 6) AS v_weighted, arg_min(value, (ts, event_id)) AS v_first, arg_max(value, (ts, event_id)) AS v_last FROM events GROUP BY 1""")
def metric_aggregations(t):
    """Percentile and median are exact and found by selection, so that no group's values are held together."""
    r = lambda kind, to=6, **k: F.round(M.metric_aggregation(kind, "value", **k), to)
    sums = t.events.groupBy("event_type").agg(
        r("sum", 4).alias("v_sum"), r("avg").alias("v_avg"), M.metric_aggregation("min", "value").alias("v_min"), M.metric_aggregation("max", "value").alias("v_max"), M.metric_aggregation("count", "value").alias("v_count"),
        M.metric_aggregation("distinct_count", "value").alias("v_distinct"), r("rate", 9).alias("v_rate"), r("stddev").alias("v_stddev"),
        r("weighted_avg", weight="user_id").alias("v_weighted"), M.metric_aggregation("first", "value").alias("v_first"), M.metric_aggregation("last", "value").alias("v_last"),
    )
    ranked = exact_quantiles(t.events, ["event_type"], "value", {"v_percentile": 0.95, "v_median": 0.5}).withColumnRenamed("event_type", "ranked_type")
    told = sums.join(small(ranked), F.col("event_type").eqNullSafe(F.col("ranked_type"))).drop("ranked_type")
    return told.withColumns({c: F.round(c, 6) for c in ("v_percentile", "v_median")})


@query("quantiles_of_customers", "SELECT o_custkey, round(quantile_cont(o_totalprice::DOUBLE, 0.25), 4) AS low, round(quantile_cont(o_totalprice::DOUBLE, 0.5), 4) AS mid, round(quantile_cont(o_totalprice::DOUBLE, 0.9), 4) AS high FROM orders GROUP BY 1")
def quantiles_of_customers(t):
    out = exact_quantiles(t.orders, ["o_custkey"], "o_totalprice", {"low": 0.25, "mid": 0.5, "high": 0.9})
    return out.select("o_custkey", *(F.round(c, 4).alias(c) for c in ("low", "mid", "high")))


@query("aggregate_with_filter", "SELECT user_id, round(sum(value), 4) AS total, count(*) AS n FROM events WHERE value > 5 AND event_type <> 'error' GROUP BY user_id")
def aggregate_with_filter(t):
    return t.events.where(rule([("value", "gt", 5), ("event_type", "neq", "error")])).groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


for _unit, _form in (("minute", "%Y-%m-%d %H:%M"), ("hour", "%Y-%m-%d %H:00"), ("day", "%Y-%m-%d")):
    for _agg in ("count", "sum", "avg", "min", "max"):
        _sql = "cast(count(*) AS DOUBLE)" if _agg == "count" else f"round({_agg}(value), 6)"

        @query(f"time_bucket_{_unit}_{_agg}", f"SELECT strftime(ts, '{_form}') AS bucket, event_type AS metric, '{_agg}' AS aggregation, {_sql} AS value, count(*) AS record_count FROM events GROUP BY 1, 2")
        def _bucket(t, unit=_unit, agg=_agg):
            return M.time_buckets(t.events.withColumnRenamed("event_type", "metric"), unit, agg, "value").withColumn("value", F.round("value", 6))


@query("moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), 6) AS moving_avg FROM events")
def moving_average(t):
    return M.moving_average(t.events, ["user_id"], ["ts", "event_id"], "value", 5).select("event_id", F.round("moving_avg", 6).alias("moving_avg"))


@query("kpi_status", "SELECT user_id, CASE WHEN avg(value) >= 22 THEN 'on_track' WHEN avg(value) >= 18 THEN 'warning' ELSE 'critical' END AS status FROM events GROUP BY 1")
def kpi_status(t):
    return t.events.groupBy("user_id").agg(M.kpi_status(F.avg("value"), 22, 18).alias("status"))


@query("sla_report", "SELECT event_type, count(value) AS n, count(*) FILTER (NOT value <= 60) AS breaches, round((count(value) - count(*) FILTER (NOT value <= 60)) / count(value), 8) AS compliance FROM events GROUP BY 1")
def sla_report(t):
    return M.sla_report(t.events, ["event_type"], "value", "<=", 60).withColumn("compliance", F.round("compliance", 8))


@query("alerts_latest_value", "SELECT event_type, arg_max(value, (ts, event_id)) AS latest FROM events GROUP BY 1 HAVING arg_max(value, (ts, event_id)) > 10")
def alerts_latest_value(t):
    return t.events.groupBy("event_type").agg(M.metric_aggregation("last", "value").alias("latest")).where("latest > 10")


@query("threshold_agent", "SELECT event_id, value FROM events WHERE value > 120")
def threshold_agent(t):
    return t.events.where("value > 120").select("event_id", "value")


@query("anomaly_two_sigma", "SELECT event_id FROM (SELECT event_id, value, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type)) WHERE n >= 3 AND abs(value - m) > 2 * s")
def anomaly_two_sigma(t):
    return M.anomalies(t.events, ["event_type"], "value").select("event_id")


@query("trend", "SELECT user_id, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) AS change, CASE WHEN arg_max(value, (ts, event_id)) > arg_min(value, (ts, event_id)) THEN 'warning' ELSE 'info' END AS severity FROM events GROUP BY 1 HAVING count(*) >= 2")
def trend(t):
    return M.trend(t.events, ["user_id"], "value", ["ts", "event_id"]).select("user_id", F.round("change", 6).alias("change"), "severity")


def _activities(t):
    return M.activity_metrics(t.events.select("event_type", "user_id", (F.col("value") * 100).alias("ms"), (F.col("value") > 55).alias("failed")), "event_type", "ms", "failed")


@query("activity_heat", "SELECT event_type, n, round(n / max(n) OVER (), 8) AS heat, round(avg_ms, 6) AS avg_ms, round(rate, 8) AS failure_rate FROM (SELECT event_type, count(*) AS n, avg(value * 100) AS avg_ms, avg(CASE WHEN value > 55 THEN 1 ELSE 0 END) AS rate FROM events GROUP BY 1)")
def activity_heat(t):
    return M.heat(_activities(t)).select("event_type", "n", F.round("heat", 8).alias("heat"), F.round("avg_ms", 6).alias("avg_ms"), F.round("failure_rate", 8).alias("failure_rate"))


@query("bottlenecks", "SELECT event_type, concat_ws(',', CASE WHEN rate >= 0.02 THEN 'high_failure_rate' END, CASE WHEN avg_ms >= 1900 THEN 'slow' END, CASE WHEN max_ms > 5 * avg_ms AND n > 5 THEN 'outliers' END) AS reasons FROM (SELECT event_type, count(*) AS n, avg(value * 100) AS avg_ms, max(value * 100) AS max_ms, avg(CASE WHEN value > 55 THEN 1 ELSE 0 END) AS rate FROM events GROUP BY 1) WHERE rate >= 0.02 OR avg_ms >= 1900 OR (max_ms > 5 * avg_ms AND n > 5)")
def bottlenecks(t):
    return M.bottlenecks(_activities(t), rate=0.02, slow_ms=1900).select("event_type", "reasons")


@query("process_kpis", "SELECT round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS completion_rate, round(100.0 * count(*) FILTER (o_orderstatus = 'O') / count(*), 6) AS failure_rate, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS avg_completed FROM orders")
def process_kpis(t):
    share = lambda s: F.round(100.0 * F.count_if(F.col("o_orderstatus") == s) / F.count(F.lit(1)), 6)
    return t.orders.agg(share("F").alias("completion_rate"), share("O").alias("failure_rate"), F.round(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 4).alias("avg_completed"))


@query("instance_counters", "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1")
def instance_counters(t):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("total"), n("O").alias("active"), n("F").alias("completed"), n("P").alias("pending"))


@query("plurality_vote", "SELECT user_id, event_type AS winner FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY user_id, event_type) WHERE rn = 1")
def plurality_vote(t):
    votes = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("user_id").agg(F.min_by("event_type", F.struct((-F.col("n")).alias("n"), "event_type")).alias("winner"))


@query("latest_per_metric", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS latest FROM events GROUP BY 1, 2")
def latest_per_metric(t):
    return t.events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("latest"))


@query("relative_window_history", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def relative_window_history(t):
    last = t.events.agg(F.max("ts").alias("last"))  # one row
    return t.events.crossJoin(F.broadcast(last)).where("ts >= last - interval 7 days").select("event_id")


@query("ring_buffer_last_n", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10")
def ring_buffer_last_n(t):
    return M.last_n(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("event_id")


@query("priority_dispatch", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS turn FROM orders")
def priority_dispatch(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.row_number().over(w).cast("long").alias("turn"))


@query("audit_transitions", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events QUALIFY from_state IS DISTINCT FROM event_type")
def audit_transitions(t):
    rows = carried(t.events.select("event_id", "ts", "user_id", "event_type"), ["user_id"], ["ts", "event_id"], F.struct("event_type"), "was", inclusive=False)
    return rows.select("event_id", F.col("was.event_type").alias("from_state"), F.col("event_type").alias("to_state")).where(~F.col("from_state").eqNullSafe(F.col("to_state")))


# --- filters of spreadsheets and constraints of schemas -------------------------------------------------------------


@query("sheet_value_and_custom_filters", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) OR (p_retailprice >= 950 AND p_retailprice < 960) OR p_name LIKE 'red%'")
def sheet_value_and_custom_filters(t):
    return t.part.where(F.col("p_size").isin(1, 5, 9) | ((F.col("p_retailprice") >= 950) & (F.col("p_retailprice") < 960)) | F.col("p_name").like("red%")).select("p_partkey")


_NOW = "TIMESTAMP '1998-05-17 12:00:00'"
_SHIFT = {"week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR"}
_DYNAMIC = {k: f"date_trunc('{u}', o_orderdate) = date_trunc('{u}', {_NOW}) + {n} * {_SHIFT[u]}" for k, (u, n) in PERIODS.items()}
_DYNAMIC |= {k: f"date_trunc('day', o_orderdate) = date_trunc('day', {_NOW}) + {n} * INTERVAL 1 DAY" for k, n in DAYS.items()}
_DYNAMIC |= {"yearToDate": f"date_trunc('year', o_orderdate) = date_trunc('year', {_NOW}) AND o_orderdate <= {_NOW}", "aboveAverage": "o_totalprice > (SELECT avg(o_totalprice) FROM orders)", "belowAverage": "o_totalprice < (SELECT avg(o_totalprice) FROM orders)"}


@query("sheet_dynamic_filters", "SELECT o_orderkey, " + ", ".join(f"{e} AS {k}" for k, e in _DYNAMIC.items()) + " FROM orders")
def sheet_dynamic_filters(t):
    """All filters relative to a clock or to the column's average."""
    known = t.orders.agg(F.avg("o_totalprice").alias("mean"))  # one row
    now = F.lit("1998-05-17 12:00:00").cast("timestamp")
    value = lambda k: F.col("o_totalprice" if k.endswith("Average") else "o_orderdate")
    return t.orders.crossJoin(F.broadcast(known)).select("o_orderkey", *(dynamic_filter(k, value(k), now, F.col("mean")).alias(k) for k in _DYNAMIC))


_CELL = {"lessThan": "v < 950", "lessThanOrEqual": "v <= 950", "greaterThan": "v > 950", "greaterThanOrEqual": "v >= 950", "equal": "v = 950", "notEqual": "v <> 950", "between": "v BETWEEN 900 AND 950", "notBetween": "v NOT BETWEEN 900 AND 950"}
_FORMAT = {
    "containsText": "contains(s, 'ring')", "notContainsText": "NOT contains(s, 'ring')", "beginsWith": "starts_with(s, 'small')", "endsWith": "ends_with(s, 'ring')", "containsBlanks": "s IS NULL OR trim(s) = ''", "notContainsBlanks": "NOT (s IS NULL OR trim(s) = '')",
    "containsErrors": "s IN ('#DIV/0!', '#N/A')", "notContainsErrors": "NOT coalesce(s IN ('#DIV/0!', '#N/A'), false)",
}
_CELLS = "SELECT p_partkey, CASE WHEN p_size % 9 <> 0 THEN p_retailprice END AS v, CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN '#DIV/0!' WHEN 3 THEN '#N/A' ELSE p_name END AS s FROM part"


@query("conditional_formats_of_cells", "SELECT p_partkey, " + ", ".join(f"coalesce({e}, false) AS {k}" for k, e in (_CELL | _FORMAT).items()) + f", coalesce(p_partkey % 2 = 0 AND v > 900, false) AS expression, coalesce(v > (SELECT avg(v) FROM c), false) AS above, count(*) OVER (PARTITION BY v) = 1 AS unique_, round(coalesce((v - (SELECT min(v) FROM c)) / (SELECT max(v) - min(v) FROM c), 0), 8) AS bar, cast(least(2, floor(coalesce((v - (SELECT min(v) FROM c)) / (SELECT max(v) - min(v) FROM c), 0) * 3)) AS INTEGER) AS icon FROM ({_CELLS}) c".replace("FROM c)", f"FROM ({_CELLS}))"))
def conditional_formats_of_cells(t):
    """Every format of a cell by itself, and those relative to the column: averages, unique values, bars and icons."""
    size = F.col("p_size") % 6
    c = t.part.select("p_partkey", F.when(F.col("p_size") % 9 != 0, F.col("p_retailprice")).alias("v"), F.when(size == 0, None).when(size == 1, "  ").when(size == 2, "#DIV/0!").when(size == 3, "#N/A").otherwise(F.col("p_name")).alias("s"))
    known = c.agg(F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))  # one row
    once = c.groupBy("v").agg((F.count(F.lit(1)) == 1).alias("unique_")).withColumnRenamed("v", "of")
    v, s, args = F.col("v"), F.col("s"), {"between": (900, 950), "notBetween": (900, 950)}
    words = {"containsText": "ring", "notContainsText": "ring", "beginsWith": "small", "endsWith": "ring"}
    return c.crossJoin(F.broadcast(known)).join(once, v.eqNullSafe(F.col("of"))).select(
        "p_partkey", *(cell_format("cellIs", v, k, *args.get(k, (950,))).alias(k) for k in CELL_IS), *(cell_format(k, s, *([words[k]] if k in words else [])).alias(k) for k in FORMATS),
        cell_format("expression", v, "p_partkey % 2 = 0 AND v > 900").alias("expression"), dynamic_filter("aboveAverage", v, mean=F.col("mean")).alias("above"), "unique_",
        F.round(scaled(v, F.col("low"), F.col("high")), 8).alias("bar"), icon(v, F.col("low"), F.col("high")).alias("icon"),
    )


@query("conditional_formats", "SELECT p_partkey, count(*) OVER (PARTITION BY p_name) > 1 AS duplicate, p_retailprice BETWEEN 900 AND 1000 AS between_, p_retailprice NOT BETWEEN 900 AND 1000 AS not_between, contains(p_name, 'ring') AS has_text, NOT contains(p_name, 'ring') AS lacks_text, starts_with(p_name, 'small') AS begins, ends_with(p_name, 'ring') AS ends_, p_name IS NULL OR trim(p_name) = '' AS blank FROM part")
def conditional_formats(t):
    twice = t.part.groupBy("p_name").agg((F.count(F.lit(1)) > 1).alias("duplicate"))
    name, price = F.col("p_name"), F.col("p_retailprice")
    return t.part.join(twice, "p_name").select(
        "p_partkey", "duplicate", price.between(900, 1000).alias("between_"), (~price.between(900, 1000)).alias("not_between"), F.contains(name, F.lit("ring")).alias("has_text"),
        (~F.contains(name, F.lit("ring"))).alias("lacks_text"), F.startswith(name, F.lit("small")).alias("begins"), F.endswith(name, F.lit("ring")).alias("ends_"), (name.isNull() | (F.trim(name) == "")).alias("blank"),
    )


@query("conditional_top_ten", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def conditional_top_ten(t):
    return t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "p_retailprice")


@query("conditional_top_percent", "WITH n AS (SELECT greatest(1, cast(floor(count(*) * 0.1) AS BIGINT)) AS n FROM part), b AS (SELECT min(p_retailprice) FILTER (hi <= n) AS top, max(p_retailprice) FILTER (lo <= n) AS bottom FROM (SELECT p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC) AS hi, row_number() OVER (ORDER BY p_retailprice) AS lo FROM part), n) SELECT p_partkey, p_retailprice >= top AS in_top, p_retailprice <= bottom AS in_bottom FROM part, b WHERE p_retailprice >= top OR p_retailprice <= bottom")
def conditional_top_percent(t):
    """Cells among the tenth with the largest and the tenth with the smallest values, ties at the border too; the borders are ranks found by selection."""
    part = t.part.select("p_partkey", "p_retailprice", F.lit(0).alias("sheet"))
    n = part.count()
    most = max(1, n // 10)
    borders = exact_quantiles(part, ["sheet"], "p_retailprice", {"bottom": (most - 1) / max(n - 1, 1), "top": (n - most) / max(n - 1, 1)})
    edge = 1e-9  # the two ranks are whole numbers but for the last digits of a double
    out = part.crossJoin(F.broadcast(borders.drop("sheet")))  # one row
    marked = out.select("p_partkey", (F.col("p_retailprice") >= F.col("top") - edge * F.abs("top")).alias("in_top"), (F.col("p_retailprice") <= F.col("bottom") + edge * F.abs("bottom")).alias("in_bottom"))
    return marked.where("in_top OR in_bottom")


@query("conditional_time_periods", "SELECT o_orderkey, coalesce(date_trunc('month', o_orderdate) = DATE '1996-05-01', false) AS last_month, coalesce(date_trunc('year', o_orderdate) = DATE '1996-01-01', false) AS this_year FROM orders")
def conditional_time_periods(t):
    """Time periods as formats of date cells, seen from a day of 1996."""
    now = F.lit("1996-06-15").cast("date")
    return t.orders.select("o_orderkey", cell_format("timePeriod", F.col("o_orderdate"), "lastMonth", now).alias("last_month"), cell_format("timePeriod", F.col("o_orderdate"), "thisYear", now).alias("this_year"))


@query("constraint_report", "SELECT 'name_pattern' AS rule, count(*) FILTER (NOT regexp_matches(c_name, '^Customer#[0-9]{9}')) AS failed FROM customer UNION ALL SELECT 'balance_range', count(*) FILTER (NOT c_acctbal BETWEEN 0 AND 9000) FROM customer UNION ALL SELECT 'segment_enum', count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')) FROM customer UNION ALL SELECT 'key_required', count(*) FILTER (c_custkey IS NULL) FROM customer UNION ALL SELECT 'name_length', count(*) FILTER (length(c_name) > 18) FROM customer")
def constraint_report(t):
    """Failures of each constraint in one pass."""
    rules = {
        "name_pattern": ("pattern", "c_name", "Customer#[0-9]{9}"), "balance_range": ("range", "c_acctbal", 0, 9000), "segment_enum": ("enum", "c_mktsegment", "BUILDING", "MACHINERY", "HOUSEHOLD"),
        "key_required": ("required", "c_custkey"), "name_length": ("max_length", "c_name", 18),
    }
    counted = t.customer.agg(*(F.count_if(~constraint(*v)).alias(k) for k, v in rules.items()))
    return counted.unpivot([], list(rules), "rule", "failed")


_ROWS = {
    "not_null": (("not_null", "p_odd"), "p_size % 8 = 0"), "length": (("length", "p_brand", 8), "length(p_brand) <> 8"), "min_inclusive": (("min_inclusive", "p_size", 3), "p_size < 3"), "max_inclusive": (("max_inclusive", "p_size", 40), "p_size > 40"),
    "min_exclusive": (("min_exclusive", "p_size", 3), "p_size <= 3"), "max_exclusive": (("max_exclusive", "p_size", 40), "p_size >= 40"), "total_digits": (("total_digits", "p_size", 1), "p_size > 9"),
    "fraction_digits": (("fraction_digits", "p_cents", 1), "p_partkey % 10 <> 0"), "white_space": (("white_space", "p_loose", "collapse"), "p_size % 4 = 0"), "must": (("must", "p_size", "p_size > 5"), "p_size <= 5"),
    "when": (("when", "p_size", "p_size > 30", "p_retailprice > 950"), "p_size > 30 AND p_retailprice <= 950"), "some_values_from": (("some_values_from", "p_words", "red", "ring"), "NOT list_has_any(string_split(p_name, ' '), ['red', 'ring'])"),
    "all_values_from": (("all_values_from", "p_words", "small", "ring"), "NOT list_has_all(['small', 'ring'], string_split(p_name, ' '))"), "min_cardinality": (("min_cardinality", "p_words", 2), "len(string_split(p_name, ' ')) < 2"), "positive": (("positive", "p_size"), "p_size <= 0"),
    "multiple_of": (("multiple_of", "p_size", 5), "p_size % 5 <> 0"), "enum": (("enum", "p_brand", "Brand#11", "Brand#12"), "p_brand NOT IN ('Brand#11', 'Brand#12')"),
}


@query("constraints_of_rows", " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER ({w}) AS failed FROM part" for n, (_, w) in _ROWS.items()))
def constraints_of_rows(t):
    """Failures of each constraint of a row, in one pass."""
    rows = t.part.withColumns({"p_cents": F.format_string("%d.%02d", F.col("p_size"), F.col("p_partkey") % 100), "p_odd": F.when(F.col("p_size") % 8 != 0, F.col("p_name")), "p_loose": F.when(F.col("p_size") % 4 == 0, F.concat(F.lit(" "), "p_name")).otherwise(F.col("p_name")), "p_words": F.split("p_name", " ")})
    counted = rows.agg(*(F.count_if(~constraint(*c)).alias(n) for n, (c, _) in _ROWS.items()))
    return counted.unpivot([], list(_ROWS), "rule", "failed")


@query("constraints_of_tables", "SELECT 'primary_key' AS rule, count(*) AS n FROM (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'unique', count(*) FROM (SELECT c_nationkey, c_mktsegment FROM customer GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'foreign_key', count(DISTINCT c_custkey) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def constraints_of_tables(t):
    counted = lambda name, df: df.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("n"))
    return (
        counted("primary_key", key_violations(t.lineitem, "primary_key", ["l_orderkey", "l_partkey"])).unionByName(counted("unique", key_violations(t.customer, "unique", ["c_nationkey", "c_mktsegment"])))
        .unionByName(counted("foreign_key", key_violations(t.customer, "foreign_key", ["c_custkey"], t.orders, ["o_custkey"])))
    )


@query("duplicate_and_dangling_keys", "SELECT 'duplicate' AS problem, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'dangling', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def duplicate_and_dangling_keys(t):
    twice = t.lineitem.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").agg(F.lit("duplicate").alias("problem"), F.count(F.lit(1)).alias("n"))
    lost = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.lit("dangling").alias("problem"), F.count(F.lit(1)).alias("n"))
    return twice.unionByName(lost)


# --- gateways: which branches a row takes --------------------------------------------------------------------------


@query("gateway_exclusive", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'review' WHEN o_orderstatus = 'F' THEN 'archive' ELSE 'default' END AS branch FROM orders")
def gateway_exclusive(t):
    """Conditional branches by priority; the first that holds, else the default."""
    return t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "review").when(F.col("o_orderstatus") == "F", "archive").otherwise("default").alias("branch"))


@query("gateway_inclusive", "SELECT o_orderkey, 'review' AS branch FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, 'archive' FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'default' FROM orders WHERE NOT (o_totalprice > 200000 OR o_orderstatus = 'F')")
def gateway_inclusive(t):
    """Every branch whose condition holds; none: the default."""
    taken = F.filter(F.array(F.when(F.col("o_totalprice") > 200000, F.lit("review")), F.when(F.col("o_orderstatus") == "F", F.lit("archive"))), lambda x: x.isNotNull())
    return t.orders.select("o_orderkey", F.explode(F.when(F.size(taken) > 0, taken).otherwise(F.array(F.lit("default")))).alias("branch"))


@query("gateway_parallel", "SELECT o_orderkey, b.branch, b.no, o_totalprice * b.part AS amount FROM orders, (VALUES ('ship', 0, 0.75), ('bill', 1, 0.25)) b(branch, no, part)")
def gateway_parallel(t):
    """All branches, each with its own mapping of the row."""
    p = F.col("o_totalprice")
    branches = F.array(F.struct(F.lit("ship").alias("branch"), (p * 0.75).alias("amount")), F.struct(F.lit("bill").alias("branch"), (p * 0.25).alias("amount")))
    return t.orders.select("o_orderkey", F.posexplode(branches).alias("no", "b")).select("o_orderkey", "b.branch", "no", "b.amount")


@query("gateway_event", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS branch FROM events WHERE event_type IN ('purchase', 'error') AND value > 30 GROUP BY 1")
def gateway_event(t):
    """The branch of the event that comes first of those that are waited for."""
    return t.events.where("event_type IN ('purchase', 'error') AND value > 30").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("branch"))


@query("gateway_complex", "SELECT user_id, (max(CASE WHEN event_type = 'purchase' AND value > 90 THEN 1 ELSE 0 END) + max(CASE WHEN event_type = 'signup' AND value > 50 THEN 1 ELSE 0 END) + max(CASE WHEN event_type = 'error' AND value > 70 THEN 1 ELSE 0 END)) >= 2 AS active FROM events GROUP BY 1")
def gateway_complex(t):
    """Active when two of three branches have arrived."""
    arrived = lambda kind, least: F.max(F.when((F.col("event_type") == kind) & (F.col("value") > least), 1).otherwise(0))
    return t.events.groupBy("user_id").agg(((arrived("purchase", 90) + arrived("signup", 50) + arrived("error", 70)) >= 2).alias("active"))


@query("loop_stop_on_failure", "SELECT o_custkey, count(*) AS total, count(*) FILTER (first IS NULL OR (o_orderdate, o_orderkey) < first) AS completed, max(CASE WHEN first IS NULL THEN 0 ELSE 1 END)::BIGINT AS failed FROM orders LEFT JOIN (SELECT o_custkey, min((o_orderdate, o_orderkey)) AS first FROM orders WHERE o_totalprice > 300000 GROUP BY 1) USING (o_custkey) GROUP BY 1")
def loop_stop_on_failure(t):
    """Items one by one until one fails."""
    return P.one_by_one(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_totalprice") > 300000)


_LEAF = "(SELECT user_id FROM events WHERE {} GROUP BY 1 HAVING count(*) >= {})"


@query("rule_trees", f"SELECT DISTINCT user_id FROM events WHERE user_id IN {_LEAF.format(chr(39).join(['event_type = ', 'purchase', ' AND value > 60']), 1)} AND (user_id IN {_LEAF.format(chr(39).join(['event_type = ', 'error', '']), 12)} OR user_id NOT IN {_LEAF.format('value > 130', 1)}) AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' GROUP BY user_id, epoch_us(ts) // 86400000000 HAVING count(*) >= 3)")
def rule_trees(t):
    """And, or, not, thresholds, absence and windows of a rule document."""
    tree = ("and", ("event", "event_type = 'purchase' AND value > 60"), ("or", ("threshold", "event_type = 'error'", 12), ("absence", "value > 130")), ("not", ("window", "event_type = 'signup'", 3, 86400)))
    return P.matches(t.events, "user_id", "event_type", ["ts", "event_id"], tree)


@query("sentry_ready_cases", "SELECT user_id, count(DISTINCT event_type) FILTER (event_type IN ('signup', 'purchase')) = 2 AND max(value) > 100 AS ready FROM events GROUP BY 1")
def sentry_ready_cases(t):
    """On-parts: both events seen; if-part: a condition on the case."""
    seen = lambda kind: F.bool_or(F.col("event_type") == kind)
    return t.events.groupBy("user_id").agg((seen("signup") & seen("purchase") & (F.max("value") > 100)).alias("ready"))


@query("multi_instance_loop", "SELECT o_custkey, count(*) AS total, count(*) FILTER (o_totalprice > 0 AND o_orderstatus <> 'P') AS completed, count(*) FILTER (NOT (o_totalprice > 0 AND o_orderstatus <> 'P')) AS failed FROM orders GROUP BY 1")
def multi_instance_loop(t):
    good = (F.col("o_totalprice") > 0) & (F.col("o_orderstatus") != "P")
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("completed"), F.count_if(~good).alias("failed"))


@query("data_mapping", "SELECT o_orderkey AS key, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS state, o_totalprice * 1.19 AS gross, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END AS size, coalesce(NULL, 'n/a') AS note FROM orders")
def data_mapping(t):
    """Direct, value-mapped, computed, conditional and defaulted fields."""
    names = F.create_map(F.lit("O"), F.lit("open"), F.lit("F"), F.lit("done"))
    return t.orders.select(
        F.col("o_orderkey").alias("key"), F.coalesce(F.try_element_at(names, "o_orderstatus"), F.lit("other")).alias("state"), (F.col("o_totalprice") * 1.19).alias("gross"),
        F.when(F.col("o_totalprice") > 100000, "large").otherwise("small").alias("size"), F.coalesce(F.lit(None).cast("string"), F.lit("n/a")).alias("note"),
    )
