"""Semantic-layer queries: the sales cube by group, rollup, cube and pivot; parameterised and nested selects; joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import query, small
from ..operators.joins import as_of_join, interval_join
from ..operators.semantic import Cube, Measure, Relationship

SALES = Cube(
    "Sales", "lineitem",
    (
        Relationship("orders", "l_orderkey", "o_orderkey"), Relationship("customer", "o_custkey", "c_custkey"),
        Relationship("nation", "c_nationkey", "n_nationkey"), Relationship("region", "n_regionkey", "r_regionkey"),
    ),
    (
        Measure("revenue", "l_extendedprice * (1 - l_discount)"), Measure("n_lines", "1", "count"), Measure("avg_quantity", "l_quantity", "avg"),
        Measure("n_orders", "o_orderkey", "distinct-count"), Measure("least_price", "l_extendedprice", "min"), Measure("most_price", "l_extendedprice", "max"), Measure("median_quantity", "l_quantity", "median"),
    ),
    {"geography": ("r_name", "n_name")},
)

STAR = """lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
REVENUE = "round(sum(l_extendedprice * (1 - l_discount)), 2)"


def _rounded(df, *names, to=2):
    return df.withColumns({n: F.round(n, to) for n in names})


@query("cube_revenue_by_region", f"SELECT r_name, {REVENUE} AS revenue, count(*) AS n_lines FROM {STAR} WHERE l_returnflag = 'R' GROUP BY r_name")
def cube_revenue_by_region(t):
    return _rounded(SALES.aggregate(t, ["r_name"], ["revenue", "n_lines"], "l_returnflag = 'R'"), "revenue")


@query("cube_all_measures", f"SELECT r_name, o_orderpriority, {REVENUE} AS revenue, count(*) AS n_lines, round(avg(l_quantity), 6) AS avg_quantity, count(DISTINCT o_orderkey) AS n_orders, min(l_extendedprice) AS least_price, max(l_extendedprice) AS most_price, median(l_quantity) AS median_quantity FROM {STAR} GROUP BY 1, 2")
def cube_all_measures(t):
    names = ["revenue", "n_lines", "avg_quantity", "n_orders", "least_price", "most_price", "median_quantity"]
    return _rounded(_rounded(SALES.aggregate(t, ["r_name", "o_orderpriority"], names), "revenue"), "avg_quantity", to=6)


@query("hierarchy_rollup", f"SELECT r_name, n_name, {REVENUE} AS revenue, count(*) AS n_lines, grouping_id(r_name, n_name) AS grouping_id FROM {STAR} GROUP BY ROLLUP (r_name, n_name)")
def hierarchy_rollup(t):
    return _rounded(SALES.aggregate(t, list(SALES.hierarchies["geography"]), ["revenue", "n_lines"], mode="rollup"), "revenue")


@query("cube_grouping_sets", f"SELECT r_name, l_returnflag, {REVENUE} AS revenue, grouping_id(r_name, l_returnflag) AS grouping_id FROM {STAR} GROUP BY CUBE (r_name, l_returnflag)")
def cube_grouping_sets(t):
    return _rounded(SALES.aggregate(t, ["r_name", "l_returnflag"], ["revenue"], mode="cube"), "revenue")


@query("cellset_pivot", f"SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)) FILTER (l_linestatus = 'O'), 2) AS O, round(sum(l_extendedprice * (1 - l_discount)) FILTER (l_linestatus = 'F'), 2) AS F FROM {STAR} GROUP BY r_name")
def cellset_pivot(t):
    return _rounded(SALES.cellset(t, ["r_name"], "l_linestatus", ["O", "F"], "revenue"), "O", "F")


@query("flat_table_unpivot", "SELECT l_returnflag, 'quantity' AS measure, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'tax', round(sum(l_tax), 2) FROM lineitem GROUP BY 1")
def flat_table_unpivot(t):
    sums = t.lineitem.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.sum("l_tax").alias("tax"))
    return _rounded(sums.unpivot("l_returnflag", ["quantity", "tax"], "measure", "value"), "value")


@query("catalog_measures", "SELECT * FROM (VALUES ('measure','revenue','sum(l_extendedprice * (1 - l_discount))'),('measure','n_lines','count(1)'),('measure','avg_quantity','avg(l_quantity)'),('measure','n_orders','distinct-count(o_orderkey)'),('measure','least_price','min(l_extendedprice)'),('measure','most_price','max(l_extendedprice)'),('measure','median_quantity','median(l_quantity)'),('relationship','orders','l_orderkey=o_orderkey'),('relationship','customer','o_custkey=c_custkey'),('relationship','nation','c_nationkey=n_nationkey'),('relationship','region','n_regionkey=r_regionkey'),('hierarchy','geography','r_name>n_name')) v(kind, name, detail)")
def catalog_measures(t):
    return SALES.describe(t.spark)


@query("named_parameters", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def named_parameters(t):
    """A parameterised select; values are bound, not spliced in."""
    return t.spark.sql("SELECT c_custkey, c_name, c_acctbal FROM {customer} WHERE c_acctbal > :least AND c_mktsegment = :segment", args={"least": 5000, "segment": "BUILDING"}, customer=t.customer)


@query("nested_counts", "SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(round(sum(o_totalprice), 2), 0) AS total, max(o_orderpriority) AS last_priority FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def nested_counts(t):
    """Scalars of a nested selection's lists, by partial aggregates: no customer's orders are gathered into one row."""
    own = t.orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("sum"), F.max("o_orderpriority").alias("last_priority"))
    nested = t.customer.select("c_custkey").join(own, F.col("c_custkey") == F.col("o_custkey"), "left")
    return nested.select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"), F.coalesce(F.round("sum", 2), F.lit(0.0)).alias("total"), "last_priority")


@query("calculated_share", f"SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)) / sum(sum(l_extendedprice * (1 - l_discount))) OVER (), 8) AS share FROM {STAR} GROUP BY n_name")
def calculated_share(t):
    """A calculated member over all rows: the filter context dropped for the divisor."""
    by = SALES.aggregate(t, ["n_name"], ["revenue"])
    whole = by.agg(F.sum("revenue").alias("whole"))  # one row
    return by.crossJoin(F.broadcast(whole)).select("n_name", F.round(F.col("revenue") / F.col("whole"), 8).alias("share"))


@query("semi_join_active", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join_active(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("anti_join_idle", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')")
def anti_join_idle(t):
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("set_operations", "SELECT * FROM ((SELECT c_nationkey AS nation, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT c_nationkey, 'customers' FROM customer EXCEPT SELECT s_nationkey, 'customers' FROM supplier))")
def set_operations(t):
    c, s = t.customer.select(F.col("c_nationkey").alias("nation")), t.supplier.select(F.col("s_nationkey").alias("nation"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("customers")))


@query("as_of_last_purchase", "SELECT e.event_id, p.event_id AS purchase_id, p.value AS purchase_value FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def as_of_last_purchase(t):
    e = t.events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    p = t.events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value"))
    return as_of_join(e, p, ["user_id"], "ts", ["purchase_id", "purchase_value"]).select("event_id", "purchase_id", "purchase_value")


@query("interval_join_errors", "SELECT c.event_id AS click_id, e.event_id AS error_id FROM events c JOIN events e ON c.user_id = e.user_id AND e.ts > c.ts AND e.ts <= c.ts + INTERVAL 2 HOUR WHERE c.event_type = 'click' AND e.event_type = 'error'")
def interval_join_errors(t):
    c = t.events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    e = t.events.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"))
    return interval_join(c, e, ["user_id"], "ts", 7200).select("click_id", "error_id")


@query("top_customers_per_nation", "SELECT c_nationkey, c_custkey, rk FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rk FROM customer) WHERE rk <= 3")
def top_customers_per_nation(t):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t.customer.withColumn("rk", F.row_number().over(w)).where("rk <= 3").select("c_nationkey", "c_custkey", F.col("rk").cast("long").alias("rk"))


@query("part_supplier_theta", "SELECT p_partkey, count(*) AS n_cheaper FROM part p JOIN (SELECT n_nationkey, 900 + 40.0 * n_nationkey AS floor FROM nation) f ON p_retailprice > f.floor GROUP BY p_partkey")
def part_supplier_theta(t):
    """A comparison join against a table of 25 thresholds, which is broadcast behind a size check."""
    floor = t.nation.select("n_nationkey", (F.lit(900) + 40.0 * F.col("n_nationkey")).alias("floor"))
    return t.part.join(small(floor), F.col("p_retailprice") > F.col("floor")).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n_cheaper"))
