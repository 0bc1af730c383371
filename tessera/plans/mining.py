"""Process mining on events, model scoring on line items and embeddings, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import query, small
from ..operators import mining as M

ORDER = ["ts", "event_id"]


@query("process_discovery", "WITH s AS (SELECT lag(event_type) OVER w AS source, event_type AS target, lead(event_type) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT source, target, count(*) AS n FROM (SELECT source, target FROM s UNION ALL SELECT target, NULL FROM s WHERE nxt IS NULL) GROUP BY 1, 2")
def process_discovery(t):
    return M.directly_follows(t.events, "user_id", "event_type", ORDER)


@query("process_variants", "SELECT len(v) AS n_events, v[1] AS first, v[-1] AS last, count(*) AS n FROM (SELECT user_id, list(event_type ORDER BY ts, event_id) AS v FROM events GROUP BY 1) GROUP BY v")
def process_variants(t):
    return M.variants(t.events, "user_id", "event_type", ORDER)


@query("decision_mining", "SELECT o_orderpriority, big, o_orderstatus, support FROM (SELECT o_orderpriority, o_totalprice > 100000 AS big, o_orderstatus, count(*) AS support, row_number() OVER (PARTITION BY o_orderpriority, o_totalprice > 100000 ORDER BY count(*) DESC, o_orderstatus) AS rn FROM orders GROUP BY 1, 2, 3) WHERE rn = 1")
def decision_mining(t):
    cases = t.orders.select("o_orderpriority", (F.col("o_totalprice") > 100000).alias("big"), "o_orderstatus")
    return M.decision_rules(cases, ["o_orderpriority", "big"], "o_orderstatus")


@query("catch_event_clusters")
def catch_event_clusters(t):
    """Three first events of each of five stable clusters. The hash is not one that the oracle has; tested by brute force."""
    w = Window.partitionBy("cluster").orderBy(*ORDER)
    out = M.event_clusters(t.events, ["event_type", "props"], 5).withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    return out.select("cluster", "event_id")


@query("process_statistics", "SELECT count(DISTINCT user_id) AS n_cases, count(*) AS n_events, count(DISTINCT event_type) AS n_activities, count(*) FILTER (event_type = 'error') AS n_catch FROM events")
def process_statistics(t):
    return t.events.agg(F.count_distinct("user_id").alias("n_cases"), F.count(F.lit(1)).alias("n_events"), F.count_distinct("event_type").alias("n_activities"), F.count_if(F.col("event_type") == "error").alias("n_catch"))


TREES = [
    M.Split("l_quantity", 25.0, M.Leaf({"low": 0.7, "high": 0.3}), M.Split("l_discount", 0.05, M.Leaf({"low": 0.4, "high": 0.6}), M.Leaf({"low": 0.1, "high": 0.9}))),
    M.Split("l_tax", 0.04, M.Leaf({"low": 0.6, "high": 0.4}), M.Leaf({"low": 0.3, "high": 0.7})),
]
_T1 = "CASE WHEN l_quantity <= 25 THEN {0} WHEN l_discount <= 0.05 THEN {1} ELSE {2} END"
_T2 = "CASE WHEN l_tax <= 0.04 THEN {0} ELSE {1} END"
_LOW = f"(0.0::DOUBLE + {_T1.format('0.7::DOUBLE', '0.4::DOUBLE', '0.1::DOUBLE')} + {_T2.format('0.6::DOUBLE', '0.3::DOUBLE')})"
_HIGH = f"(0.0::DOUBLE + {_T1.format('0.3::DOUBLE', '0.6::DOUBLE', '0.9::DOUBLE')} + {_T2.format('0.4::DOUBLE', '0.7::DOUBLE')})"


@query("tree_ensemble_class", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN {_LOW} >= {_HIGH} THEN 'low' ELSE 'high' END AS class FROM lineitem")
def tree_ensemble_class(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", M.ensemble_class(TREES, ["low", "high"]).alias("class"))


@query("boosted_trees_value", "SELECT l_orderkey, l_linenumber, l_partkey, 10.0::DOUBLE + 0.5::DOUBLE * (0.0::DOUBLE + CASE WHEN l_quantity <= 25 THEN 1.5::DOUBLE ELSE 4.0::DOUBLE END + CASE WHEN l_tax <= 0.04 THEN -1.0::DOUBLE ELSE 2.25::DOUBLE END) AS value FROM lineitem")
def boosted_trees_value(t):
    trees = [M.Split("l_quantity", 25.0, M.Leaf(1.5), M.Leaf(4.0)), M.Split("l_tax", 0.04, M.Leaf(-1.0), M.Leaf(2.25))]
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", M.boosted_value(trees, 10.0, 0.5).alias("value"))


_F = ["l_quantity", "l_discount", "l_tax"]
_LIN = "(0.25::DOUBLE + l_quantity * 0.01::DOUBLE + l_discount * -2.0::DOUBLE + l_tax * 3.0::DOUBLE)"


@query("linear_and_logistic", f"SELECT l_orderkey, l_linenumber, l_partkey, round({_LIN}, 8) AS linear, round(1 / (1 + exp(-{_LIN})), 8) AS logistic, {_LIN} > 0.5 AS positive FROM lineitem")
def linear_and_logistic(t):
    x = M.linear([F.col(c) for c in _F], [0.01, -2.0, 3.0], 0.25)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(x, 8).alias("linear"), F.round(M.sigmoid(x), 8).alias("logistic"), (x > 0.5).alias("positive"))


@query("support_vector_kernels", "SELECT l_orderkey, l_linenumber, l_partkey, round(0.1 + 0.5 * exp(-(power(l_discount - 0.02, 2) + power(l_tax - 0.03, 2))) - 0.4 * exp(-(power(l_discount - 0.08, 2) + power(l_tax - 0.01, 2))), 8) AS rbf, round(0.1 + 0.5 * power(l_discount * 0.02 + l_tax * 0.03 + 1, 3) - 0.4 * power(l_discount * 0.08 + l_tax * 0.01 + 1, 3), 8) AS poly, round(0.1 + 0.5 * tanh(l_discount * 0.02 + l_tax * 0.03) - 0.4 * tanh(l_discount * 0.08 + l_tax * 0.01), 8) AS sig, round(0.1 + 0.5 * (l_discount * 0.02 + l_tax * 0.03) - 0.4 * (l_discount * 0.08 + l_tax * 0.01), 8) AS lin FROM lineitem")
def support_vector_kernels(t):
    x, pts, al = [F.col("l_discount"), F.col("l_tax")], [[0.02, 0.03], [0.08, 0.01]], [0.5, -0.4]
    v = lambda kind, **k: F.round(M.support_vectors(kind, x, pts, al, 0.1, **k), 8)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", v("rbf").alias("rbf"), v("poly", coef=1.0).alias("poly"), v("sigmoid").alias("sig"), v("linear").alias("lin"))


@query("dense_layers", "SELECT p_partkey, round(1 / (1 + exp(-(0.1 + h1 * 0.7 + h2 * -0.3))), 8) AS out FROM (SELECT p_partkey, greatest(0.5 + p_size * 0.02 + p_retailprice * -0.0001, 0) AS h1, greatest(-0.2 + p_size * 0.01 + p_retailprice * 0.0002, 0) AS h2 FROM part)")
def dense_layers(t):
    net = [([[0.02, -0.0001], [0.01, 0.0002]], [0.5, -0.2], "relu"), ([[0.7, -0.3]], [0.1], "sigmoid")]
    return t.part.select("p_partkey", F.round(M.layers([F.col("p_size"), F.col("p_retailprice")], net)[0], 8).alias("out"))


_ACT = {
    "relu": "greatest(x, 0)", "sigmoid": "1 / (1 + exp(-x))", "tanh": "tanh(x)", "exp": "exp(x)", "abs": "abs(x)", "softplus": "ln(1 + exp(x))", "softsign": "x / (1 + abs(x))", "leaky_relu": "CASE WHEN x >= 0 THEN x ELSE 0.01 * x END", "elu": "CASE WHEN x >= 0 THEN x ELSE exp(x) - 1 END",
    "selu": "1.0507009873554805 * CASE WHEN x >= 0 THEN x ELSE 1.6732632423543772 * (exp(x) - 1) END", "hard_sigmoid": "greatest(0, least(1, 0.2 * x + 0.5))", "hard_swish": "x * greatest(0, least(1, x / 6 + 0.5))", "swish": "x / (1 + exp(-x))", "mish": "x * tanh(ln(1 + exp(x)))",
    "thresholded_relu": "CASE WHEN x > 1 THEN x ELSE 0 END", "reciprocal": "1 / nullif(x, 0)", "sign": "sign(x)::DOUBLE", "clip": "greatest(-1, least(1, x))",
}


@query("activations", "SELECT n_nationkey, " + ", ".join(f"round(({e})::DOUBLE, 8) AS {n}" for n, e in _ACT.items()) + " FROM (SELECT n_nationkey, (n_nationkey - 12) / 4.0::DOUBLE AS x FROM nation)")
def activations(t):
    x = (F.col("n_nationkey") - 12) / F.lit(4.0)
    return t.nation.select("n_nationkey", *(F.round(M.ACTIVATIONS[n](x).cast("double"), 8).alias(n) for n in _ACT))


@query("tensor_reductions", "SELECT vec_id, round(list_sum(list_transform(e, lambda x: abs(x))), 6) AS l1, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS l2, round(list_sum(e), 6) AS sum, round(list_avg(e), 6) AS mean, round(list_max(e), 6) AS max, round(list_min(e), 6) AS min, list_position(e, list_max(e)) - 1 AS arg_max, list_position(e, list_min(e)) - 1 AS arg_min, len(e) AS size FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def tensor_reductions(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    fold = lambda f: F.aggregate("e", F.lit(0.0), f)
    r = lambda c: F.round(c, 6)
    return e.select(
        "vec_id", r(fold(lambda a, x: a + F.abs(x))).alias("l1"), r(F.sqrt(fold(lambda a, x: a + x * x))).alias("l2"), r(fold(lambda a, x: a + x)).alias("sum"), r(fold(lambda a, x: a + x) / F.size("e")).alias("mean"), r(F.array_max("e")).alias("max"), r(F.array_min("e")).alias("min"),
        (F.array_position("e", F.array_max("e")) - 1).alias("arg_max"), (F.array_position("e", F.array_min("e")) - 1).alias("arg_min"), F.size("e").cast("long").alias("size"),
    )


@query("nearest_centroid", "SELECT c_custkey, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM (SELECT c_custkey, power(c_acctbal / 1000 - 1, 2) + power(c_nationkey - 5, 2) AS d0, power(c_acctbal / 1000 - 5, 2) + power(c_nationkey - 12, 2) AS d1, power(c_acctbal / 1000 - 9, 2) + power(c_nationkey - 20, 2) AS d2 FROM customer)")
def nearest_centroid(t):
    return t.customer.select("c_custkey", M.nearest_centroid([F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")], [[1, 5], [5, 12], [9, 20]]).alias("cluster"))


@query("preprocessing", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS scaled, round(c_acctbal / max(abs(c_acctbal)) OVER (), 8) AS normal, CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS binary_, coalesce(CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END, 0) AS imputed, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS is_building, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS label FROM customer")
def preprocessing(t):
    b = F.col("c_acctbal")
    stats = t.customer.agg(F.avg(b).alias("mean"), F.stddev_pop(b).alias("dev"), F.max(F.abs(b)).alias("most"))  # one row
    labels = t.customer.select("c_mktsegment").distinct().select("c_mktsegment", (F.dense_rank().over(Window.orderBy("c_mktsegment")) - 1).cast("long").alias("label"))
    return t.customer.join(small(labels), "c_mktsegment").crossJoin(F.broadcast(stats)).select(
        "c_custkey", F.round((b - F.col("mean")) / F.col("dev"), 6).alias("scaled"), F.round(b / F.col("most"), 8).alias("normal"), (b > 5000).cast("int").alias("binary_"),
        F.coalesce(F.when(F.col("c_custkey") % 10 != 0, b), F.lit(0.0)).alias("imputed"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("is_building"), "label",
    )


@query("classification_metrics", "WITH c AS (SELECT count(*) FILTER (t = 1 AND g = 1) AS tp, count(*) FILTER (t <> 1 AND g = 1) AS fp, count(*) FILTER (t = 1 AND g <> 1) AS fn, count(*) FILTER (t = g) AS hit, count(*) AS n FROM (SELECT quality AS t, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS g FROM labels JOIN documents USING (doc_id))) SELECT round(hit / n, 8) AS accuracy, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 8) AS f1 FROM c")
def classification_metrics(t):
    pairs = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("t"), F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("g"))
    out = M.classification_metrics(pairs, "t", "g")
    return out.select(*(F.round(c, 8).alias(c) for c in out.columns))


@query("regression_metrics", "SELECT l_returnflag, round(avg(power(y - p, 2)), 2) AS mse, round(sqrt(avg(power(y - p, 2))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(1 - sum(power(y - p, 2)) / (var_pop(y) * count(y)), 8) AS r2, round(100 * avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END), 4) AS mape FROM (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem) GROUP BY 1")
def regression_metrics(t):
    out = M.regression_metrics(t.lineitem.select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p")), "y", "p", ["l_returnflag"])
    return out.select("l_returnflag", *(F.round(c, n).alias(c) for c, n in (("mse", 2), ("rmse", 4), ("mae", 4), ("r2", 8), ("mape", 4))))
