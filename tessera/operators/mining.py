"""Process mining on event logs and scoring of given models, both as DataFrame expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scans import carried


def directly_follows(log: DataFrame, case: str, activity: str, order: list[str]) -> DataFrame:
    """(source, target, n): how often an activity directly follows another in a case; null source: begins, null target: ends."""
    nxt = carried(log.select(case, activity, *(c for c in order if c not in (case, activity))), [case], order, F.struct(F.col(activity).alias("a")), "_next", backwards=True, inclusive=False)
    steps = nxt.select(F.col(activity).alias("source"), F.col("_next.a").alias("target"))
    begins = log.groupBy(case).agg(F.min_by(activity, F.struct(*order)).alias("target")).select(F.lit(None).cast("string").alias("source"), "target")
    return steps.unionByName(begins).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def decision_rules(cases: DataFrame, inputs: list[str], output: str) -> DataFrame:
    """Rules (inputs, output, support): for each combination of inputs its most frequent output, of equals the smallest."""
    counted = cases.groupBy(*inputs, output).agg(F.count(F.lit(1)).alias("support"))
    least = F.min_by(F.struct(output, "support"), F.struct((-F.col("support")).alias("s"), output))
    return counted.groupBy(*inputs).agg(least.alias("b")).select(*inputs, F.col("b")[output].alias(output), F.col("b.support").alias("support"))


def event_clusters(log: DataFrame, attributes: list[str], n: int) -> DataFrame:
    """The row with ``cluster``: a stable hash of the attributes, modulo n."""
    return log.withColumn("cluster", F.pmod(F.crc32(F.concat_ws("|", *attributes).cast("binary")), F.lit(n)).cast("long"))


def variants(log: DataFrame, case: str, activity: str, order: list[str]) -> DataFrame:
    """(n_events, first, last, n): the whole sequences of activities that cases have, with how many cases have each.

    Sequences are told apart by length, ends and two 64-bit hashes of all (place, activity), which are folded by exclusive
    or, so that no case is ever gathered.
    """
    placed = log.withColumn("at", F.row_number().over(Window.partitionBy(case).orderBy(*order)))
    h = lambda seed: F.bit_xor(F.xxhash64("at", F.coalesce(F.concat(F.lit("s"), activity), F.lit("n")), F.lit(seed)))
    cases = placed.groupBy(case).agg(F.count(F.lit(1)).alias("n_events"), F.min_by(activity, "at").alias("first"), F.max_by(activity, "at").alias("last"), h(1).alias("h1"), h(2).alias("h2"))
    return cases.groupBy("n_events", "first", "last", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).drop("h1", "h2")


# --- models ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Leaf:
    """A number, or weights by class."""

    value: float | dict[str, float]


@dataclass(frozen=True)
class Split:
    """Rows with feature <= threshold, or without the feature, go to ``yes``."""

    feature: str
    threshold: float
    yes: object
    no: object


def tree_value(node, label: str | None = None) -> Column:
    """The leaf's number, or its weight of a class, as nested conditions."""
    if isinstance(node, Leaf):
        return F.lit(float(node.value.get(label, 0.0) if isinstance(node.value, dict) else node.value))
    c = F.col(node.feature)
    return F.when(c.isNull() | (c <= node.threshold), tree_value(node.yes, label)).otherwise(tree_value(node.no, label))


def ensemble_class(trees: list, labels: list[str]) -> Column:
    """The class with the largest sum of weights over the trees; of equals the first label."""
    scores = [sum((tree_value(t, x) for t in trees), F.lit(0.0)) for x in labels]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F
    for x, s in zip(labels, scores, strict=True):
        out = out.when(s == best, F.lit(x))
    return out


def boosted_value(trees: list, base: float = 0.0, rate: float = 1.0) -> Column:
    return base + rate * sum((tree_value(t) for t in trees), F.lit(0.0))


def linear(features: list[Column], weights: list[float], intercept: float) -> Column:
    out = F.lit(float(intercept))
    for c, w in zip(features, weights, strict=True):
        out = out + c * float(w)
    return out


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def kernel(kind: str, features: list[Column], point: list[float], gamma: float = 1.0, coef: float = 0.0, degree: int = 3) -> Column:
    dot = sum((c * float(p) for c, p in zip(features, point, strict=True)), F.lit(0.0))
    if kind == "linear":
        return dot
    if kind == "poly":
        return F.pow(gamma * dot + coef, F.lit(float(degree)))
    if kind == "rbf":
        return F.exp(-gamma * sum(((c - float(p)) * (c - float(p)) for c, p in zip(features, point, strict=True)), F.lit(0.0)))
    if kind == "sigmoid":
        return F.tanh(gamma * dot + coef)
    raise ValueError(f"no kernel {kind!r}")


def support_vectors(kind: str, features: list[Column], points: list[list[float]], alphas: list[float], bias: float, **k) -> Column:
    """The decision value of a two-class machine."""
    return sum((a * kernel(kind, features, p, **k) for a, p in zip(alphas, points, strict=True)), F.lit(float(bias)))


ACTIVATIONS = {
    "identity": lambda x: x, "relu": lambda x: F.greatest(x, F.lit(0.0)), "sigmoid": sigmoid, "tanh": F.tanh, "exp": F.exp, "abs": F.abs, "softplus": lambda x: F.log1p(F.exp(x)), "softsign": lambda x: x / (1 + F.abs(x)),
    "leaky_relu": lambda x: F.when(x >= 0, x).otherwise(0.01 * x), "elu": lambda x: F.when(x >= 0, x).otherwise(F.exp(x) - 1), "celu": lambda x: F.when(x >= 0, x).otherwise(F.exp(x) - 1),
    "selu": lambda x: 1.0507009873554805 * F.when(x >= 0, x).otherwise(1.6732632423543772 * (F.exp(x) - 1)), "hard_sigmoid": lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.2 * x + 0.5)),
    "hard_swish": lambda x: x * F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / 6 + 0.5)), "swish": lambda x: x * sigmoid(x), "mish": lambda x: x * F.tanh(F.log1p(F.exp(x))), "thresholded_relu": lambda x: F.when(x > 1, x).otherwise(0.0),
    "reciprocal": lambda x: F.try_divide(F.lit(1.0), x), "sign": F.signum, "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "clip": lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)),
}


def layers(features: list[Column], network: list[tuple[list[list[float]], list[float], str]]) -> list[Column]:
    """Outputs of dense layers (weights by output, biases, activation)."""
    for weights, biases, activation in network:
        features = [ACTIVATIONS[activation](linear(features, w, b)) for w, b in zip(weights, biases, strict=True)]
    return features


def nearest_centroid(features: list[Column], centroids: list[list[float]]) -> Column:
    """The number of the nearest centroid; of equals the first."""
    d = [sum(((c - float(p)) * (c - float(p)) for c, p in zip(features, point, strict=True)), F.lit(0.0)) for point in centroids]
    best, out = F.least(*d) if len(d) > 1 else d[0], F
    for i, x in enumerate(d):
        out = out.when(x == best, F.lit(i))
    return out


def classification_metrics(df: DataFrame, truth: str, guess: str, by: list[str] | None = None) -> DataFrame:
    """accuracy, precision, recall, f1 of class 1; a zero denominator gives 0."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    counts = df.groupBy(*(by or [])).agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(F.col(truth) == F.col(guess)).alias("hit"), F.count(F.lit(1)).alias("n"))
    p, r = safe(F.col("tp"), F.col("tp") + F.col("fp")), safe(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(*(by or []), safe(F.col("hit"), F.col("n")).alias("accuracy"), p.alias("precision"), r.alias("recall"), safe(2 * p * r, p + r).alias("f1"))


def regression_metrics(df: DataFrame, truth: str, guess: str, by: list[str] | None = None) -> DataFrame:
    """mse, rmse, mae, r2 (0 without variance), mape in percent over truths other than 0."""
    y, p = F.col(truth), F.col(guess)
    return df.groupBy(*(by or [])).agg(
        F.avg((y - p) * (y - p)).alias("mse"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"),
        F.coalesce(1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)), F.lit(0.0)).alias("r2"),
        F.coalesce(100 * F.avg(F.when(y != 0, F.abs((y - p) / y))), F.lit(0.0)).alias("mape"),
    )
