"""Exact quantiles by selection, and ordered training in parallel, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import fusion, quantiles


@pytest.mark.parametrize("most", [100_000, 50, 3])
def test_exact_quantiles(spark, most):
    rng, rows = random.Random(4), []
    for g, n in (("hot", 3000), ("ties", 900), ("one", 1), ("two", 2), (None, 60), ("none", 5)):
        for _ in range(n):
            v = {"ties": float(rng.randrange(3)), "none": None}.get(g, rng.choice([rng.gauss(0, 1), rng.expovariate(1e-6), float(rng.randrange(9))]))
            rows.append((g, v if rng.random() > 0.02 else None, "x"))
    percents = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double, n string").repartition(3), ["g"], "v", percents, most).collect()
    assert len(got) == 6
    for r in got:
        own = [v for g, v, _ in rows if g == r["g"] and v is not None]
        for name, p in percents.items():
            assert (r[name] is None) if not own else r[name] == pytest.approx(np.quantile(own, p), rel=1e-12, abs=1e-12)


def test_quantiles_of_odd_values(spark):
    rows = [(1, float("inf")), (1, 2.0), (1, float("nan")), (2, -0.0), (2, 0.0), (2, float("-inf"))]
    got = {r["g"]: r["m"] for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "g long, v double"), ["g"], "v", {"m": 0.5}, 1).collect()}
    assert got[1] == float("inf") and got[2] == 0.0
    assert quantiles.exact_quantiles(spark.createDataFrame([], "g long, v double"), ["g"], "v", {"m": 0.5}).collect() == []


def one_by_one(rows, rate, epochs, logistic):
    w, b, loss = [1 / 3] * 3, 0.0, 0.0
    for _ in range(epochs):
        loss = 0.0
        for *x, y in rows:
            z = sum(p * q for p, q in zip(w, x, strict=True)) + b
            e = (1 / (1 + math.exp(-z)) if logistic else z) - y
            loss += e * e
            w = [p - rate * e * q for p, q in zip(w, x, strict=True)]
            b -= rate * e
    return w, b, loss / len(rows)


@pytest.mark.parametrize("logistic", [True, False])
@pytest.mark.parametrize("bin_rows", [10**6, 100, 37])
def test_fusion_training_is_the_ordered_run(spark, logistic, bin_rows):
    rng = random.Random(6)
    rows = [(rng.random(), rng.random() * 3, float(rng.random() < 0.3), float(rng.random() < 0.4)) for _ in range(1500)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, vector double, keyword double, graph double, y double").repartition(4)
    got = fusion.train_fusion(df, ["vector", "keyword", "graph"], "y", ["i"], rate=0.05, epochs=2, logistic=logistic, bin_rows=bin_rows)
    w, b, loss = one_by_one(rows, 0.05, 2, logistic)
    assert got.weights == pytest.approx(w, abs=1e-9) and got.bias == pytest.approx(b, abs=1e-9) and got.loss == pytest.approx(loss, abs=1e-9)
    assert got.rounds <= (2 if bin_rows > 1500 else 12)


def test_fusion_training_without_samples(spark):
    df = spark.createDataFrame([(1, 0.5, None, None), (None, 0.5, 0.1, 1.0)], "i long, a double, b double, y double")
    assert fusion.train_fusion(df, ["a", "b"], "y", ["i"]) == fusion.Fusion((0.5, 0.5), 0.0, 0.0, 0)
    one = fusion.train_fusion(df.withColumn("y", F.lit(1.0)), ["a", "b"], "y", ["i"], rate=0.1, epochs=1)
    e = 1 / (1 + math.exp(-0.25)) - 1
    assert one.weights == pytest.approx((0.5 - 0.1 * e * 0.5, 0.5)) and one.bias == pytest.approx(-0.1 * e)
