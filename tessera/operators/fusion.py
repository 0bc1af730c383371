"""Training of the fusion model: one step for each sample in order, computed in parallel and equal to the ordered run.

A run over a stretch of samples is a map from the weights before it to those after it. The samples are cut into bins by
order. Each bin is run from a guess of the weights that come in, and along with the result it gives the map's derivative
there, a small matrix. One pass over the bins in order corrects all guesses at once; for the linear model, whose steps are
affine, the first correction is exact, for the logistic one corrections go on until the guesses stand (Newton's method on
the borders, which converges quadratically).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import stored
from .scans import binned


@dataclass(frozen=True)
class Fusion:
    weights: tuple[float, ...]
    bias: float
    loss: float  # mean squared error along the last epoch
    rounds: int  # corrections that the last epoch took


def _run(n: int, rate: float, logistic: bool) -> Column:
    """The fold of a bin's samples from the weights w0.. (the last one the bias): weights, derivative d<i>_<j>, loss."""
    cells = [(i, j) for i in range(n) for j in range(n)]
    zero = F.struct(*(F.col(f"w{i}").alias(f"w{i}") for i in range(n)), *(F.lit(float(i == j)).alias(f"d{i}_{j}") for i, j in cells), F.lit(0.0).alias("loss"))

    def step(a: Column, s: Column) -> Column:
        x = [s[f"x{i}"] for i in range(n - 1)] + [F.lit(1.0)]
        z = reduce(lambda p, q: p + q, (a[f"w{i}"] * x[i] for i in range(n)))
        p = 1.0 / (1.0 + F.exp(-z)) if logistic else z
        error, slope = p - s["y"], p * (1.0 - p) if logistic else F.lit(1.0)
        along = [reduce(lambda p, q: p + q, (x[i] * a[f"d{i}_{j}"] for i in range(n))) for j in range(n)]
        return F.struct(*((a[f"w{i}"] - rate * error * x[i]).alias(f"w{i}") for i in range(n)), *((a[f"d{i}_{j}"] - rate * slope * x[i] * along[j]).alias(f"d{i}_{j}") for i, j in cells), (a["loss"] + error * error).alias("loss"))

    return F.aggregate("samples", zero, step)


def train_fusion(samples: DataFrame, features: list[str], target: str, order: list[str], rate: float = 0.01, epochs: int = 3, logistic: bool = True, bin_rows: int = 10_000, tolerance: float = 1e-12, most_rounds: int = 50) -> Fusion:
    """The model after ``epochs`` runs over the samples in ``order`` (distinct; the first of them a number or a time), from equal weights and no bias.

    Each sample moves the weights by ``rate`` times error times feature, and the bias by ``rate`` times error. A null feature
    counts as 0, samples without a target or an order are left out; no samples leave the model as it is, with loss 0. At
    most 1,024 bins are folded at a time, each in one task; the driver gets one small map for each.
    """
    n = len(features) + 1
    given = samples.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [target, *order]))
    one = given.select(F.lit(0).alias("_all"), *order, *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)), F.col(target).cast("double").alias("y"))
    of = F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), *(f"x{i}" for i in range(n - 1)), "y")
    bins = binned(one, ["_all"], order[0], bin_rows, "bin").groupBy(F.coalesce("bin", F.lit(0)).alias("bin")).agg(F.array_sort(F.collect_list(of)).alias("samples"), F.count(F.lit(1)).alias("n"))
    bins = stored(bins, "samples")
    size = {r["bin"]: r["n"] for r in bins.select("bin", "n").collect()}
    state, loss, rounds = np.array([1.0 / (n - 1)] * (n - 1) + [0.0]), 0.0, 0
    guess = {b: state for b in size}
    for _ in range(epochs if size else 0):
        for rounds in range(1, most_rounds + 1):
            came = bins.sparkSession.createDataFrame([(b, *map(float, w)) for b, w in guess.items()], f"bin int, {', '.join(f'w{i} double' for i in range(n))}")
            maps = {r["bin"]: r["map"] for r in bins.join(F.broadcast(came), "bin").select("bin", _run(n, rate, logistic).alias("map")).collect()}
            into, apart, now = {}, 0.0, state
            for b in sorted(size):
                into[b], moved = now, now - guess[b]
                apart = max(apart, float(np.abs(moved).max()))
                m = maps[b]
                now = np.array([m[f"w{i}"] for i in range(n)]) + np.array([[m[f"d{i}_{j}"] for j in range(n)] for i in range(n)]) @ moved
            guess = into
            if apart <= tolerance:
                break
        else:
            raise RuntimeError(f"the weights at the borders of bins did not settle in {most_rounds} rounds")
        loss = sum(m["loss"] for m in maps.values()) / sum(size.values())
        state = now
        # The next epoch starts where this one ended: a first guess for its borders.
        guess = {b: state + (w - guess[min(size)]) for b, w in guess.items()}
    return Fusion(tuple(map(float, state[:-1])), float(state[-1]), float(loss), rounds)
