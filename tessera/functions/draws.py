"""Random draws as Columns, by counter: a draw is a hash of seed, row key and number, so it is the same on any partitioning and any attempt of a task."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let


def uniform(key: Column, draw: int | Column = 0, seed: int = 0, low: float = 0.0, high: float = 1.0) -> Column:
    """From low on, below high; 53 bits."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, draw if isinstance(draw, Column) else F.lit(draw), F.lit("u")), 11)
    return F.lit(low) + bits / F.lit(float(1 << 53)) * F.lit(high - low)


def normal(key: Column, draw: int | Column = 0, seed: int = 0, mean: float = 0.0, scale: float = 1.0) -> Column:
    """By the polar form of two uniform draws."""
    u, v = uniform(key, draw, seed * 2 + 1), uniform(key, draw, seed * 2 + 2)
    return F.lit(mean) + scale * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def bernoulli(p: Column, key: Column, draw: int | Column = 0, seed: int = 0) -> Column:
    return (uniform(key, draw, seed) < p).cast("int")


def alias_table(weights: list[float]) -> tuple[list[float], list[int]]:
    """(share, other) for each place: a draw that falls on a place stays with probability ``share`` and goes to ``other`` else."""
    n, total = len(weights), math.fsum(weights)
    if not n or total <= 0 or min(weights) < 0:
        raise ValueError("weights must be at least 0, one of them above")
    share, other = [w * n / total for w in weights], list(range(n))
    short, long = [i for i in range(n) if share[i] < 1], [i for i in range(n) if share[i] >= 1]
    while short and long:
        s, b = short.pop(), long[-1]
        other[s] = b
        share[b] -= 1 - share[s]
        if share[b] < 1:
            short.append(long.pop())
    for i in short + long:
        share[i] = 1.0
    return share, other


def multinomial(weights: list[float], key: Column, draws: int, seed: int = 0) -> Column:
    """Array of ``draws`` 0-based places, each with the probability of its weight: one uniform draw and one look-up each."""
    share, other = alias_table(weights)
    n = len(weights)
    shares, others = F.array(*(F.lit(x) for x in share)), F.array(*(F.lit(x) for x in other))

    def place(u: Column) -> Column:
        at = F.least(F.floor(u * n).cast("int"), F.lit(n - 1))
        return F.when(u * n - at < F.get(shares, at), at).otherwise(F.get(others, at))

    return F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: let(uniform(key, i, seed), place))
