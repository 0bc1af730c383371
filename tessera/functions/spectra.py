"""Transforms of signals as Columns: mixed-radix Fourier transforms, short-time spectra, mel weights."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let


def factors(n: int) -> list[int]:
    out, p = [], 2
    while n > 1:
        while n % p == 0:
            out.append(p)
            n //= p
        p = p + 1 if p * p <= n else n
    return out


def _turn(cell: Column, angle: Column) -> tuple[Column, Column]:
    c, s = F.cos(angle), F.sin(angle)
    return cell["re"] * c - cell["im"] * s, cell["re"] * s + cell["im"] * c


def fourier(x: Column, n: int, inverse: bool = False) -> Column:
    """Array of (re, im), the transform of ``n`` values of x; shorter vectors are filled up with 0. x may hold numbers or (re, im).

    One stage for each prime factor p of n: from transforms of ``length`` values, which lie interleaved, to those of p times as
    many. A stage takes n * p products, so that a power of two takes 2 n log2 n in all.
    """
    sign = 1.0 if inverse else -1.0
    filled = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.get(x, i), F.lit(0.0)))
    state = F.transform(filled, lambda v: F.struct(v.cast("double").alias("re"), F.lit(0.0).alias("im")))
    return _stages(state, n, sign, 1.0 / n if inverse else 1.0)


def fourier_of_pairs(x: Column, n: int, inverse: bool = False) -> Column:
    """As fourier, of exactly n pairs (re, im)."""
    return _stages(F.transform(x, lambda v: F.struct(v["re"].cast("double").alias("re"), v["im"].cast("double").alias("im"))), n, 1.0 if inverse else -1.0, 1.0 / n if inverse else 1.0)


def _stages(state: Column, n: int, sign: float, scale: float) -> Column:
    length = 1
    for p in factors(n):
        state = _stage(state, n, length, p, sign)
        length *= p
    return F.transform(state, lambda v: F.struct((v["re"] * scale).alias("re"), (v["im"] * scale).alias("im"))) if scale != 1.0 else state


def _stage(state: Column, n: int, length: int, p: int, sign: float) -> Column:
    apart = n // (length * p)

    def cell(a: Column, k: Column) -> Column:
        j, r = F.floor(k / apart), k % apart
        base, angle = (j % length) * (n // length) + r, j * (sign * 2 * math.pi / (length * p))
        if p <= 8:
            parts = [_turn(F.get(a, (base + q * apart).cast("int")), angle * q) for q in range(p)]
            return F.struct(*(reduce(lambda u, v: u + v, (x[i] for x in parts)).alias(name) for i, name in enumerate(("re", "im"))))

        def add(s: Column, q: Column) -> Column:
            re, im = _turn(F.get(a, (base + q * apart).cast("int")), angle * q)
            return F.struct((s["re"] + re).alias("re"), (s["im"] + im).alias("im"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im")), add)

    return let(state, lambda a: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: cell(a, k)))


def short_time(x: Column, n: int, hop: int, window: list[float] | None = None) -> Column:
    """The transforms of all whole frames of ``n`` values, ``hop`` apart, each times the window."""
    weights = F.array(*(F.lit(float(w)) for w in window)) if window else None
    frames = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - n) / hop).cast("int")), lambda k: F.slice(x, k * hop + 1, n))
    one = lambda f: fourier(F.zip_with(f, weights, lambda v, w: v * w) if weights is not None else f, n)
    return F.when(F.size(x) >= n, F.transform(frames, one)).otherwise(F.array().cast("array<array<struct<re:double,im:double>>>"))


def mel_weights(bands: int, n: int, rate: float, low: float, high: float) -> list[list[float]]:
    """n // 2 + 1 rows of weights: triangles whose corners lie evenly on the mel scale, at whole bins."""
    mel, hertz = (lambda f: 2595 * math.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    step = (mel(high) - mel(low)) / (bands + 1)
    corner = [int((n + 1) * hertz(mel(low) + k * step) // rate) for k in range(bands + 2)]
    out = [[0.0] * bands for _ in range(n // 2 + 1)]
    for b in range(bands):
        left, top, right = corner[b : b + 3]
        for i in range(left, min(right, n // 2 + 1)):
            out[i][b] = (i - left) / (top - left) if i < top else (right - i) / (right - top)
        if left == top <= n // 2:
            out[top][b] = 1.0
    return out
