"""Operators of model graphs as Columns: numbers are doubles, vectors arrays of doubles, matrices arrays of rows.

Everything stays inside a row. Null inputs give null. Sizes and weights are given when a plan is built.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import dot, let, norm

# --- numbers ---------------------------------------------------------------------------------------------------------


def erf(x: Column) -> Column:
    """By the rational approximation of Abramowitz and Stegun, 7.1.26: within 1.5e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def prelu(x: Column, slope: Column) -> Column:
    return F.when(x >= 0, x).otherwise(slope * x)


def shrink(x: Column, bias: float = 0.0, border: float = 0.5) -> Column:
    return F.when(x < -border, x + bias).when(x > border, x - bias).otherwise(0.0)


def quantize_linear(x: Column, scale: float, zero: int = 0, low: int = -128, high: int = 127) -> Column:
    """Half to even, within the bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.rint(x / scale) + zero)).cast("int")


def dequantize_linear(q: Column, scale: float, zero: int = 0) -> Column:
    return (q - zero) * F.lit(scale)


def is_inf(x: Column) -> Column:
    return F.abs(x) == F.lit(float("inf"))


def mod(a: Column, b: Column) -> Column:
    """With the divisor's sign."""
    return a - b * F.floor(a / b)


def bit_shift(x: Column, n: int) -> Column:
    return F.shiftleft(x, n) if n >= 0 else F.shiftright(x, -n)


def mean_of(*xs: Column) -> Column:
    return sum(xs[1:], xs[0]) / float(len(xs))


#: One number in, one out.
UNARY = {
    "acos": F.acos, "acosh": F.acosh, "asin": F.asin, "asinh": F.asinh, "atan": F.atan, "atanh": F.atanh, "cos": F.cos, "cosh": F.cosh, "sin": F.sin, "sinh": F.sinh, "tan": F.tan, "tanh": F.tanh,
    "exp": F.exp, "log": F.log, "erf": erf, "gelu": gelu, "shrink": shrink, "neg": lambda x: -x, "ceil": F.ceil, "floor": F.floor, "round": F.rint, "is_nan": F.isnan, "is_inf": is_inf, "sign": F.signum,
}
#: Two in, one out.
BINARY = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: F.try_divide(a, b), "pow": F.pow, "mod": mod, "max": F.greatest, "min": F.least, "mean": mean_of, "prelu": prelu,
    "equal": lambda a, b: a == b, "greater": lambda a, b: a > b, "less": lambda a, b: a < b, "xor": lambda a, b: (a > 0) != (b > 0), "and": lambda a, b: (a > 0) & (b > 0), "or": lambda a, b: (a > 0) | (b > 0),
}

# --- vectors ---------------------------------------------------------------------------------------------------------


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return F.try_divide(total(x), F.size(x))


def variance(x: Column) -> Column:
    return let(mean(x), lambda m: mean(F.transform(x, lambda v: (v - m) * (v - m))))


def softmax(x: Column) -> Column:
    return let(F.array_max(x), lambda m: let(F.transform(x, lambda v: F.exp(v - m)), lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s))))


def reduce_log_sum_exp(x: Column) -> Column:
    return let(F.array_max(x), lambda m: m + F.log(total(F.transform(x, lambda v: F.exp(v - m)))))


def log_softmax(x: Column) -> Column:
    return let(reduce_log_sum_exp(x), lambda s: F.transform(x, lambda v: v - s))


def hardmax(x: Column) -> Column:
    return let(F.array_position(x, F.array_max(x)), lambda at: F.transform(x, lambda _, i: F.when(i + 1 == at, 1.0).otherwise(0.0)))


def _scan(x: Column, start: float, f) -> Column:
    """Running results of a fold."""
    state = F.struct(F.lit(start).alias("v"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(x, state, lambda a, v: let(f(a["v"], v), lambda n: F.struct(n.alias("v"), F.concat(a["out"], F.array(n)).alias("out"))), lambda a: a["out"])


def cum_sum(x: Column) -> Column:
    return _scan(x, 0.0, lambda a, v: a + v)


def cum_prod(x: Column) -> Column:
    return _scan(x, 1.0, lambda a, v: a * v)


def layer_normalization(x: Column, scale: float = 1.0, bias: float = 0.0, epsilon: float = 1e-5) -> Column:
    return let(mean(x), lambda m: let(F.sqrt(variance(x) + epsilon), lambda d: F.transform(x, lambda v: (v - m) / d * scale + bias)))


def rms_normalization(x: Column, epsilon: float = 1e-5) -> Column:
    return let(F.sqrt(mean(F.transform(x, lambda v: v * v)) + epsilon), lambda d: F.transform(x, lambda v: v / d))


def lp_normalization(x: Column, p: int = 2) -> Column:
    size = norm(x) if p == 2 else total(F.transform(x, F.abs))
    return let(size, lambda n: F.transform(x, lambda v: F.coalesce(F.try_divide(v, n), F.lit(0.0))))


def batch_normalization(x: Column, means: list[float], variances: list[float], scale: float = 1.0, bias: float = 0.0, epsilon: float = 1e-5) -> Column:
    """A mean and a variance for each place."""
    m, d = F.array(*map(F.lit, means)), F.array(*(F.lit(math.sqrt(v + epsilon)) for v in variances))
    return F.transform(x, lambda v, i: (v - F.get(m, i)) / F.get(d, i) * scale + bias)


def group_normalization(x: Column, groups: int, epsilon: float = 1e-5) -> Column:
    """Each of ``groups`` equal stretches by itself; one group: instance normalization."""
    return F.flatten(F.transform(split(x, groups), lambda g: layer_normalization(g, epsilon=epsilon)))


def local_response_normalization(x: Column, size: int = 3, alpha: float = 1e-4, beta: float = 0.75, bias: float = 1.0) -> Column:
    half = (size - 1) // 2
    near = lambda i: F.slice(x, F.greatest(i - half, F.lit(0)) + 1, F.least(i + size - 1 - half, F.size(x) - 1) - F.greatest(i - half, F.lit(0)) + 1)
    return F.transform(x, lambda v, i: v / F.pow(bias + alpha / size * total(F.transform(near(i), lambda w: w * w)), F.lit(beta)))


def split(x: Column, parts: int) -> Column:
    """Equal parts in order; the last takes what is left."""
    step = F.ceil(F.size(x) / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(x, i * step + 1, step))


def pad(x: Column, before: int, after: int, value: float = 0.0) -> Column:
    return F.concat(F.array_repeat(F.lit(value), before), x, F.array_repeat(F.lit(value), after))


def tile(x: Column, times: int) -> Column:
    return F.flatten(F.array_repeat(x, times))


def top_k(x: Column, k: int) -> Column:
    """The k largest values, in decreasing order."""
    return F.slice(F.sort_array(x, asc=False), 1, k)


def gather(x: Column, at: list[int]) -> Column:
    """Values at 0-based places; negative ones count from the end."""
    return F.array(*(F.try_element_at(x, F.lit(i + 1 if i >= 0 else i)) for i in at))


def scatter(x: Column, values: dict[int, float]) -> Column:
    m = F.create_map(*(F.lit(v) for k in values.items() for v in k))
    return F.transform(x, lambda v, i: F.coalesce(F.try_element_at(m, i), v))


def compress(x: Column, keep: Column) -> Column:
    """Values where the array of booleans is true."""
    return F.transform(F.filter(F.arrays_zip(x.alias("x"), keep.alias("k")), lambda z: z["k"]), lambda z: z["x"])


def non_zero(x: Column) -> Column:
    """0-based places of what is not 0."""
    return F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i) != 0)


def reverse_sequence(x: Column, length: Column) -> Column:
    """The first ``length`` values turned round, the others as they are."""
    return F.concat(F.reverse(F.slice(x, F.lit(1), length)), F.slice(x, length + 1, F.size(x)))


def one_hot(at: Column, depth: int, off: float = 0.0, on: float = 1.0) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.when(i == at, on).otherwise(off))


def pooled(x: Column, size: int, stride: int, how: str, p: int = 2) -> Column:
    """Pools of one dimension, whole windows only: max, average or lp."""
    f = {"max": F.array_max, "average": mean, "lp": lambda w: F.pow(total(F.transform(w, lambda v: F.pow(F.abs(v), F.lit(float(p))))), F.lit(1.0 / p))}[how]
    return F.when(F.size(x) >= size, F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - size) / stride).cast("int")), lambda i: f(F.slice(x, i * stride + 1, size))))


def global_pool(x: Column, how: str, p: int = 2) -> Column:
    return {"max": F.array_max, "average": mean, "lp": lambda w: F.pow(total(F.transform(w, lambda v: F.pow(F.abs(v), F.lit(float(p))))), F.lit(1.0 / p))}[how](x)


def convolved(x: Column, kernel: list[float], stride: int = 1, bias: float = 0.0) -> Column:
    """Of one dimension, without padding."""
    w = F.array(*map(F.lit, kernel))
    return F.when(F.size(x) >= len(kernel), F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - len(kernel)) / stride).cast("int")), lambda i: dot(F.slice(x, i * stride + 1, len(kernel)), w) + bias))


def dft(x: Column) -> Column:
    """(re, im) of each frequency, by its definition: for short vectors."""
    part = lambda k, f: F.aggregate(F.transform(x, lambda v, t: v * f(2 * math.pi * k * t / F.size(x))), F.lit(0.0), lambda a, v: a + v)
    return F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda k: F.struct(part(k, F.cos).alias("re"), (-part(k, F.sin)).alias("im")))


def window_values(kind: str, size: Column) -> Column:
    """Periodic hann, hamming or blackman windows."""
    weights = {"hann": (0.5, 0.5, 0.0), "hamming": (25 / 46, 21 / 46, 0.0), "blackman": (0.42, 0.5, 0.08)}[kind]
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: weights[0] - weights[1] * F.cos(2 * math.pi * i / size) + weights[2] * F.cos(4 * math.pi * i / size))


def dynamic_quantize_linear(x: Column) -> Column:
    """(scale, zero, values) to bytes without a sign; the range takes in 0."""
    low, high = F.least(F.lit(0.0), F.array_min(x)), F.greatest(F.lit(0.0), F.array_max(x))

    def of(r: Column) -> Column:
        zero = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(-r["low"] / r["scale"])))
        return let(zero, lambda z: F.struct(r["scale"].alias("scale"), z.cast("int").alias("zero"), F.transform(x, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(v / r["scale"]) + z)).cast("int")).alias("values")))

    return let(F.struct(low.alias("low"), ((high - low) / 255).alias("scale")), of)


def softmax_cross_entropy(x: Column, at: Column) -> Column:
    """Loss of scores when the class at the 0-based place is right."""
    return reduce_log_sum_exp(x) - F.get(x, at)


def negative_log_likelihood(log_p: Column, at: Column) -> Column:
    return -F.get(log_p, at)


# --- matrices --------------------------------------------------------------------------------------------------------


def matrix(rows: list[list[float]]) -> Column:
    return F.array(*(F.array(*(F.lit(float(v)) for v in r)) for r in rows))


def transposed(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(m, 0)) - 1), lambda j: F.transform(m, lambda r: F.get(r, j)))


def matmul(a: Column, b: Column) -> Column:
    return let(transposed(b), lambda t: F.transform(a, lambda r: F.transform(t, lambda c: dot(r, c))))


def gemm(a: Column, b: Column, c: float = 0.0, alpha: float = 1.0, beta: float = 1.0) -> Column:
    return F.transform(matmul(a, b), lambda r: F.transform(r, lambda v: alpha * v + beta * c))


def outer(a: Column, b: Column) -> Column:
    """The product i,j->ij."""
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


def eye(n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when(i == j, 1.0).otherwise(0.0)))


def triangle(m: Column, upper: bool = True) -> Column:
    return F.transform(m, lambda r, i: F.transform(r, lambda v, j: F.when((j >= i) if upper else (j <= i), v).otherwise(0.0)))


def reshaped(x: Column, width: int) -> Column:
    """A vector as rows of ``width``."""
    return F.transform(F.sequence(F.lit(0), (F.size(x) / width).cast("int") - 1), lambda i: F.slice(x, i * width + 1, width))


def determinant(m: Column, n: int) -> Column:
    """By expansion along the first row, for n up to 4."""

    def of(rows: tuple[int, ...], cols: tuple[int, ...]) -> Column:
        cell = lambda j: F.get(F.get(m, rows[0]), j)
        if len(rows) == 1:
            return cell(cols[0])
        out = None
        for k, j in enumerate(cols):
            part = cell(j) * of(rows[1:], cols[:k] + cols[k + 1 :])
            out = part if out is None else out + part if k % 2 == 0 else out - part
        return out

    if n > 4:
        raise ValueError("determinants of matrices over 4 x 4 are not expanded")
    return of(tuple(range(n)), tuple(range(n)))


# --- text and maps ---------------------------------------------------------------------------------------------------


def regex_full_match(s: Column, pattern: str) -> Column:
    return s.rlike(f"^(?:{pattern})$")


def string_normalized(words: Column, case: str = "lower", stop: list[str] | None = None) -> Column:
    """Words but for stop words, in one case."""
    kept = F.filter(words, lambda w: ~w.isin(stop)) if stop else words
    return F.transform(kept, F.lower if case == "lower" else F.upper)


def category(s: Column, names: list[str], unknown: int = -1) -> Column:
    """The place of a name in the list."""
    return F.coalesce(F.try_element_at(F.create_map(*(v for i, n in enumerate(names) for v in (F.lit(n), F.lit(i)))), s), F.lit(unknown))


def dict_vector(m: Column, keys: list[str]) -> Column:
    """A map's values in the order of the keys, 0 for those it lacks."""
    return F.array(*(F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0.0)) for k in keys))


def zip_map(values: Column, keys: list[str]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, keys)), values)


def tf_idf(words: Column, weights: dict[str, float]) -> Column:
    """Counts of the vocabulary's words times their weights, in its order."""
    count = lambda k: F.size(F.filter(words, lambda w: w == k))
    return F.array(*(count(k) * F.lit(float(x)) for k, x in weights.items()))


# --- models ----------------------------------------------------------------------------------------------------------


def naive_bayes(features: Column, classes: dict[str, tuple[float, list[float], list[float]]]) -> Column:
    """The class with the highest log density: class -> (prior, means, variances); of equals the first."""
    place = lambda xs: F.array(*(F.lit(float(v)) for v in xs))

    def log_p(prior: float, means: list[float], variances: list[float]) -> Column:
        m, v = place(means), place(variances)
        return math.log(prior) - 0.5 * sum(math.log(2 * math.pi * x) for x in variances) - 0.5 * total(F.transform(features, lambda x, i: (x - F.get(m, i)) * (x - F.get(m, i)) / F.get(v, i)))

    scores = F.array(*(log_p(*c) for c in classes.values()))
    return let(scores, lambda s: F.get(F.array(*map(F.lit, classes)), (F.array_position(s, F.array_max(s)) - 1).cast("int")))


def embedding(at: Column, table: list[list[float]]) -> Column:
    return F.get(matrix(table), at)


def _affine(w: Column, x: Column, b: list[float]) -> Column:
    bias = F.array(*(F.lit(float(v)) for v in b))
    return F.transform(w, lambda r, i: dot(r, x) + F.get(bias, i))


def rnn(xs: Column, w: list[list[float]], u: list[list[float]], b: list[float]) -> Column:
    """The last state of h = tanh(W x + U h + b) over an array of input vectors."""
    start = F.array(*(F.lit(0.0) for _ in b))
    return F.aggregate(xs, start, lambda h, x: F.zip_with(_affine(matrix(w), x, b), _affine(matrix(u), h, [0.0] * len(b)), lambda p, q: F.tanh(p + q)))


def _gate(k: int, size: int, w, u, b, x: Column, h: Column, f) -> Column:
    cut = slice(k * size, (k + 1) * size)
    return F.zip_with(_affine(matrix(w[cut]), x, b[cut]), _affine(matrix(u[cut]), h, [0.0] * size), lambda p, q: f(p + q))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def lstm(xs: Column, w: list[list[float]], u: list[list[float]], b: list[float]) -> Column:
    """The last output; weights hold the input, output, forget and cell gates below each other."""
    size = len(b) // 4
    zero = F.array(*(F.lit(0.0) for _ in range(size)))

    def step(a: Column, x: Column) -> Column:
        i, o, f, c = (_gate(k, size, w, u, b, x, a["h"], F.tanh if k == 3 else _sigmoid) for k in range(4))
        cell = F.zip_with(F.zip_with(f, a["c"], lambda p, q: p * q), F.zip_with(i, c, lambda p, q: p * q), lambda p, q: p + q)
        return let(cell, lambda n: F.struct(F.zip_with(o, n, lambda p, q: p * F.tanh(q)).alias("h"), n.alias("c")))

    return F.aggregate(xs, F.struct(zero.alias("h"), zero.alias("c")), step, lambda a: a["h"])


def gru(xs: Column, w: list[list[float]], u: list[list[float]], b: list[float]) -> Column:
    """The last output; weights hold the update, reset and hidden gates below each other, the reset acting on the state."""
    size = len(b) // 3
    zero = F.array(*(F.lit(0.0) for _ in range(size)))

    def step(h: Column, x: Column) -> Column:
        z, r = (_gate(k, size, w, u, b, x, h, _sigmoid) for k in range(2))
        new = let(F.zip_with(r, h, lambda p, q: p * q), lambda rh: _gate(2, size, w, u, b, x, rh, F.tanh))
        mixed = F.zip_with(F.zip_with(z, h, lambda p, q: p * q), F.zip_with(z, new, lambda p, q: (1 - p) * q), lambda p, q: p + q)
        return mixed

    return F.aggregate(xs, zero, step)


def momentum(x: Column, g: Column, v: Column, rate: float, alpha: float = 0.9) -> Column:
    """(x, v) after one step."""
    return let(alpha * v + g, lambda n: F.struct((x - rate * n).alias("x"), n.alias("v")))


def adagrad(x: Column, g: Column, squares: Column, rate: float, epsilon: float = 1e-6) -> Column:
    return let(squares + g * g, lambda n: F.struct((x - rate * g / (F.sqrt(n) + epsilon)).alias("x"), n.alias("squares")))


def adam(x: Column, g: Column, m: Column, v: Column, step: int, rate: float, a: float = 0.9, b: float = 0.999, epsilon: float = 1e-8) -> Column:
    own = rate * math.sqrt(1 - b**step) / (1 - a**step)
    return let(F.struct((a * m + (1 - a) * g).alias("m"), (b * v + (1 - b) * g * g).alias("v")), lambda n: F.struct((x - own * n["m"] / (F.sqrt(n["v"]) + epsilon)).alias("x"), n["m"].alias("m"), n["v"].alias("v")))


# --- sequences, optional values, control -------------------------------------------------------------------------------


def sequence_erase(xs: Column, at: int) -> Column:
    return F.filter(xs, lambda _, i: i != at)


def sequence_insert(xs: Column, value: Column, at: int) -> Column:
    return F.concat(F.slice(xs, F.lit(1), F.lit(at)), F.array(value), F.slice(xs, F.lit(at + 1), F.greatest(F.size(xs) - at, F.lit(0))))


def sequence_pop(xs: Column) -> Column:
    return F.slice(xs, F.lit(1), F.greatest(F.size(xs) - 1, F.lit(0)))


def optional_has_element(x: Column) -> Column:
    return x.isNotNull()


def loop(start: Column, most: int, go_on, body) -> Column:
    """``body`` up to ``most`` times while ``go_on`` holds for the state."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, lambda a, i: F.when(go_on(a), body(a, i)).otherwise(a))


def do_until(start: Column, most: int, done, body) -> Column:
    """``body`` once, and again, up to ``most`` times in all, until ``done`` holds for the state."""
    once = F.struct(start.alias("a"), F.lit(False).alias("done"))

    def step(s: Column, i: Column) -> Column:
        return F.when(s["done"], s).otherwise(let(body(s["a"], i), lambda a: F.struct(a.alias("a"), F.coalesce(done(a), F.lit(False)).alias("done"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), once, step)["a"]
