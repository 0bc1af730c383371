"""Two-dimensional model operators on arrays of rows: convolutions, their transposes, pools and column forms, as Columns."""

from __future__ import annotations

from functools import reduce, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let

Pair = tuple[int, int]


def _out(n: Column, kernel: int, stride: int, pad: int, dilation: int) -> Column:
    return F.floor((n + 2 * pad - dilation * (kernel - 1) - 1) / stride).cast("int") + 1


def _cells(rows: Column, cols: Column, f) -> Column:
    """rows x cols of f(i, j), 0-based; none where either is not positive."""
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    return F.when((rows > 0) & (cols > 0), F.transform(upto(rows), lambda i: F.transform(upto(cols), lambda j: f(i, j)))).otherwise(F.array().cast("array<array<double>>"))


def once(f):
    """The operator with its grid computed once a row: what an operator is given is an expression, which each cell would compute anew."""

    @wraps(f)
    def run(x: Column, *args, **kwargs) -> Column:
        return let(x, lambda grid: f(grid, *args, **kwargs))

    return run


def _at(x: Column, i: Column, j: Column, outside: Column) -> Column:
    """A value of the grid; what lies outside has one of its own."""
    row = F.when(i >= 0, F.get(x, i))
    return F.coalesce(F.when(j >= 0, F.get(row, j)), outside)


@once
def convolved(x: Column, kernel: list[list[float]], stride: Pair = (1, 1), pad: Pair = (0, 0), dilation: Pair = (1, 1), bias: float = 0.0) -> Column:
    """Each output is the product of the kernel with the patch below it; outside the grid is 0."""
    h, w = len(kernel), len(kernel[0])
    taps = [(u, v, float(k)) for u, row in enumerate(kernel) for v, k in enumerate(row) if k]

    def of(i: Column, j: Column) -> Column:
        parts = [k * _at(x, i * stride[0] + u * dilation[0] - pad[0], j * stride[1] + v * dilation[1] - pad[1], F.lit(0.0)) for u, v, k in taps]
        return reduce(lambda a, b: a + b, parts, F.lit(float(bias)))

    return _cells(_out(F.size(x), h, stride[0], pad[0], dilation[0]), _out(F.size(F.get(x, F.lit(0))), w, stride[1], pad[1], dilation[1]), of)


@once
def conv_transposed(x: Column, kernel: list[list[float]], stride: Pair = (1, 1), pad: Pair = (0, 0), bias: float = 0.0) -> Column:
    """Each value lays the kernel down, times itself, at its own place; an output adds up what lies on it."""
    h, w = len(kernel), len(kernel[0])
    rows, cols = (F.size(x) - 1) * stride[0] + h - 2 * pad[0], (F.size(F.get(x, F.lit(0))) - 1) * stride[1] + w - 2 * pad[1]

    def of(i: Column, j: Column) -> Column:
        parts = []
        for u, row in enumerate(kernel):
            for v, k in enumerate(row):
                a, b = i + pad[0] - u, j + pad[1] - v
                here = (a % stride[0] == 0) & (b % stride[1] == 0)
                parts.append(F.when(here, float(k) * _at(x, F.when(a >= 0, (a / stride[0]).cast("int")).otherwise(-1), F.when(b >= 0, (b / stride[1]).cast("int")).otherwise(-1), F.lit(0.0))).otherwise(0.0))
        return reduce(lambda a, b: a + b, parts, F.lit(float(bias)))

    return _cells(rows, cols, of)


@once
def columns_of(x: Column, size: Pair, stride: Pair = (1, 1), pad: Pair = (0, 0)) -> Column:
    """The patches of a grid, row by row, each as one array."""
    offsets = [(u, v) for u in range(size[0]) for v in range(size[1])]
    patch = lambda i, j: F.array(*(_at(x, i * stride[0] + u - pad[0], j * stride[1] + v - pad[1], F.lit(0.0)) for u, v in offsets))
    rows, cols = _out(F.size(x), size[0], stride[0], pad[0], 1), _out(F.size(F.get(x, F.lit(0))), size[1], stride[1], pad[1], 1)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    return F.when((rows > 0) & (cols > 0), F.flatten(F.transform(upto(rows), lambda i: F.transform(upto(cols), lambda j: patch(i, j))))).otherwise(F.array().cast("array<array<double>>"))


@once
def grid_of(patches: Column, shape: Pair, size: Pair, stride: Pair = (1, 1), pad: Pair = (0, 0)) -> Column:
    """What columns_of took apart, laid down again: where patches overlap they add up."""
    across = (shape[1] + 2 * pad[1] - size[1]) // stride[1] + 1
    down = (shape[0] + 2 * pad[0] - size[0]) // stride[0] + 1

    def of(i: Column, j: Column) -> Column:
        parts = []
        for u in range(size[0]):
            for v in range(size[1]):
                a, b = i + pad[0] - u, j + pad[1] - v
                here = (a >= 0) & (b >= 0) & (a % stride[0] == 0) & (b % stride[1] == 0) & (a < down * stride[0]) & (b < across * stride[1])
                parts.append(F.when(here, F.get(F.get(patches, ((a / stride[0]).cast("int") * across + (b / stride[1]).cast("int")).cast("int")), F.lit(u * size[1] + v))).otherwise(0.0))
        return reduce(lambda a, b: a + b, parts)

    return _cells(F.lit(shape[0]), F.lit(shape[1]), of)


@once
def pooled(x: Column, size: Pair, stride: Pair | None = None, pad: Pair = (0, 0), how: str = "max", p: int = 2) -> Column:
    """max, average (of what lies inside the grid) or lp over windows."""
    stride = stride or size
    offsets = [(u, v) for u in range(size[0]) for v in range(size[1])]
    none = F.lit(None).cast("double")

    def of(i: Column, j: Column) -> Column:
        met = F.filter(F.array(*(_at(x, i * stride[0] + u - pad[0], j * stride[1] + v - pad[1], none) for u, v in offsets)), lambda v: v.isNotNull())
        total = lambda f: lambda m: F.aggregate(m, F.lit(0.0), lambda a, v: a + f(v))
        if how == "max":
            return F.array_max(met)
        if how == "average":
            return let(met, lambda m: total(lambda v: v)(m) / F.size(m))
        return F.pow(let(met, total(lambda v: F.pow(F.abs(v), F.lit(float(p))))), F.lit(1.0 / p))

    return _cells(_out(F.size(x), size[0], stride[0], pad[0], 1), _out(F.size(F.get(x, F.lit(0))), size[1], stride[1], pad[1], 1), of)


@once
def depth_to_space(x: Column, block: int) -> Column:
    """block * block grids of one size as one grid: each block of cells is made of their cells at one place."""
    first = F.get(x, F.lit(0))
    pick = lambda i, j: F.get(F.get(F.get(x, ((i % block) * block + j % block).cast("int")), F.floor(i / block).cast("int")), F.floor(j / block).cast("int"))
    return _cells(F.size(first) * block, F.size(F.get(first, F.lit(0))) * block, pick)


@once
def space_to_depth(x: Column, block: int) -> Column:
    """The grids that depth_to_space puts together."""
    rows, cols = F.floor(F.size(x) / block).cast("int"), F.floor(F.size(F.get(x, F.lit(0))) / block).cast("int")
    return F.array(*(_cells(rows, cols, lambda i, j, u=u, v=v: F.get(F.get(x, (i * block + u).cast("int")), (j * block + v).cast("int"))) for u in range(block) for v in range(block)))


@once
def resized(x: Column, rows: int, cols: int) -> Column:
    """Nearest cells, by the centres of the new ones."""
    near = lambda i, n, m: F.floor((i + 0.5) * n / m).cast("int")
    return _cells(F.lit(rows), F.lit(cols), lambda i, j: F.get(F.get(x, near(i, F.size(x), rows)), near(j, F.size(F.get(x, F.lit(0))), cols)))
