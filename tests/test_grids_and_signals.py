"""Two-dimensional operators, transforms and draws against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import draws, grids, spectra

X = np.random.default_rng(1).normal(size=(6, 7)).round(3)


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(X.tolist(),)], "x array<array<double>>")


def value(df, c):
    return np.array(df.select(c.alias("v")).first()["v"])


def patches(x, size, stride, pad, dilation=(1, 1), fill=0.0):
    x = np.pad(x, ((pad[0],) * 2, (pad[1],) * 2), constant_values=fill)
    rows = (x.shape[0] - dilation[0] * (size[0] - 1) - 1) // stride[0] + 1
    cols = (x.shape[1] - dilation[1] * (size[1] - 1) - 1) // stride[1] + 1
    return np.array([[x[i * stride[0] : i * stride[0] + dilation[0] * (size[0] - 1) + 1 : dilation[0], j * stride[1] : j * stride[1] + dilation[1] * (size[1] - 1) + 1 : dilation[1]] for j in range(cols)] for i in range(rows)])


KERNEL = [[0.5, -1.0, 2.0], [0.0, 3.0, 0.25]]


@pytest.mark.parametrize("stride,pad,dilation", [((1, 1), (0, 0), (1, 1)), ((2, 1), (1, 2), (1, 1)), ((1, 3), (0, 1), (2, 2))])
def test_convolution(one, stride, pad, dilation):
    want = (patches(X, (2, 3), stride, pad, dilation) * np.array(KERNEL)).sum(axis=(2, 3)) + 0.5
    assert value(one, grids.convolved(F.col("x"), KERNEL, stride, pad, dilation, 0.5)) == pytest.approx(want)


@pytest.mark.parametrize("stride,pad", [((1, 1), (0, 0)), ((2, 3), (0, 1)), ((3, 2), (1, 0))])
def test_transposed_convolution_and_columns(one, stride, pad):
    full = np.zeros(((6 - 1) * stride[0] + 2, (7 - 1) * stride[1] + 3))
    for i in range(6):
        for j in range(7):
            full[i * stride[0] : i * stride[0] + 2, j * stride[1] : j * stride[1] + 3] += X[i, j] * np.array(KERNEL)
    want = full[pad[0] : full.shape[0] - pad[0], pad[1] : full.shape[1] - pad[1]]
    assert value(one, grids.conv_transposed(F.col("x"), KERNEL, stride, pad)) == pytest.approx(want)
    cols = patches(X, (2, 3), stride, pad)
    got = value(one, grids.columns_of(F.col("x"), (2, 3), stride, pad))
    assert got == pytest.approx(cols.reshape(-1, 6))
    back = np.zeros((6 + 2 * pad[0], 7 + 2 * pad[1]))
    for i in range(cols.shape[0]):
        for j in range(cols.shape[1]):
            back[i * stride[0] : i * stride[0] + 2, j * stride[1] : j * stride[1] + 3] += cols[i, j]
    assert value(one, grids.grid_of(grids.columns_of(F.col("x"), (2, 3), stride, pad), (6, 7), (2, 3), stride, pad)) == pytest.approx(back[pad[0] : 6 + pad[0], pad[1] : 7 + pad[1]])


def test_pools_and_rearrangements(one):
    for stride, pad in (((2, 3), (0, 0)), ((1, 2), (1, 1))):
        p = patches(X, (2, 3), stride, pad, fill=np.nan)
        for how, f in (("max", lambda p: np.nanmax(p, axis=(2, 3))), ("average", lambda p: np.nanmean(p, axis=(2, 3))), ("lp", lambda p: np.sqrt(np.nansum(p**2, axis=(2, 3))))):
            assert value(one, grids.pooled(F.col("x"), (2, 3), stride, pad, how)) == pytest.approx(f(p))
    even = F.slice(F.col("x"), 1, 6)
    deep = grids.space_to_depth(F.transform(even, lambda r: F.slice(r, 1, 6)), 2)
    assert value(one, deep) == pytest.approx(np.array([X[u:6:2, v:6:2] for u in (0, 1) for v in (0, 1)]))
    assert value(one, grids.depth_to_space(deep, 2)) == pytest.approx(X[:, :6])
    assert value(one, grids.resized(F.col("x"), 3, 14)) == pytest.approx(X[[1, 3, 5]][:, np.repeat(range(7), 2)])
    assert value(one, grids.convolved(F.slice(F.col("x"), 1, 1), KERNEL)).size == 0


@pytest.mark.parametrize("n", [1, 2, 8, 12, 35, 97, 4096])
def test_fourier(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    got = np.array([complex(r["re"], r["im"]) for r in df.select(spectra.fourier(F.col("x"), n).alias("v")).first()["v"]])
    assert np.abs(got - np.fft.fft(x)).max() < 1e-8
    if n <= 97:
        back = df.select(spectra.fourier_of_pairs(spectra.fourier(F.col("x"), n), n, inverse=True).alias("v")).first()["v"]
        assert [r["re"] for r in back] == pytest.approx(x.tolist(), abs=1e-9)


def test_short_time_and_mel(spark):
    x, w = np.random.default_rng(2).normal(size=50), np.hanning(16)
    df = spark.createDataFrame([(x.tolist(),), ([1.0] * 5,)], "x array<double>")
    got = [r["v"] for r in df.select(spectra.short_time(F.col("x"), 16, 5, w.tolist()).alias("v")).collect()]
    want = np.array([np.fft.fft(x[k : k + 16] * w) for k in range(0, 35, 5)])
    assert np.abs(np.array([[complex(c["re"], c["im"]) for c in f] for f in got[0]]) - want).max() < 1e-9 and got[1] == []
    m = np.array(spectra.mel_weights(8, 256, 16000, 0, 8000))
    assert m.shape == (129, 8) and (m.max(axis=0) == 1).all() and (m >= 0).all() and (np.diff(m.argmax(axis=0)) > 0).all()


def test_draws(spark):
    n = 20_000
    rows = spark.range(n).select("id", draws.uniform(F.col("id"), 0, 7).alias("u"), draws.normal(F.col("id"), 0, 7, 2.0, 3.0).alias("z"), draws.bernoulli(F.lit(0.3), F.col("id"), 1, 7).alias("b"), draws.multinomial([1, 0, 2, 5], F.col("id"), 3, 7).alias("m"))
    one, other = ({r["id"]: tuple(r) for r in df.collect()} for df in (rows, spark.range(n).repartition(7).select("id", *(rows.columns[1:] and [draws.uniform(F.col("id"), 0, 7).alias("u"), draws.normal(F.col("id"), 0, 7, 2.0, 3.0).alias("z"), draws.bernoulli(F.lit(0.3), F.col("id"), 1, 7).alias("b"), draws.multinomial([1, 0, 2, 5], F.col("id"), 3, 7).alias("m")]))))
    assert one == other
    u, z, b = (np.array([r[k] for r in one.values()]) for k in (1, 2, 3))
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and np.abs(np.histogram(u, 10, (0, 1))[0] / n - 0.1).max() < 0.01
    assert abs(z.mean() - 2) < 0.08 and abs(z.std() - 3) < 0.08 and abs(b.mean() - 0.3) < 0.015
    m = np.bincount(np.concatenate([r[4] for r in one.values()]), minlength=4) / (3 * n)
    assert m[1] == 0 and np.abs(m - np.array([1, 0, 2, 5]) / 8).max() < 0.01
    share, other = draws.alias_table([3.0, 1.0, 0.0])
    assert [round(sum(share[i] if i == k else 0 for i in range(3)) + sum(1 - share[i] for i in range(3) if other[i] == k and i != k), 9) / 3 for k in range(3)] == pytest.approx([0.75, 0.25, 0.0])
    for bad in ([], [0.0], [1.0, -1.0]):
        with pytest.raises(ValueError):
            draws.alias_table(bad)
