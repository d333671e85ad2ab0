"""Focal operators over maps of several tiles, against one dense array."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspark.operators import distance as D
from terraspark.operators import maps as M
from terraspark.operators import stencil as T


@pytest.fixture(scope="module")
def raster(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 250, (37, 29))
    rows = [(z, x, int(a[z, x]), bool(a[z, x] % 3 == 0), None if a[z, x] % 7 == 0 else int(a[z, x])) for z in range(37) for x in range(29)]
    return a, spark.createDataFrame(rows, "z int, x int, v int, m boolean, w int")


def grid(df, name, shape=(37, 29)):
    out = np.full(shape, np.nan)
    for r in df.select("z", "x", name).collect():
        out[r["z"], r["x"]] = np.nan if r[name] is None else float(r[name])
    return out


@pytest.fixture(params=[256, 8], autouse=True)
def tile(request, monkeypatch):
    focal = T.focal
    monkeypatch.setattr(T, "focal", lambda *a, **k: focal(*a, **{"size": request.param, **k}))


def around(a, r):
    return np.lib.stride_tricks.sliding_window_view(np.pad(a.astype(float), r, constant_values=np.nan), (2 * r + 1, 2 * r + 1))


def test_least_and_greatest(raster):
    a, df = raster
    w = np.where(a % 7 == 0, np.nan, a)
    for size in (3, 5):
        assert np.array_equal(grid(T.min_filter(df, "v", "o", size), "o"), np.nanmin(around(a, size // 2), axis=(2, 3)))
        assert np.array_equal(grid(T.max_filter(df, "w", "o", size), "o"), np.nanmax(around(w, size // 2), axis=(2, 3)), equal_nan=True)
    even = np.array([[np.nanmin(np.pad(a.astype(float), ((2, 1), (2, 1)), constant_values=np.nan)[z : z + 4, x : x + 4]) for x in range(29)] for z in range(37)])
    assert np.array_equal(grid(T.min_filter(df, "v", "o", 4), "o"), even)


def test_median_and_mean(raster):
    a, df = raster
    wide = np.lib.stride_tricks.sliding_window_view(np.pad(a, 1, mode="edge"), (3, 3))
    assert np.array_equal(grid(T.median3(df, "v", "o"), "o"), np.median(wide, axis=(2, 3)))
    wide = np.lib.stride_tricks.sliding_window_view(np.pad(a, 3, mode="edge"), (7, 7))
    assert np.allclose(grid(T.mean_filter(df, "v", "o", 7), "o"), wide.mean(axis=(2, 3)))


def test_neighbours(raster):
    a, df = raster
    m = a % 3 == 0
    p = np.pad(m, 1)
    assert np.array_equal(grid(T.dilate4(df, "m", "o"), "o"), (m | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]).astype(float))
    e = np.pad(a, 1, mode="edge")
    assert np.array_equal(grid(T.slope(df, "v", "o"), "o"), np.max([abs(e[1 + i : 38 + i, 1 + j : 30 + j] - a) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))], 0))


@pytest.mark.parametrize("taxicab", [False, True])
def test_distance(raster, taxicab):
    a, df = raster
    b = a % 31 == 0
    z, x = np.nonzero(b)
    dz, dx = abs(np.arange(37)[:, None, None] - z), abs(np.arange(29)[None, :, None] - x)
    d = (dz + dx if taxicab else np.maximum(dz, dx)).min(2).astype(float)
    got = grid(T.capped_distance(df.withColumn("b", F.col("v") % 31 == 0), "b", 5, "o", taxicab), "o")
    assert np.array_equal(got, np.where(d <= 5, d, np.nan), equal_nan=True)


def test_masked_filters_and_chain(raster):
    a, df = raster
    on = a >= 60
    v = np.where(on, a, np.nan)
    low = np.where(on, np.nanmin(np.where(np.isnan(around(v, 2)), np.inf, around(v, 2)), axis=(2, 3)), np.nan)
    high = np.nanmax(np.where(np.isnan(around(low, 2)), -np.inf, around(low, 2)), axis=(2, 3))
    got = grid(T.opening(df.withColumn("k", F.col("v") >= 60), "v", "k", "o", 5), "o")
    assert np.array_equal(got, np.where(on, np.minimum(a, high), np.nan), equal_nan=True)
    # a chain of filters gives what its steps give one by one
    c = df.select("z", "x", F.col("v").alias("height"), F.col("m").alias("river"), (F.col("v") > 200).alias("lake")).withColumn("river", F.col("river") & ~F.col("lake"))
    one = M.river_bounds(c)
    d = T.min_filter(c.withColumn("_d", F.when(~F.col("river") & ~F.col("lake"), F.col("height")).otherwise(255)), "_d", "ceiling")
    d = T.min_filter(d.withColumn("fit", F.when(F.col("river"), F.least("height", "ceiling")).otherwise(F.col("height"))), "fit", "floor", 5)
    d = T.dilate4(T.median3(d, "floor", "_m"), "lake", "_t")
    d = T.min_filter(d.withColumn("_l", F.when(F.col("lake"), F.col("height")).otherwise(255)), "_l", "_lm")
    d = d.withColumn("surface0", F.when(F.col("_t") & ~F.col("lake"), F.col("_lm")).otherwise(F.least("floor", "_m")))
    for k in ("ceiling", "fit", "floor", "surface0"):
        assert np.array_equal(grid(one, k), grid(d, k))


def test_fill_interpolated_by_hand(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(1, 50, (9, 11)).astype(float)
    a[rng.random(a.shape) < 0.7] = np.nan
    cells = spark.createDataFrame([(z, x, None if np.isnan(v) else float(v)) for (z, x), v in np.ndenumerate(a)], "z int, x int, v double")
    for reach in (2, 500):
        got = {(r["z"], r["x"]): r["o"] for r in D.fill_interpolated(cells, "v", "o", reach).collect()}
        for (z, x), v in np.ndenumerate(a):
            near = []
            for dz, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
                for k in range(1, reach + 1):
                    if not (0 <= z + k * dz < 9 and 0 <= x + k * dx < 11):
                        break
                    if not np.isnan(a[z + k * dz, x + k * dx]):
                        near.append((a[z + k * dz, x + k * dx], 1 / k))
                        break
            want = v if not np.isnan(v) else sum(p * w for p, w in near) / sum(w for _, w in near) if near else None
            assert got[z, x] == (want if want is None else pytest.approx(want))


def test_fill_interpolated_across_bands(spark):
    # columns far longer than a band of 1024 cells, values close to where bands meet
    n, known = 2600, {(1020, 0): 4.0, (1027, 0): 8.0, (2047, 0): 2.0, (2048, 1): 6.0, (0, 1): 3.0, (2599, 1): 5.0}
    cells = spark.createDataFrame([(z, x, known.get((z, x))) for z in range(n) for x in range(2)], "z int, x int, v double")
    df = D.fill_interpolated(cells, "v", "o", 6)
    got = {(r["z"], r["x"]): r["o"] for r in df.collect()}
    assert len(got) == n * 2
    for z in range(n):
        for x in range(2):
            near = []
            for a, b in ((0, -1), (0, 1), (-1, 0), (1, 0)):
                hit = next(((known[z + a * d, x + b * d], d) for d in range(1, 7) if (z + a * d, x + b * d) in known), None)
                near += [hit] if hit else []
            want = known.get((z, x), sum(v / d for v, d in near) / sum(1 / d for _, d in near) if near else None)
            assert got[z, x] == want or abs(got[z, x] - want) < 1e-12
    # a frame from the row to the end of its column takes time that grows with the square of the column
    for plan in (df, D.fill_nearest(cells, "v", "o")):
        assert "unboundedfollowing" not in plan._jdf.queryExecution().toString().lower()
