"""Warps within and across coordinate systems against sums over all source cells."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspark.grid import Grid, grid_bounds, project, transform, unproject
from terraspark.operators import warp as WP
from tests.test_build import raster

DEGREES = Grid(0.25, 0.0, 12.0, 0.0, -0.5, 60.0, 24, 40, "EPSG:4326")


def test_systems_and_their_inverse(spark):
    rng = random.Random(1)
    places = [(rng.uniform(-179, 179), rng.uniform(-80, 80)) for _ in range(50)]
    for crs in ("EPSG:3857", "EPSG:4326"):
        for lon, lat in places:
            assert unproject(*project(np.float64(lon), np.float64(lat), crs, np), crs, np) == pytest.approx((lon, lat), abs=1e-9)
    for zone in (1, 33, 60):
        for crs, lats in ((f"EPSG:{32600 + zone}", (0, 84)), (f"EPSG:{32700 + zone}", (-80, 0))):
            for _ in range(20):
                lon, lat = zone * 6 - 183 + rng.uniform(-3.5, 3.5), rng.uniform(*lats)
                assert unproject(*project(np.float64(lon), np.float64(lat), crs, np), crs, np) == pytest.approx((lon, lat), abs=2e-8)
    df = spark.createDataFrame([(15.5, 51.25), (12.0, 0.0)], "lon double, lat double")
    x, y = transform(F.col("lon"), F.col("lat"), "EPSG:4326", "EPSG:32633")
    for r in df.select("lon", "lat", x.alias("x"), y.alias("y")).collect():
        assert (r["x"], r["y"]) == pytest.approx(project(np.float64(r["lon"]), np.float64(r["lat"]), "EPSG:32633", np), abs=1e-6)
    g = Grid(1000.0, 0.0, 400000.0, 0.0, -1000.0, 5600000.0, 200, 100, "EPSG:32633")
    lon0, lat0, lon1, lat1 = grid_bounds(spark, g)
    assert 13 < lon0 < 15 < lon1 < 17 and 49 < lat0 < lat1 < 51
    with pytest.raises(ValueError):
        project(1.0, 2.0, "EPSG:2056", np)


def by_hand(a, source, target, method):
    """Every target cell from all source cells."""
    kernel = {"bilinear": lambda d: max(0.0, 1 - abs(d)), "cubic": lambda d: float(WP._spline(np.array(d)))}.get(method)
    sz, sx = WP.source_scale(source, target)
    out = {}
    for z in range(target.height):
        for x in range(target.width):
            wx, wy = target.a * (x + 0.5) + target.c, target.e * (z + 0.5) + target.f
            px, py = transform(np.float64(wx), np.float64(wy), target.crs, source.crs, np)
            c, r = (px - source.c) / source.a, (py - source.f) / source.e
            if method == "nearest":
                i, j = math.floor(r), math.floor(c)
                out[z, x] = a[i, j] if 0 <= i < a.shape[0] and 0 <= j < a.shape[1] else np.nan
                continue
            s = n = 0.0
            for i in range(a.shape[0]):
                if (w := kernel((i + 0.5 - r) / sz)) > 0:
                    for j in range(a.shape[1]):
                        k = w * kernel((j + 0.5 - c) / sx)
                        if k > 0 and not np.isnan(a[i, j]):
                            s, n = s + k * a[i, j], n + k
            out[z, x] = s / n if n else np.nan
    return out


TARGETS = {
    "mercator": Grid(40000.0, 0.0, 1250000.0, 0.0, -90000.0, 8500000.0, 20, 30, "EPSG:3857"),
    "utm": Grid(30000.0, 0.0, 150000.0, 0.0, -70000.0, 6700000.0, 24, 30, "EPSG:32633"),
    "coarse utm": Grid(90000.0, 0.0, 150000.0, 0.0, -200000.0, 6700000.0, 8, 10, "EPSG:32633"),
    "same": Grid(0.4, 0.0, 11.0, 0.0, -0.75, 61.0, 20, 30, "EPSG:4326"),
}


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic"])
@pytest.mark.parametrize("to", list(TARGETS))
def test_by_hand(spark, monkeypatch, to, method):
    monkeypatch.setattr(WP, "SIDE", 16)
    monkeypatch.setattr(WP, "BUCKET", 8)
    a = np.random.default_rng(3).integers(0, 100, (40, 24)).astype(float)
    a[np.random.default_rng(4).random(a.shape) < 0.3] = np.nan
    a[:12, :12] = np.nan
    cells = raster(spark, a).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    want = by_hand(a, DEGREES, TARGETS[to], method)
    got = {(r["z"], r["x"]): r["v"] for r in WP.warp(cells, DEGREES, TARGETS[to], method=method).collect()}
    assert got.keys() == want.keys() and any(v is None for v in got.values())
    for k, v in want.items():
        assert (got[k] is None) == bool(np.isnan(v)) and (got[k] is None or got[k] == pytest.approx(v, abs=1e-7)), k
    part = WP.warp(cells, DEGREES, TARGETS[to], method=method, window=(3, 2, 9, 7)).collect()
    assert {(r["z"], r["x"]): r["v"] for r in part} == {k: v for k, v in got.items() if 3 <= k[0] < 9 and 2 <= k[1] < 7}


def test_target_outside_and_types(spark):
    cells = raster(spark, np.ones((40, 24))).select("z", "x", F.col("v").cast("int").alias("v"))
    away = Grid(0.5, 0.0, 100.0, 0.0, -0.5, 0.0, 5, 4, "EPSG:4326")
    out = WP.warp(cells, DEGREES, away, method="nearest")
    assert out.schema["v"].dataType.simpleString() == "int" and [r["v"] for r in out.collect()] == [None] * 20


def test_fields_are_sampled_together(spark):
    from terraspark.operators import resample as R

    rng = np.random.default_rng(6)
    rows = [(z, x, None if rng.random() < 0.3 else float(rng.integers(0, 50)), None if rng.random() < 0.3 else float(rng.integers(0, 50))) for z in range(6) for x in range(7)]
    cells = spark.createDataFrame(rows, "z int, x int, a double, b double")
    points = spark.createDataFrame([(i, float(rng.uniform(-1, 7)), float(rng.uniform(-1, 8))) for i in range(60)] + [(99, 2.0, 3.0)], "pid int, fz double, fx double")
    value = {(z, x): (a, b) for z, x, a, b in rows}
    for clamp in (True, False):
        got = {r["pid"]: (r["p"], r["q"]) for r in R.sample_fields(points, cells, {"a": "p", "b": "q"}, 6, 7, clamp).collect()}
        for r in points.collect():
            for k in (0, 1):
                s = n = 0.0
                z0, x0 = math.floor(r["fz"]), math.floor(r["fx"])
                for dz in (0, 1):
                    for dx in (0, 1):
                        w = (r["fz"] - z0 if dz else 1 - r["fz"] + z0) * (r["fx"] - x0 if dx else 1 - r["fx"] + x0)
                        z, x = z0 + dz, x0 + dx
                        if clamp:
                            z, x = min(max(z, 0), 5), min(max(x, 0), 6)
                        v = value.get((z, x), (None, None))[k]
                        if v is not None:
                            s, n = s + w * v, n + w
                assert got[r["pid"]][k] == (pytest.approx(s / n) if n > 0 else None)
