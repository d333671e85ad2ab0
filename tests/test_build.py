import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspark.grid import Grid
from terraspark.operators import vector as V
from terraspark.plans import build as B


def raster(spark, a, name="v"):
    return spark.createDataFrame([(z, x, float(a[z, x])) for z in range(a.shape[0]) for x in range(a.shape[1])], f"z int, x int, {name} double")


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic"])
def test_warp_of_a_plane(spark, method):
    src = Grid(10.0, 0.0, 0.0, 0.0, -10.0, 200.0, 20, 20, "EPSG:3857")
    z, x = np.mgrid[:20, :20]
    out = B.warp(raster(spark, 3.0 * x + 2.0 * z), src, src.scaled(10, 10), method=method).filter("z BETWEEN 2 AND 7 AND x BETWEEN 2 AND 7").collect()
    assert len(out) == 36
    for r in out:
        want = 3.0 * (2 * r["x"] + 0.5) + 2.0 * (2 * r["z"] + 0.5)
        assert r["v"] == pytest.approx(want, abs=3.0 if method == "nearest" else 1e-6)


def test_climate_records(spark):
    rows = [(v, m, sz, sx, raw, sc, off) for v, raw, sc, off in (("tas", 2831, 0.1, 0.0), ("pr", 500, 0.1, 0.0), ("pet", 900, 0.01, 0.0)) for m in range(1, 13) for sz in range(4) for sx in range(5) if (sz, sx) != (1, 1)]
    monthly = spark.createDataFrame(rows, "variable string, month int, sz int, sx int, raw int, scale double, offset double")
    ground = raster(spark, np.full((32, 40), 61.5), "y")
    out, lapse = B.climate_records(monthly, ground, 40, 32, 3)
    got = out.collect()
    assert len(got) == 20 and lapse == 0.0
    assert all(r["temperature"] == [100] * 12 and r["precipitation"] == 600 and r["pet"] == 108 and r["terrain_y"] == 615 for r in got)


def test_connectors(spark):
    a = np.full((12, 12), 58.0)
    a[5, 6] = 90
    c = raster(spark, a, "height").withColumn("land", F.when(F.col("x") >= 9, 0).otherwise(255)).withColumn("lake", F.lit(False))
    o = spark.createDataFrame([(1, 2, 5), (2, 5, 4), (3, 8, 8)], "id long, z int, x int")
    assert [r["id"] for r in B.coastal_connectors(c, o, 6).collect()] == [1]


def test_river_surface(spark):
    a = np.linspace(120, 80, 30)
    rows = [(10 + dz, x, float(a[x] + (5 if x == 12 else 0)), 255, 0, x == 29, x in (0, 29)) for x in range(30) for dz in (-1, 0, 1)]
    cells = spark.createDataFrame(rows, "z int, x int, sample double, ceiling int, lake_level int, coast boolean, edge boolean")
    line = spark.createDataFrame([(1, [(0.5, 10.5), (29.5, 10.5)])], f"id long, pts {V.POINTS}")
    out = {(r["z"], r["x"]): r["level"] for r in B.fitted_surface(spark, cells, line, 30, 20).collect()}
    mid = [out[(10, x)] for x in range(30)]
    assert len(out) == 90 and all(p >= q >= p - 1 for p, q in zip(mid, mid[1:])) and mid[-1] == 80
    assert all(out[(9, x)] == out[(10, x)] == out[(11, x)] for x in range(30))
    d = B.river_depth(cells.select("z", "x").withColumn("river", F.lit(True)).unionByName(spark.createDataFrame([(z, x, False) for x in range(30) for z in (8, 12)], "z int, x int, river boolean"))).collect()
    assert {r["depth"] for r in d if r["z"] == 10} == {2} and {r["depth"] for r in d if r["z"] == 9} == {1}
