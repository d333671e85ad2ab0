"""Operators against small literals, dense NumPy results and invariants."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspark.functions import scalars as S
from terraspark.grid import Grid, choose_crs, master_grid, mercator_bounds, project
from terraspark.operators import aggregates as A
from terraspark.operators import distance as D
from terraspark.operators import graph as G
from terraspark.operators import maps as M
from terraspark.operators import resample as R
from terraspark.operators import stencil as T
from terraspark.operators import vector as V
from terraspark.sources import binary_maps as B
from terraspark.sources import tiles as TL


def cells(spark, a, name="v"):
    return spark.createDataFrame([(int(z), int(x), int(a[z, x])) for z in range(a.shape[0]) for x in range(a.shape[1])], f"z int, x int, {name} int")


def dense(df, name, shape, kind=int):
    out = np.zeros(shape, kind)
    for r in df.select("z", "x", name).collect():
        out[r["z"], r["x"]] = r[name]
    return out


def values(spark, rows, fn):
    df = spark.createDataFrame([(v,) for v in rows], "e int")
    return [r[0] for r in df.select(fn(F.col("e"))).collect()]


def test_terrain_goldens(spark):
    enc = lambda peak, sea: (lambda e: S.terrain_byte(e, F.lit(peak), sea))
    assert values(spark, [-430, 0, 1580, 3000, 4500, -32768], enc(4500, 92)) == [76, 92, 149, 201, 255, 0]
    assert values(spark, [0, 1000, 2000], enc(2000, 70)) == [70, 162, 255]
    with pytest.raises(ValueError):
        S.bathymetry(F.col("e"), F.lit(-5), sea=40, low=50)


def test_width_and_hash(spark):
    w = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (8.0,), (1e6,)], "q double").select(S.river_width(F.col("q"), 1.0)).collect()
    assert [r[0] for r in w] == [3.0, 3.0, 3.0, 4.0, 5.4]
    x, z = np.meshgrid(np.arange(40, dtype=np.uint32), np.arange(30, dtype=np.uint32))
    with np.errstate(over="ignore"):
        n = (x * np.uint32(0x9E3779B1)) ^ (z * np.uint32(0x85EBCA77))
        n ^= n >> np.uint32(16)
        n *= np.uint32(0x7FEB352D)
        n ^= n >> np.uint32(15)
        n *= np.uint32(0x846CA68B)
        n ^= n >> np.uint32(16)
    got = cells(spark, np.zeros((30, 40))).select("z", "x", S.cell_hash(F.col("x"), F.col("z")).alias("h"))
    assert (dense(got, "h", (30, 40)) == n).all()


def test_grids(spark):
    assert choose_crs(10, 12, 40, 41) == "EPSG:32632" and choose_crs(0, 30, 0, 9) == "EPSG:3857" and choose_crs(10, 12, -9, -8) == "EPSG:32732"
    g = master_grid(spark, 5.0, 40.0, 25.0, 50.0, 1000.0, "EPSG:3857")
    lo = mercator_bounds(spark, g)
    assert lo[0] == pytest.approx(5.0) and lo[3] == pytest.approx(50.0) and lo[1] <= 40.0 + 1e-9 and lo[2] >= 25.0 - 1e-9
    p = spark.createDataFrame([(9.0, 48.0), (12.0, 52.0)], "lon double, lat double")
    got = [tuple(r) for r in p.select(*project(F.col("lon"), F.col("lat"), "EPSG:32632")).collect()]
    assert got[0][0] == pytest.approx(500000, abs=1e-3) and got[0][1] == pytest.approx(5316300, abs=1500) and 700000 < got[1][0] < 710000
    with pytest.raises(ValueError):
        project(F.col("lon"), F.col("lat"), "EPSG:2154")
    assert Grid(1, 0, 0, 0, -1, 0, 100, 50, "EPSG:3857").scaled(200, 100).a == 0.5


@pytest.mark.parametrize("size", [3, 5])
def test_stencils_dense(spark, size):
    a = np.random.default_rng(size).integers(0, 255, (21, 17))
    h = size // 2
    c = cells(spark, a)
    edge = np.pad(a, h, mode="edge")
    win = np.lib.stride_tricks.sliding_window_view(edge, (size, size))
    assert (dense(T.min_filter(c, "v", "m", size), "m", a.shape) == win.min((2, 3))).all()
    assert (dense(T.max_filter(c, "v", "m", size), "m", a.shape) == win.max((2, 3))).all()
    assert np.allclose(dense(T.mean_filter(c, "v", "m", size), "m", a.shape, float), win.mean((2, 3)))
    if size == 3:
        assert (dense(T.median3(c, "v", "m"), "m", a.shape) == np.median(win, (2, 3))).all()


def test_distances_dense(spark):
    rng = np.random.default_rng(2)
    a = (rng.random((30, 24)) < 0.02).astype(int)
    c = cells(spark, a).withColumn("bg", F.col("v") == 1)
    zs, xs = np.nonzero(a)
    z, x = np.mgrid[: a.shape[0], : a.shape[1]]
    dz, dx = np.abs(z[..., None] - zs), np.abs(x[..., None] - xs)
    for taxi, d in ((False, np.maximum(dz, dx).min(-1)), (True, (dz + dx).min(-1))):
        got = T.capped_distance(c, "bg", 6, "d", taxi).select("z", "x", F.coalesce("d", F.lit(99)).alias("d"))
        assert (dense(got, "d", a.shape) == np.where(d <= 6, d, 99)).all()
    near = D.nearest_source(c, "bg").withColumn("d2", (F.col("z") - F.col("nz")) * (F.col("z") - F.col("nz")) + (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")))
    assert (dense(near, "d2", a.shape) == (dz * dz + dx * dx).min(-1)).all()
    assert D.nearest_source(c.withColumn("bg", F.lit(False)), "bg").filter("nz IS NOT NULL").count() == 0
    assert T.capped_distance(c.withColumn("bg", F.lit(False)), "bg", 6, "d").filter("d IS NOT NULL").count() == 0


def test_bilinear_constant_and_range(spark):
    a = np.full((13, 9), 77)
    assert set(r["v"] for r in R.resize_bilinear(cells(spark, a), "v", (13, 9), (31, 5)).collect()) == {77}
    b = np.random.default_rng(1).integers(0, 256, (12, 12))
    got = dense(R.resize_bilinear(cells(spark, b), "v", (12, 12), (12, 6)), "v", (12, 6))
    # halving: weights 1 3 3 1 over 8, cut at the border
    want = [[min(255, int(sum(w * v for w, v in zip(ws, row)) / sum(ws) + 0.5)) for ws, row in ((([0.25, 0.75, 0.75, 0.25][max(0, 1 - 2 * i) : 4 - max(0, 2 * i + 3 - 12)]), r[max(0, 2 * i - 1) : 2 * i + 3]) for i in range(6))] for r in b]
    assert np.abs(got - np.array(want)).max() <= 1


def test_vectors(spark):
    poly = spark.createDataFrame([(1, [[(2.0, 1.0), (9.0, 1.0), (9.0, 6.0), (2.0, 6.0), (2.0, 1.0)], [(4.0, 2.0), (6.0, 2.0), (6.0, 4.0), (4.0, 4.0), (4.0, 2.0)]])], f"id long, rings array<{V.POINTS}>")
    got = {(r["z"], r["x"]) for r in V.fill_polygons(poly, 20, 20).collect()}
    assert got == {(z, x) for z in range(1, 6) for x in range(2, 9)} - {(z, x) for z in (2, 3) for x in (4, 5)}
    assert V.clip_polygons(poly, 0.0, 0.0, 4.0, 20.0).select(F.explode("rings")).count() == 1
    assert V.buffer_polygons(poly, 1.0, 20, 20).count() > len(got)
    line = spark.createDataFrame([(1, [(0.5, 0.5), (8.5, 0.5), (8.5, 8.5)])], f"id long, pts {V.POINTS}")
    assert {(r["z"], r["x"]) for r in V.touch_lines(line, 20, 20).collect()} == {(0, x) for x in range(9)} | {(z, 8) for z in range(9)}
    tr = V.trace(line, 20, 20).orderBy("ord").collect()
    assert (tr[0]["z"], tr[0]["x"]) == (0, 0) and (tr[-1]["z"], tr[-1]["x"]) == (8, 8) and len(tr) >= 17
    part = V.clip_lines(line, 2.0, 0.0, 5.0, 3.0).collect()
    assert len(part) == 1 and [(p["x"], p["y"]) for p in part[0]["pts"]] == [(2.0, 0.5), (5.0, 0.5)]
    buf = V.buffer_lines(line.withColumn("half", F.lit(1.0)), "half", 20, 20).collect()
    assert {(r["z"], r["x"]) for r in buf if r["x"] == 4} == {(0, 4), (1, 4)}
    bent = spark.createDataFrame([(1, [(0.0, 0.0), (5.0, 0.01), (10.0, 0.0), (10.0, 5.0)])], f"id long, pts {V.POINTS}")
    assert len(V.simplify(bent, 0.5).first()["pts"]) == 3
    assert line.select(V.length(F.col("pts"))).first()[0] == 16.0


def test_downstream_goldens(spark):
    ways = spark.createDataFrame([(0, k, c) for k, c in enumerate([0, 1, 2, 1, 3])] + [(1, k, c) for k, c in enumerate([4, 2, 5])], "way long, ord int, cell long")
    lv = spark.createDataFrame(list(enumerate([100, 80, 90, 60, 110, 70])), "id long, level int")
    out, moved = G.lower_downstream(spark, lv, ways)
    assert [r["level"] for r in out.orderBy("id").collect()] == [100, 80, 80, 60, 110, 70] and moved
    ways = spark.createDataFrame([(0, k, c) for k, c in enumerate([3, 4, 5, 6])] + [(1, k, c) for k, c in enumerate([0, 1, 2, 3])], "way long, ord int, cell long")
    lv = spark.createDataFrame(list(enumerate([130, 129, 130, 129, 128, 130, 127])), "id long, level int")
    assert [r["level"] for r in G.lower_downstream(spark, lv, ways)[0].orderBy("id").collect()] == [130, 129, 129, 129, 128, 128, 127]


def test_settle_keeps_its_order(spark):
    c = spark.createDataFrame([(0, 0, 0, 10), (1, 0, 1, 10), (2, 0, 2, 5)], "id long, z int, x int, level int")
    sections = spark.createDataFrame([(0, 100), (1, 100), (2, 101)], "id long, center long")
    ways = spark.createDataFrame([], "way long, ord int, cell long")
    assert [r["level"] for r in G.settle(spark, c, sections, ways).orderBy("id").collect()] == [7, 6, 5]


def test_relaxation_and_paths(spark):
    rng = np.random.default_rng(7)
    mask = rng.random((9, 11)) > 0.25
    level = rng.integers(1, 60, mask.shape)
    ids = [(int(z * 11 + x), int(z), int(x), int(level[z, x])) for z, x in zip(*np.nonzero(mask))]
    c = spark.createDataFrame(ids, "id long, z int, x int, level int")
    want = np.where(mask, level, 10**6)
    while True:
        p = np.pad(want, 1, constant_values=10**6)
        low = np.min([p[1 + a : 10 + a, 1 + b : 12 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)], 0) + 1
        new = np.where(mask, np.minimum(want, low), want)
        if (new == want).all():
            break
        want = new
    got = {r["id"]: r["level"] for r in G.level_surface(spark, c).collect()}
    assert got == {i: int(want[z, x]) for i, z, x, _ in ids}
    edges = G.neighbour_edges(c)
    comp = G.components(spark, edges, c)
    nodes = c.join(comp, "id").withColumn("sample", F.col("level").cast("double"))
    marks = nodes.withColumn("lake", F.lit(False)).withColumn("coast", F.lit(False)).withColumn("edge", F.col("z") == 0)
    seeds = G.choose_outlets(marks)
    assert seeds.count() == comp.select("component").distinct().count()
    fit = {r["id"]: r for r in G.fit_paths(spark, nodes, edges, seeds).collect()}
    for r in fit.values():
        if r["parent"] >= 0:
            assert fit[r["parent"]]["level"] - 1 <= r["level"] <= fit[r["parent"]]["level"] + 1
    both = edges.select("src", "dst")
    assert G.scc(spark, both).join(comp, "id").filter("scc <> component").count() == 0


def test_lakes_and_coast(spark):
    a = np.full((20, 20), 190)
    a[6:14, 6:14] = 80
    a[7, 7] = 140
    land = cells(spark, a, "height").withColumn("land", F.lit(255))
    lake = cells(spark, (a < 190).astype(int)).filter("v = 1").select("z", "x", F.lit(1).alias("lake"), F.lit(False).alias("saline"))
    out = M.lake_maps(land, lake)
    h, d = dense(out, "height", a.shape), dense(out, "lake_depth", a.shape)
    assert set(h[6:14, 6:14].ravel()) == {80} and h[5, 9] == 80 and h[0, 9] == 190 and h[4, 9] == 82
    assert d[6, 6] == 1 and d[9, 9] == 4 and d[0, 0] == 0
    n = M.natural_lakes(
        spark.createDataFrame([(1, "Lake", None, None), (2, "Lake", "R", None), (3, "Reservoir", None, None), (4, "Lake", None, "Q1")], "fid int, featurecla string, name string, wikidataid string"),
        spark.createDataFrame([("Q1",)], "wikidataid string"),
        spark.createDataFrame([("R",)], "name string"),
    )
    assert [r["fid"] for r in n.collect()] == [1]
    with pytest.raises(ValueError):
        M.check_classes(land, "land", [1])
    assert A.lower_median(spark.createDataFrame([(1, v) for v in (5, 1, 3, 9)], "g int, v int"), ["g"], "v", "m").first()["m"] == 3


def test_tiles_and_region_store(spark, tmp_path):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (40, 33))
    c = cells(spark, a)
    back = TL.to_cells(TL.to_tiles(c, ["v"], 16), ["v"], 16).filter("z < 40 AND x < 33")
    assert (dense(back, "v", a.shape) == a).all()
    assert TL.windows(spark, 33, 40, 16).count() == 9 and TL.filled(spark, 5, 4, 7, 4).agg(F.sum("v")).first()[0] == 140
    planes = {p: rng.integers(0, 256, (2, B.PLANE_BYTES)).astype(np.uint8) for p in B.PLANES}
    rows = [(rz, 0, *(planes[p][rz].tobytes() for p in B.PLANES)) for rz in range(2)]
    tiles = spark.createDataFrame(rows, "rz int, rx int, " + ", ".join(f"{p} binary" for p in B.PLANES))
    path = str(tmp_path / "map.regions")
    B.write_regions(tiles, path, 512, 1024)
    assert B.region_header(path) == (512, 1024, 60)
    got = B.region(spark, path, 0, 1).collect()
    assert len(got) == 1 and all(bytes(got[0][p]) == planes[p][1].tobytes() for p in B.PLANES)
    assert B.region(spark, path, 5, 5).count() == 0 and B.read_regions(spark, path).count() == 2
    raw = spark.createDataFrame([(0, 9, 9), (0, 0, 0), (255, 0, 7), (255, 200, 7), (0, 9, 80), (0, 9, 0)], "landmask int, heightmap int, bathymetry_heightmap int")
    assert [(r["heightmap"], r["bathymetry_heightmap"]) for r in B.baked(raw).collect()] == [(0, 50), (0, 60), (1, 60), (200, 60), (0, 60), (0, 60)]
    for width, sea in ((500, 60), (0, 60), (512, 255), (512, 1)):
        with pytest.raises(ValueError):
            B.write_regions(tiles, path, width, 1024, sea)
    with pytest.raises(ValueError):
        B.write_regions(tiles.limit(1), str(tmp_path / "half.regions"), 512, 1024)
    assert [p.name for p in tmp_path.iterdir()] == ["map.regions"]
    (tmp_path / "bad").write_bytes(b"EMREGION")
    with pytest.raises(ValueError):
        B.region_header(str(tmp_path / "bad"))


def test_climate_grid(spark, tmp_path):
    w, h = 20, 17
    sw, sh = B.samples(w), B.samples(h)
    rows = [(z, x, [z * 10 + m - 5 for m in range(12)], 100 + x, 200, 600 + z) for z in range(sh) for x in range(sw)]
    df = spark.createDataFrame(rows, "sz int, sx int, temperature array<int>, precipitation int, pet int, terrain_y int")
    path = str(tmp_path / "c.bin")
    B.write_climate(df, path, w, h, -0.02)
    assert B.climate_header(path, w, h)[2] == pytest.approx(-0.02) and (tmp_path / "c.bin").stat().st_size == 24 + 30 * sw * sh
    assert sorted(map(tuple, (r.asDict().values() for r in B.read_climate(spark, path).withColumn("temperature", F.concat_ws(",", F.col("temperature").cast("array<string>"))).collect()))) == sorted((z, x, ",".join(map(str, t)), p, e, y) for z, x, t, p, e, y in rows)
    tile = B.climate_tile(B.read_climate(spark, path), 0, 0, w, h)
    assert tile.count() == 65 * 65 and tile.filter("tz = 64 AND tx = 64").first()["precipitation"] == 100 + sw - 1
    raw = bytearray((tmp_path / "c.bin").read_bytes())
    raw[20:24] = struct.pack("<f", 0.5)
    (tmp_path / "d.bin").write_bytes(raw)
    with pytest.raises(ValueError):
        B.climate_header(str(tmp_path / "d.bin"))


def test_streams(spark, tmp_path):
    from terraspark.streaming import tile_sync as Y

    rng = random.Random(4)
    rows = [(rng.randrange(5), rng.randrange(-1, 6), rng.random() < 0.3, i) for i in range(300)]
    schema = "player long, tile int, release boolean, event long"
    src = str(tmp_path / "in")
    df = spark.createDataFrame(rows, schema)
    df.filter("event < 150").coalesce(1).write.mode("append").parquet(src)
    df.filter("event >= 150").coalesce(1).write.mode("append").parquet(src)
    want = sorted(map(tuple, Y.admit_batch(df, 6).collect()))
    q = Y.admit_stream(spark.readStream.schema(schema).parquet(src), 6).writeStream.format("memory").queryName("adm").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("adm").collect())) == want
    tiles = spark.createDataFrame([(1, bytearray(random.Random(1).randbytes(5000))), (2, bytearray(b"a" * 100))], "tile int, payload binary")
    packets = Y.chunk(tiles, 700)
    assert packets.filter("tile = 1").count() > 5
    back = {r["tile"]: bytes(r["payload"]) for r in Y.reassemble(packets.unionAll(packets), 700).collect()}
    assert back == {r["tile"]: bytes(r["payload"]) for r in tiles.collect()}
    assert Y.reassemble(packets.filter("NOT (tile = 1 AND idx = 2)"), 700).count() == 1
    assert Y.solicited(packets, tiles.filter("tile = 2")).count() == 1


def test_simplify_makes_no_crossings(spark):
    rng = np.random.default_rng(2)
    mended = 0
    for _ in range(3000):
        p = np.cumsum(rng.normal(size=(9, 2)), 0)
        if V.crosses_itself(p):
            continue
        s = V.simplified(p, 0.8)
        mended += V.crosses_itself(p[V.douglas_peucker(p, 0.8)])
        assert (s[0] == p[0]).all() and (s[-1] == p[-1]).all() and not V.crosses_itself(s)
        # every point lies within the tolerance of the line that is left
        a, d = s[:-1], np.diff(s, axis=0)
        t = np.clip(((p[:, None] - a) * d).sum(2) / (d * d).sum(1), 0, 1)
        assert np.sqrt((((p[:, None] - a) - t[..., None] * d) ** 2).sum(2).min(1)).max() <= 0.8 + 1e-9
    assert mended > 0
    assert V.crosses_itself(np.array([(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)])) and not V.crosses_itself(np.array([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]))
    df = spark.createDataFrame([(1, None), (2, []), (3, [(0.0, 0.0)]), (4, [(0.0, 0.0), (1.0, 0.1), (2.0, 0.0)])], f"id long, pts {V.POINTS}")
    assert [None if r["pts"] is None else len(r["pts"]) for r in V.simplify(df, 0.5).orderBy("id").collect()] == [None, 0, 1, 2]
