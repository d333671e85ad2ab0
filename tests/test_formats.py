import sqlite3
import struct
import zlib

import numpy as np
import pytest

from terraspark.sources import formats as X


def test_tiff_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    for a in (rng.integers(0, 256, (70, 45)).astype(np.uint8), rng.integers(-9000, 9000, (33, 80)).astype(np.int16)):
        path = str(tmp_path / "a.tif")
        X.write_tiff(path, a, 100.0, 900.0, 30.0, 32)
        assert X.tiff_transform(path) == (100.0, 900.0, 30.0, 30.0)
        out = np.zeros(a.shape)
        for r in X.read_tiff(spark, path).collect():
            out[r["z"], r["x"]] = r["v"]
        assert (out == a).all()
    assert X.read_tiff(spark, path).filter("z < 32").count() == 32 * 80
    (tmp_path / "b.tif").write_bytes(b"no")
    with pytest.raises(ValueError):
        X.tiff_tags(str(tmp_path / "b.tif"))


def test_lzw():
    # clear, 'a', 'b', then codes of what was seen, end: packed by hand, 9 bits each
    codes = [256, 97, 98, 258, 260, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert X.lzw_decode(data) == b"ab" + b"ab" + b"aba"


def test_png(tmp_path):
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    X.write_png(str(tmp_path / "a.png"), a)
    data = (tmp_path / "a.png").read_bytes()
    at = data.index(b"IDAT")
    n = struct.unpack(">I", data[at - 4 : at])[0]
    raw = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + n]), np.uint8).reshape(3, 5)
    assert (raw[:, 1:] == a).all()


def test_shapefile(spark, tmp_path):
    lines = [[(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)], [(50.0, 50.0), (51.0, 52.0)]]
    body = b""
    for k, pts in enumerate(lines):
        xs, ys = zip(*pts)
        rec = struct.pack("<i4dii", 3, min(xs), min(ys), max(xs), max(ys), 1, len(pts)) + struct.pack("<i", 0) + b"".join(struct.pack("<dd", *p) for p in pts)
        body += struct.pack(">II", k + 1, len(rec) // 2) + rec
    (tmp_path / "r.shp").write_bytes(struct.pack(">7I", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<II8d", 1000, 3, *[0.0] * 8) + body)
    field = b"FLOW".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([6, 1]) + b"\0" * 14
    (tmp_path / "r.dbf").write_bytes(struct.pack("<4BIHH", 3, 126, 1, 1, 2, 32 + 32 + 1, 7).ljust(32, b"\0") + field + b"\r" + b"    1.5" + b"       ")
    rows = X.read_features(spark, str(tmp_path / "r.shp")).orderBy("fid").collect()
    assert [(p["x"], p["y"]) for p in rows[0]["rings"][0]] == lines[0] and rows[0]["properties"] == {"FLOW": "1.5"} and rows[1]["properties"] == {"FLOW": None}
    assert [r["fid"] for r in X.read_features(spark, str(tmp_path / "r.shp"), (40.0, 40.0, 60.0, 60.0)).collect()] == [2]


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "l.gpkg")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT)")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_contents VALUES ('lakes', 'features')")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('lakes', 'geom')")
    db.execute("CREATE TABLE lakes (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT)")
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    poly = struct.pack("<BIII", 1, 3, 1, 4) + b"".join(struct.pack("<dd", *p) for p in ring)
    multi = struct.pack("<BII", 1, 6, 2) + poly + poly
    db.execute("INSERT INTO lakes VALUES (7, ?, 'Long')", (b"GP\0\1" + struct.pack("<i", 4326) + multi,))
    db.commit()
    db.close()
    rows = X.read_features(spark, path).collect()
    assert len(rows) == 2 and [(p["x"], p["y"]) for p in rows[0]["rings"][0]] == ring and rows[0]["fid"] == 7 and rows[0]["properties"]["name"] == "Long"


@pytest.mark.parametrize(("kind", "spark_type"), [("u1", "int"), ("i2", "int"), ("f4", "double")])
def test_distributed_raster(spark, tmp_path, kind, spark_type):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 200, (70, 45)).astype(kind)
    a[32:64, 16:32] = 7  # a block of missing cells, and a few elsewhere
    rows = [(z, x, None if z % 9 == 4 else (float if spark_type == "double" else int)(a[z, x])) for z in range(70) for x in range(45) if not (32 <= z < 64 and 16 <= x < 32)]
    path = str(tmp_path / "big.tif")
    X.write_raster(spark.createDataFrame(rows, f"z int, x int, v {spark_type}"), path, 45, 70, kind=kind, nodata=7, left=100.0, upper=900.0, cell=2.0, block=16)
    want = a.copy()
    want[4::9] = 7
    got = np.full((70, 45), -1.0)
    for r in X.read_tiff(spark, path).collect():
        got[r["z"], r["x"]] = r["v"]
    assert np.array_equal(got, want.astype(float)) and X.tiff_transform(path) == (100.0, 900.0, 2.0, 2.0)
    assert open(path, "rb").read(4) == b"II\x2b\0" and [p.name for p in tmp_path.iterdir()] == ["big.tif"]


def test_geopackage_round_trip(spark, tmp_path):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)]
    hole = [(1.0, 0.2), (2.0, 0.2), (2.0, 0.5), (1.0, 0.2)]
    rows = [(1, [ring, hole], "Lake", 5), (2, [[(x + 10, y) for x, y in ring]], None, None)]
    df = spark.createDataFrame(rows, "id long, rings array<array<struct<x: double, y: double>>>, name string, class int")
    path = str(tmp_path / "lakes.gpkg")
    for _ in range(2):  # the second takes the place of the first
        X.write_features(df, path, "lakes")
    got = sorted(X.read_features(spark, path).collect(), key=lambda r: r["fid"])
    assert [[[(p["x"], p["y"]) for p in r] for r in g["rings"]] for g in got] == [r[1] for r in rows]
    assert {k: v for k, v in got[0]["properties"].items() if k != "fid"} == {"name": "Lake", "class": "5"} and [p.name for p in tmp_path.iterdir()] == ["lakes.gpkg"]
    assert X.read_features(spark, path, (9.0, 0.0, 20.0, 5.0)).count() == 1


def strips(path, a, planar, predictor, rows=5):
    """A deflated TIFF in strips of ``a`` (bands, rows, columns), bands side by side (1) or one after the other (2)."""
    n, h, w = a.shape
    blocks = []
    for plane in [a] if planar == 1 else [a[k : k + 1] for k in range(n)]:
        for z in range(0, h, rows):
            part = np.moveaxis(plane[:, z : z + rows], 0, 2).copy()
            if predictor == 2:
                part[:, 1:] -= part[:, :-1].copy()
            blocks.append(zlib.compress(part.astype(a.dtype.newbyteorder("<")).tobytes()))
    at, places = 8, []
    for b in blocks:
        places.append(at)
        at += len(b)
    entries = [(256, 4, [w]), (257, 4, [h]), (258, 3, [a.dtype.itemsize * 8] * n), (259, 3, [8]), (273, 4, places), (277, 3, [n]), (278, 4, [rows]), (279, 4, [len(b) for b in blocks]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [2] * n)]
    extra_at, head, extra = at + 2 + 12 * len(entries) + 4, b"", b""
    for tag, kind, v in entries:
        raw = struct.pack(f"<{len(v)}{'H' if kind == 3 else 'I'}", *v)
        head += struct.pack("<HHI", tag, kind, len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", extra_at + len(extra)))
        extra += raw if len(raw) > 4 else b""
    path.write_bytes(struct.pack("<2sHI", b"II", 42, at) + b"".join(blocks) + struct.pack("<H", len(entries)) + head + bytes(4) + extra)


@pytest.mark.parametrize("planar", [1, 2])
@pytest.mark.parametrize("predictor", [1, 2])
def test_bands_and_windows(spark, tmp_path, planar, predictor):
    a = np.random.default_rng(2).integers(-900, 900, (3, 23, 17)).astype(np.int16)
    strips(tmp_path / "a.tif", a, planar, predictor)
    path = str(tmp_path / "a.tif")
    for band in (1, 3):
        assert {(r["z"], r["x"]): r["v"] for r in X.read_tiff(spark, path, band).collect()} == dict(np.ndenumerate(a[band - 1]))
    part = X.read_tiff(spark, path, 2, (6, 3, 12, 9))
    assert part.rdd.getNumPartitions() == 2 and {(r["z"], r["x"]): r["v"] for r in part.collect()} == {k: v for k, v in np.ndenumerate(a[1]) if 6 <= k[0] < 12 and 3 <= k[1] < 9}
    assert X.read_tiff(spark, path, 1, (40, 0, 50, 9)).collect() == []
    with pytest.raises(Exception, match="band 4"):
        X.read_tiff(spark, path, 4).collect()


def test_window_of_tiles(spark, tmp_path):
    a = np.random.default_rng(3).integers(0, 256, (70, 45)).astype(np.uint8)
    X.write_tiff(str(tmp_path / "a.tif"), a, block=16)
    part = X.read_tiff(spark, str(tmp_path / "a.tif"), window=(20, 10, 34, 40))
    assert part.rdd.getNumPartitions() == 2 and {(r["z"], r["x"]): r["v"] for r in part.collect()} == {k: v for k, v in np.ndenumerate(a) if 20 <= k[0] < 34 and 10 <= k[1] < 40}
