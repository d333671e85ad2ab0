"""Files before a scan: found, fetched, unpacked, checked; classic NetCDF; settings and releases."""

import json
import os
import struct
import zipfile

import numpy as np
import pytest

from terraspark.sources import formats, ingest


def test_find_and_fetch(tmp_path):
    (tmp_path / "b" / "c").mkdir(parents=True)
    for n in ("b/c/x.shp", "b/a.shp", "b/z.txt"):
        (tmp_path / n).write_text(n)
    assert ingest.first_match(str(tmp_path), "*.shp") == str(tmp_path / "b" / "a.shp") and ingest.first_match(str(tmp_path), "*.tif") is None
    assert ingest.first_existing(str(tmp_path / "no"), str(tmp_path / "b")) == str(tmp_path / "b")
    with pytest.raises(FileNotFoundError):
        ingest.first_existing(str(tmp_path / "no"))
    target = str(tmp_path / "in" / "copy.txt")
    assert ingest.fetch((tmp_path / "b" / "z.txt").as_uri(), target) == target and open(target).read() == "b/z.txt"
    (tmp_path / "b" / "z.txt").write_text("other")
    assert open(ingest.fetch((tmp_path / "b" / "z.txt").as_uri(), target)).read() == "b/z.txt"  # cached

    def never(path):
        raise ValueError("bad")

    with pytest.raises(ValueError):
        ingest.fetch((tmp_path / "b" / "z.txt").as_uri(), str(tmp_path / "in" / "bad.txt"), never)
    assert os.listdir(tmp_path / "in") == ["copy.txt"]


def test_archives(tmp_path):
    a = str(tmp_path / "a.zip")
    with zipfile.ZipFile(a, "w") as z:
        z.writestr("land-1/land.shp", "s")
        z.writestr("land-1/sub/land.dbf", "d")
    ingest.holds("land.shp")(a)
    with pytest.raises(ValueError):
        ingest.holds("sea.shp")(a)
    out = ingest.unpack(a, str(tmp_path / "out"), "land.shp")
    assert sorted(os.listdir(out)) == ["land.shp", "sub"] and ingest.unpack(str(tmp_path / "gone.zip"), out, "land.shp") == out
    with pytest.raises(ValueError):
        ingest.unpack(a, str(tmp_path / "out2"), "sea.shp")
    with zipfile.ZipFile(str(tmp_path / "evil.zip"), "w") as z:
        z.writestr("../x", "s")
        z.writestr("y", "s")
    with pytest.raises(ValueError):
        ingest.unpack(str(tmp_path / "evil.zip"), str(tmp_path / "out3"), "y")
    assert not os.path.exists(tmp_path / "out2") and not os.path.exists(tmp_path / "x")


def test_unpack_leaves_what_a_folder_holds(tmp_path):
    a = str(tmp_path / "a.zip")
    with zipfile.ZipFile(a, "w") as z:
        z.writestr("d/land.shp", "new")
        z.writestr("d/sub/x", "new")
    folder = tmp_path / "mine"
    (folder / "sub").mkdir(parents=True)
    (folder / "own.txt").write_text("own")
    (folder / "sub" / "x").write_text("old")
    with pytest.raises(ValueError):
        ingest.unpack(a, str(folder), "sea.shp")
    assert sorted(os.listdir(folder)) == ["own.txt", "sub"] and (folder / "sub" / "x").read_text() == "old"
    ingest.unpack(a, str(folder), "land.shp")
    assert sorted(os.listdir(folder)) == ["land.shp", "own.txt", "sub"] and (folder / "own.txt").read_text() == "own" and (folder / "sub" / "x").read_text() == "new"
    assert sorted(os.listdir(tmp_path)) == ["a.zip", "mine"]


def test_release_is_the_same_bytes(tmp_path):
    for n in ("b.py", "a.py"):
        (tmp_path / n).write_text(n)
    one = ingest.release(str(tmp_path / "r1.zip"), str(tmp_path), ["b.py", "a.py"], "1.2.0-rc.1")
    os.utime(tmp_path / "a.py", (1, 1))
    two = ingest.release(str(tmp_path / "r2.zip"), str(tmp_path), ["a.py", "b.py"], "1.2.0-rc.1")
    assert open(one, "rb").read() == open(two, "rb").read() and zipfile.ZipFile(one).namelist() == ["a.py", "b.py"]
    with pytest.raises(ValueError):
        ingest.release(one, str(tmp_path), ["a.py"], "1")
    with pytest.raises(FileNotFoundError):
        ingest.release(one, str(tmp_path), ["c.py"], "1.0")


def test_settings_and_folder(tmp_path):
    path = str(tmp_path / "s.json")
    assert ingest.settings(path) == ingest.Settings() and json.load(open(path))["sea_level"] == 60
    open(path, "w").write('{"sea_level": 90, "other": 1}')
    assert ingest.settings(path).sea_level == 90 and json.load(open(path)) == {"sea_level": 90, "least_depth": 50, "snowpack_warmest": 5.0, "width": 25600, "height": 25600}
    open(path, "w").write("{broken")
    assert ingest.settings(path) == ingest.Settings() and open(path).read() == "{broken"
    usual, override = str(tmp_path / "maps"), str(tmp_path / "debug.txt")
    assert ingest.map_folder(usual, override) == usual and os.path.isdir(usual)
    open(override, "w").write(f" {tmp_path} \n")
    assert ingest.map_folder(usual, override) == str(tmp_path)
    open(override, "w").write("/no/such/folder")
    with pytest.raises(NotADirectoryError):
        ingest.map_folder(usual, override)


def netcdf(path, a, kind, extra):
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: struct.pack(">i", len(s)) + pad(s.encode())
    att = lambda k, v: name(k) + struct.pack(">ii", 6, 1) + struct.pack(">d", v) if isinstance(v, float) else name(k) + struct.pack(">ii", 3, 1) + pad(struct.pack(">h", v))
    head = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, 2) + name("lat") + struct.pack(">i", a.shape[0]) + name("lon") + struct.pack(">i", a.shape[1])
    head += struct.pack(">ii", 12, 1) + name("title") + struct.pack(">ii", 2, 5) + pad(b"hello")
    head += struct.pack(">ii", 11, 1) + name("elevation") + struct.pack(">iii", 2, 0, 1) + struct.pack(">ii", 12, len(extra)) + b"".join(att(k, v) for k, v in extra.items())
    data = a.astype(kind).tobytes()
    head += struct.pack(">ii", 3, len(pad(data)))
    open(path, "wb").write(head + struct.pack(">i", len(head) + 4) + pad(data))


def test_netcdf(spark, tmp_path):
    a = np.random.default_rng(1).integers(-500, 500, (7, 5))
    a[2, 3] = -999
    path = str(tmp_path / "g.nc")
    netcdf(path, a, ">i2", {"scale_factor": 0.5, "add_offset": 10.0, "_FillValue": -999})
    got = {(r["z"], r["x"]): r["v"] for r in ingest.read_netcdf(spark, f"NETCDF:{path}:elevation", 3).collect()}
    assert got == {(z, x): None if a[z, x] == -999 else a[z, x] * 0.5 + 10 for z in range(7) for x in range(5)}
    with pytest.raises(ValueError):
        ingest.netcdf_variable(path, "depth")
    open(path, "wb").write(b"\x89HDF\r\n")
    with pytest.raises(ValueError):
        ingest.netcdf_variable(path, "elevation")


def test_climatology(spark, tmp_path):
    for v in ("tas", "pr"):
        for m in (1, 2):
            formats.write_tiff(str(tmp_path / f"{v}_{m:02d}.tif"), np.full((3, 4), m * 10 + len(v), np.uint16))
    df = ingest.climatology(spark, str(tmp_path), {"tas": (0.1, 0.0), "pr": (0.5, 1.0)}, months=(1, 2))
    assert df.count() == 48 and {(r["variable"], r["month"], r["raw"]) for r in df.select("variable", "month", "raw").distinct().collect()} == {("tas", 1, 13.0), ("tas", 2, 23.0), ("pr", 1, 12.0), ("pr", 2, 22.0)}


def test_geographic(tmp_path):
    (tmp_path / "a.prj").write_text('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]')
    (tmp_path / "b.prj").write_text('PROJCS["WGS_1984_UTM",GEOGCS["GCS_WGS_1984"]]')
    assert ingest.is_geographic(str(tmp_path / "a.shp")) and not ingest.is_geographic(str(tmp_path / "b.shp")) and ingest.is_geographic(str(tmp_path / "c.shp"))
    (tmp_path / "b.shp").write_text("")
    with pytest.raises(ValueError):
        ingest.read_reaches(None, str(tmp_path / "no.shp"), str(tmp_path / "b.shp"))
