"""Public GIS formats as Python data sources: GeoTIFF bands, shapefiles, GeoPackages; GeoTIFF and PNG writers.

GeoTIFF: one band of 8 or 16 bit integers or 32 bit floats, strips or tiles, stored
plain, deflated or LZW, with or without the horizontal predictor; one input
partition per row of blocks, so a window is a filter on z. NetCDF-4 and Arc grids
need libraries that are not here: convert them to Parquet or GeoTIFF first.
"""

from __future__ import annotations

import os
import sqlite3
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terraspark.sources.window import Bounds, option

# TIFF tags and the sizes of its field types.
WIDTH, HEIGHT, DEPTH, COMPRESSION, STRIP_AT, ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 278, 279, 317
BANDS, PLANAR = 277, 284
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, SAMPLE_FORMAT, PIXEL_SCALE, TIE_POINT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
FIELD = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}


def tiff_tags(path: str) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of the first image; classic and big TIFF."""
    with open(path, "rb") as f:
        head = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None:
            raise ValueError("not a TIFF")
        big = struct.unpack(order + "H", head[2:4])[0] == 43
        at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        f.seek(at)
        n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        raw = f.read(n * (20 if big else 12))
        tags = {}
        for i in range(n):
            e = raw[i * (20 if big else 12) : (i + 1) * (20 if big else 12)]
            tag, kind = struct.unpack(order + "HH", e[:4])
            count = struct.unpack(order + ("Q" if big else "I"), e[4 : 12 if big else 8])[0]
            if kind not in FIELD:
                continue
            code, size = FIELD[kind]
            value = e[12:] if big else e[8:]
            if count * size > len(value):
                f.seek(struct.unpack(order + ("Q" if big else "I"), value)[0])
                value = f.read(count * size)
            tags[tag] = (value[:count],) if code == "s" else struct.unpack(order + code * count, value[: count * size])
    return order, tags


def lzw_decode(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, codes grow one early."""
    out, table, width, bits, have = bytearray(), [], 9, 0, 0
    last = None
    for byte in data:
        bits, have = (bits << 8 | byte) & 0xFFFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last is not None:
            table.append(last + entry[:1])
        last = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


class _Rows(InputPartition):
    def __init__(self, k: int):
        self.k = k


class TiffReader(DataSourceReader):
    def __init__(self, path: str, band: int = 1, window: str | None = None):
        self.path, self.band = path, band
        self.order, t = tiff_tags(path)
        self.width, self.height = t[WIDTH][0], t[HEIGHT][0]
        self.tiled = TILE_AT in t
        self.bw = t[TILE_WIDTH][0] if self.tiled else self.width
        self.bh = t[TILE_HEIGHT][0] if self.tiled else min(t.get(ROWS_PER_STRIP, (self.height,))[0], self.height)
        self.at, self.sizes = (t[TILE_AT], t[TILE_BYTES]) if self.tiled else (t[STRIP_AT], t[STRIP_BYTES])
        self.compression, self.predictor = t.get(COMPRESSION, (1,))[0], t.get(PREDICTOR, (1,))[0]
        kind = {1: "u", 2: "i", 3: "f"}[t.get(SAMPLE_FORMAT, (1,))[0]]
        self.dtype = f"{self.order}{kind}{t[DEPTH][0] // 8}"
        if self.compression not in (1, 5, 8, 32946) or self.predictor not in (1, 2):
            raise ValueError("unsupported TIFF compression or predictor")
        self.bands, self.apart = t.get(BANDS, (1,))[0], t.get(PLANAR, (1,))[0] == 2
        if not 1 <= band <= self.bands:
            raise ValueError(f"{path} has {self.bands} bands, no band {band}")
        self.bounds = Bounds(self.height, self.width, window)
        self.across, self.down = -(-self.width // self.bw), -(-self.height // self.bh)

    def partitions(self):
        rows = [_Rows(k) for k in range(self.down) if self.bounds.meets(z=(k * self.bh, (k + 1) * self.bh))]
        return rows if rows and self.bounds.meets(x=(0, self.width)) else [_Rows(-1)]

    def block(self, f, k: int) -> np.ndarray:
        # bands lie one after the other, or side by side in each cell
        k += (self.band - 1) * self.across * self.down if self.apart else 0
        side = 1 if self.apart else self.bands
        f.seek(self.at[k])
        data = f.read(self.sizes[k])
        data = data if self.compression == 1 else lzw_decode(data) if self.compression == 5 else zlib.decompress(data)
        a = np.frombuffer(data, self.dtype)
        a = a[: len(a) // (self.bw * side) * self.bw * side].reshape(-1, self.bw, side)[:, :, 0 if self.apart else self.band - 1]
        return np.cumsum(a, axis=1, dtype=a.dtype.newbyteorder("=")) if self.predictor == 2 else a

    def read(self, p):
        if p.k < 0:
            return
        (za, zb), (xa, xb) = self.bounds.z, self.bounds.x
        with open(self.path, "rb") as f:
            for j in range(self.across):
                z0, x0 = p.k * self.bh, j * self.bw
                if not self.bounds.meets(x=(x0, x0 + self.bw)):
                    continue
                top, left = max(za - z0, 0), max(xa - x0, 0)
                a = self.block(f, p.k * self.across + j)[top : zb - z0, left : xb - x0]
                z, x = np.divmod(np.arange(a.size, dtype=np.int32), np.int32(max(1, a.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(z + np.int32(z0 + top)), pa.array(x + np.int32(x0 + left)), pa.array(a.astype(np.float64).ravel())], names=["z", "x", "v"])


class TiffSource(DataSource):
    @classmethod
    def name(cls):
        return "geotiff_band"

    def schema(self):
        return "z int, x int, v double"

    def reader(self, schema):
        return TiffReader(self.options["path"], int(self.options.get("band", "1")), self.options.get("window"))


def read_tiff(spark: SparkSession, path: str, band: int = 1, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(z, x, v) of a band, all of it or its cells in ``window`` (z0, x0, z1, x1): blocks outside are not read, and rows of blocks outside are no partitions."""
    spark.dataSource.register(TiffSource)
    return spark.read.format("geotiff_band").option("path", path).option("band", band).options(**option(window)).load()


def tiff_transform(path: str) -> tuple[float, float, float, float] | None:
    """(x of the left edge, y of the upper edge, width and height of a cell), if the file says so."""
    _, t = tiff_tags(path)
    if PIXEL_SCALE not in t or TIE_POINT not in t:
        return None
    sx, sy, _ = t[PIXEL_SCALE]
    i, j, _, x, y, _ = t[TIE_POINT]
    return x - i * sx, y + j * sy, sx, sy


def write_tiff(path: str, a: np.ndarray, left: float = 0.0, upper: float = 0.0, cell: float = 1.0, block: int = 512) -> None:
    """A band of one map or window as a tiled, deflated GeoTIFF with the horizontal predictor; published by one rename."""
    h, w = a.shape
    blocks = []
    for z in range(0, h, block):
        for x in range(0, w, block):
            t = np.zeros((block, block), a.dtype)
            part = a[z : z + block, x : x + block]
            t[: part.shape[0], : part.shape[1]] = part
            d = t.copy()
            d[:, 1:] -= t[:, :-1]
            blocks.append(zlib.compress(d.astype(a.dtype.newbyteorder("<")).tobytes(), 6))
    form = {"u": 1, "i": 2}[a.dtype.kind]
    entries = [
        (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (DEPTH, 3, [a.dtype.itemsize * 8]), (COMPRESSION, 3, [8]), (262, 3, [1]), (277, 3, [1]), (PREDICTOR, 3, [2]), (TILE_WIDTH, 3, [block]), (TILE_HEIGHT, 3, [block]),
        (TILE_AT, 4, None), (TILE_BYTES, 4, [len(b) for b in blocks]), (SAMPLE_FORMAT, 3, [form]), (PIXEL_SCALE, 12, [cell, cell, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, left, upper, 0.0]),
    ]
    start = 8 + 2 + 12 * len(entries) + 4
    extra_size = sum(FIELD[k][1] * n for _, k, v in entries if (n := len(v) if v else len(blocks)) * FIELD[k][1] > 4)
    at, offsets = start + extra_size, []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    head, extra = bytearray(struct.pack("<2sHIH", b"II", 42, 8, len(entries))), bytearray()
    for tag, kind, v in entries:
        v = offsets if v is None else v
        data = struct.pack("<" + FIELD[kind][0] * len(v), *v)
        head += struct.pack("<HHI", tag, kind, len(v))
        if len(data) > 4:
            head += struct.pack("<I", start + len(extra))
            extra += data
        else:
            head += data.ljust(4, b"\0")
    tmp = path + ".tmp"
    try:
        with open(tmp, "wb") as f:
            f.write(bytes(head) + b"\0\0\0\0" + bytes(extra) + b"".join(blocks))
        os.replace(tmp, path)
    finally:
        if os.path.exists(tmp):
            os.remove(tmp)


def write_png(path: str, a: np.ndarray) -> None:
    """A grayscale preview."""
    h, w = a.shape
    raw = b"".join(b"\0" + row.tobytes() for row in a.astype(np.uint8))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def _wkb(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """Parts of a geometry, each a list of rings or one line; empty parts are left out."""

    def points(order: str, at: int) -> tuple[list[tuple[float, float]], int]:
        n = struct.unpack_from(order + "I", data, at)[0]
        v = struct.unpack_from(order + "d" * (2 * n), data, at + 4)
        return list(zip(v[::2], v[1::2], strict=True)), at + 4 + 16 * n

    def parts(at: int) -> tuple[list, int]:
        order = "<" if data[at] else ">"
        kind = struct.unpack_from(order + "I", data, at + 1)[0] % 1000
        at += 5
        if kind == 1:
            p = struct.unpack_from(order + "dd", data, at)
            return ([] if p[0] != p[0] else [[[p]]]), at + 16  # an empty point has no coordinates
        if kind == 2:
            line, at = points(order, at)
            return ([[line]] if line else []), at
        if kind not in (3, 4, 5, 6, 7):
            raise ValueError(f"geometry type {kind}")
        out: list = []
        n = struct.unpack_from(order + "I", data, at)[0]
        at += 4
        for _ in range(n):
            one, at = points(order, at) if kind == 3 else parts(at)
            out += [one] if kind == 3 and one else [] if kind == 3 else one
        return ([out] if out else []) if kind == 3 else out, at

    return parts(0)[0]


def _dbf(path: str):
    """(names, rows of text values)."""
    with open(path, "rb") as f:
        head = f.read(32)
        n, start, size = struct.unpack("<IHH", head[4:12])
        fields = []
        while (e := f.read(32))[:1] not in (b"\r", b""):
            fields.append((e[:11].split(b"\0")[0].decode("latin-1"), e[16]))
        f.seek(start)
        rows = f.read(n * size)
    for i in range(n):
        r, at, out = rows[i * size : (i + 1) * size], 1, []
        for _, w in fields:
            out.append(r[at : at + w].decode("utf-8", "replace").strip() or None)
            at += w
        yield dict(zip((k for k, _ in fields), out, strict=True))


FEATURES = "fid long, part int, rings array<array<struct<x:double,y:double>>>, x0 double, y0 double, x1 double, y1 double, properties map<string,string>"


def _feature(fid: int, part: int, rings, props):
    flat = [p for r in rings for p in r]
    xs, ys = [p[0] for p in flat], [p[1] for p in flat]
    return fid, part, [[(float(x), float(y)) for x, y in r] for r in rings], float(min(xs)), float(min(ys)), float(max(xs)), float(max(ys)), props


class FeatureReader(DataSourceReader):
    """bbox: 'x0,y0,x1,y1' leaves out features whose envelope lies outside, before their points are built."""

    def __init__(self, path: str, bbox: str | None, table: str | None):
        self.path, self.table = path, table
        self.bbox = [float(v) for v in bbox.split(",")] if bbox else None

    def partitions(self):
        return [_Rows(0)]

    def _outside(self, x0: float, y0: float, x1: float, y1: float) -> bool:
        b = self.bbox
        return b is not None and (x1 < b[0] or x0 > b[2] or y1 < b[1] or y0 > b[3])

    def read(self, p):
        yield from self._gpkg() if self.path.endswith(".gpkg") else self._shp()

    def _gpkg(self):
        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        table = self.table or db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features'").fetchone()[0]
        geom = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (table,)).fetchone()[0]
        cur = db.execute(f'SELECT rowid AS _fid, * FROM "{table}"')
        names = [d[0] for d in cur.description]
        for row in cur:
            r = dict(zip(names, row, strict=True))
            blob = r.pop(geom)
            if blob is None:
                continue
            body = blob[8 + [0, 32, 48, 48, 64][blob[3] >> 1 & 7] :]
            props = {k: None if v is None else str(v) for k, v in r.items() if k != "_fid"}
            for i, rings in enumerate(_wkb(body)):
                f = _feature(r["_fid"], i, rings, props)
                if not self._outside(*f[3:7]):
                    yield f
        db.close()

    def _shp(self):
        props = _dbf(self.path[:-4] + ".dbf")
        with open(self.path, "rb") as f:
            f.seek(100)
            while len(head := f.read(8)) == 8:
                number, words = struct.unpack(">II", head)
                data, own = f.read(2 * words), next(props)
                kind = struct.unpack_from("<i", data)[0]
                if kind == 0:
                    continue
                if kind == 1:
                    rings = [[struct.unpack_from("<dd", data, 4)]]
                elif kind in (3, 5):
                    if self._outside(*struct.unpack_from("<4d", data, 4)):
                        continue
                    parts, n = struct.unpack_from("<ii", data, 36)
                    cut = [*struct.unpack_from("<" + "i" * parts, data, 44), n]
                    v = struct.unpack_from("<" + "d" * (2 * n), data, 44 + 4 * parts)
                    pts = list(zip(v[::2], v[1::2], strict=True))
                    rings = [pts[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                else:
                    raise ValueError(f"shape type {kind}")
                f_ = _feature(number, 0, rings, own)
                if not self._outside(*f_[3:7]):
                    yield f_


class FeatureSource(DataSource):
    @classmethod
    def name(cls):
        return "map_features"

    def schema(self):
        return FEATURES

    def reader(self, schema):
        return FeatureReader(self.options["path"], self.options.get("bbox"), self.options.get("table"))


def read_features(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Features of a shapefile or GeoPackage; lines have one ring each, the envelope stands in columns for pushdown after a Parquet ingest."""
    spark.dataSource.register(FeatureSource)
    r = spark.read.format("map_features").option("path", path)
    return (r.option("bbox", ",".join(map(str, bbox))) if bbox else r).load()


def write_raster(cells: DataFrame, path: str, width: int, height: int, value: str = "v", kind: str = "u1", nodata: float = 0, left: float = 0.0, upper: float = 0.0, cell: float = 1.0, block: int = 512) -> None:
    """Cells (z, x, value) of a map of any size as one tiled, deflated BigTIFF; missing cells are ``nodata``.

    Blocks are compressed where they lie and stored; their sizes give every block its place;
    then each task writes its blocks there. The driver sees one number for each block.
    """
    from terraspark.operators.graph import cut_lineage
    from terraspark.sources.binary_maps import _publish
    from terraspark.sources.tiles import windows

    dtype = np.dtype("<" + kind)
    whole = dtype.kind in "ui"
    across = -(-width // block)

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        rz, rx = (k.as_py() for k in key)
        a = np.full(block * block, nodata, dtype)
        z, x, v = (t.column(c) for c in ("z", "x", "v"))
        known = v.is_valid().to_numpy(zero_copy_only=False)
        at = (z.to_numpy() - rz * block) * block + x.to_numpy() - rx * block
        a[at[known]] = v.drop_null().to_numpy().astype(dtype)
        a = a.reshape(block, block)
        if whole:  # horizontal differences
            d = a.copy()
            d[:, 1:] -= a[:, :-1]
            a = d
        data = zlib.compress(a.tobytes(), 6)
        return pa.table({"k": pa.array([rz * across + rx], pa.int64()), "data": pa.array([data], pa.binary())})

    spark = cells.sparkSession
    side = lambda c: F.floor(F.col(c) / block).cast("int")
    own = cells.select(side("z").alias("rz"), side("x").alias("rx"), "z", "x", F.col(value).alias("v"))
    # a block without cells has its corner as a cell without value
    every = windows(spark, width, height, block).select("rz", "rx", F.col("z0").cast("int").alias("z"), F.col("x0").cast("int").alias("x"))
    none = every.join(own.select("rz", "rx").distinct(), ["rz", "rx"], "left_anti").withColumn("v", F.lit(None).cast(own.schema["v"].dataType))
    z, x = (own.schema[c].dataType for c in ("z", "x"))
    blocks = own.unionByName(none.withColumn("z", F.col("z").cast(z)).withColumn("x", F.col("x").cast(x))).groupBy("rz", "rx").applyInArrow(pack, "k long, data binary")
    blocks = cut_lineage(spark, blocks)
    sizes = [r["n"] for r in blocks.select("k", F.octet_length("data").alias("n")).orderBy("k").collect()]
    entries = [
        (WIDTH, 4, "I", [width]), (HEIGHT, 4, "I", [height]), (DEPTH, 3, "H", [dtype.itemsize * 8]), (COMPRESSION, 3, "H", [8]), (262, 3, "H", [1]), (277, 3, "H", [1]), (PREDICTOR, 3, "H", [2 if whole else 1]),
        (TILE_WIDTH, 3, "H", [block]), (TILE_HEIGHT, 3, "H", [block]), (TILE_AT, 16, "Q", None), (TILE_BYTES, 16, "Q", sizes), (SAMPLE_FORMAT, 3, "H", [{"u": 1, "i": 2, "f": 3}[dtype.kind]]),
        (PIXEL_SCALE, 12, "d", [cell, cell, 0.0]), (TIE_POINT, 12, "d", [0.0, 0.0, 0.0, left, upper, 0.0]),
    ]
    start = 16 + 8 + 20 * len(entries) + 8
    lists = sum(struct.calcsize(f) * n for *_, f, v in entries if struct.calcsize(f) * (n := len(sizes if v is None else v)) > 8)
    at = (start + lists + np.cumsum([0, *sizes])).tolist()
    head, extra = bytearray(struct.pack("<2sHHHQQ", b"II", 43, 8, 0, 16, len(entries))), bytearray()
    for tag, number, form, v in entries:
        v = at[:-1] if v is None else v
        data = struct.pack(f"<{len(v)}{form}", *v)
        head += struct.pack("<HHQ", tag, number, len(v))
        if len(data) > 8:
            head += struct.pack("<Q", start + len(extra))
            extra += data
        else:
            head += data.ljust(8, b"\0")
    places = spark.createDataFrame(list(enumerate(at[:-1])), "k long, at long")
    _publish(path, at[-1], bytes(head) + b"\0" * 8 + bytes(extra), blocks.join(F.broadcast(places), "k"), lambda r: r["at"], lambda r: r["data"], ["at", "data"])


def write_features(features: DataFrame, path: str, table: str, srs: int = 4326, keep: list[str] | None = None) -> None:
    """Polygons(rings, and the columns ``keep`` as text) as a GeoPackage, in place of one that is there.

    Geometries are encoded where they lie; the file itself is one database, written row by row
    as they arrive and published by one rename.
    """
    keep = [c for c in features.columns if c not in ("rings", "id")] if keep is None else keep
    at = features.columns.index("rings")

    def encode(batches):
        for batch in batches:
            blobs = []
            for rings in batch.column(at).to_pylist():
                body = [b"GP\0\1", struct.pack("<i", srs), b"\1", struct.pack("<II", 3, len(rings or ()))]
                for r in rings or ():
                    body.append(struct.pack("<I", len(r)) + np.array([(p["x"], p["y"]) for p in r], "<f8").tobytes())
                blobs.append(b"".join(body))
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), *(batch.column(k).cast(pa.string()) for k in names)], names=["geom", *keep])

    names = [features.columns.index(c) for c in keep]
    rows = features.mapInArrow(encode, ", ".join(["geom binary", *(f"`{c}` string" for c in keep)]))
    # the envelope of all, for the table of contents
    box = features.select(F.explode(F.flatten("rings")).alias("p")).agg(F.min("p.x"), F.min("p.y"), F.max("p.x"), F.max("p.y")).first()
    tmp = path + ".tmp"
    if os.path.exists(tmp):
        os.remove(tmp)
    try:
        db = sqlite3.connect(tmp)
        db.executescript("""PRAGMA application_id = 0x47504B47; PRAGMA user_version = 10300;
            CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
            CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ', 'now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
            CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);""")
        for name, number in (("Undefined Cartesian", -1), ("Undefined geographic", 0), (f"EPSG:{srs}", srs)):
            db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', NULL)", (name, number, "EPSG" if number > 0 else "NONE", number))
        quoted = [f'"{c}"' for c in keep]
        db.execute(f'CREATE TABLE "{table}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom POLYGON{"".join(f", {c} TEXT" for c in quoted)})')
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", (table, table, *box, srs))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', ?, 0, 0)", (table, srs))
        insert = f'INSERT INTO "{table}" ({", ".join(["geom", *quoted])}) VALUES ({", ".join("?" * (1 + len(keep)))})'
        db.executemany(insert, ((bytes(r[0]), *r[1:]) for r in rows.toLocalIterator()))
        db.commit()
        db.close()
        os.replace(tmp, path)
    finally:
        if os.path.exists(tmp):
            os.remove(tmp)
