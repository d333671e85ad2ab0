"""The two binary artifacts of a map: the region store and the climate grid, as data sources and sinks.

Readers are Python data sources: one input partition per region (or stripe of
sample rows), each seeking to its own bytes. Writers put every region at its fixed
offset of a temporary file in parallel, then publish it by one rename; the path must
be on a file system that all executors share. A failed write leaves no file.
"""

from __future__ import annotations

import math
import os
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terraspark.functions.scalars import bake_bathymetry, bake_height

# Fixed values of the two formats.
REGION_HEADER = struct.Struct("<8sIIIII")  # magic, version, width, height, region size, sea level
REGION_MAGIC, REGION_VERSION, REGION = b"EMREGION", 4, 512
PLANES = ["heightmap", "lake_depth", "bathymetry_heightmap", "vegetation", "river", "river_surface", "river_depth", "lake_mask", "landmask"]
CLIMATE_HEADER = struct.Struct("<4siiiif")  # magic, version, width, height, spacing, lapse
CLIMATE_MAGIC, CLIMATE_VERSION, SPACING = b"EMCL", 2, 8
#: Samples of a row that are packed and written together.
STRETCH = 4096
SAMPLE = np.dtype([("temperature", "<i2", (12,)), ("precipitation", "<u2"), ("pet", "<u2"), ("terrain_y", "<u2")])

# nested functions travel with the globals they use, and a Struct cannot
REGION_START, CLIMATE_START = REGION_HEADER.size, CLIMATE_HEADER.size
PLANE_BYTES = REGION * REGION
REGION_BYTES = PLANE_BYTES * len(PLANES)


def region_header(path: str) -> tuple[int, int, int]:
    """(width, height, sea level); raises for anything but a whole file of this version."""
    with open(path, "rb") as f:
        head = f.read(REGION_HEADER.size)
    if len(head) < REGION_HEADER.size:
        raise ValueError("not a region store: header cut off")
    magic, version, width, height, size, sea = REGION_HEADER.unpack(head)
    if magic != REGION_MAGIC or version != REGION_VERSION or size != REGION:
        raise ValueError("not a region store of version 4")
    whole = REGION_HEADER.size + width // REGION * (height // REGION) * REGION_BYTES
    if not width or not height or width % REGION or height % REGION or not 1 < sea < 255 or os.path.getsize(path) != whole:
        raise ValueError(f"region store of {width} x {height} has wrong dimensions or length")
    return width, height, sea


def climate_header(path: str, width: int | None = None, height: int | None = None) -> tuple[int, int, float]:
    """(width, height, lapse) in blocks; raises if they don't fit the map."""
    with open(path, "rb") as f:
        head = f.read(CLIMATE_HEADER.size)
    if len(head) < CLIMATE_HEADER.size or head[:4] != CLIMATE_MAGIC:
        raise ValueError("not a climate grid")
    _, _, w, h, spacing, lapse = CLIMATE_HEADER.unpack(head)
    if spacing != SPACING or w <= 0 or h <= 0 or (width or w) != w or (height or h) != h or not math.isfinite(lapse) or lapse > 0:
        raise ValueError("climate grid does not fit the map")
    return w, h, lapse


def samples(blocks: int) -> int:
    return (blocks - 1) // SPACING + 1


class _At(InputPartition):
    def __init__(self, a: int, b: int):
        self.a, self.b = a, b


class RegionReader(DataSourceReader):
    def __init__(self, path: str, rx: str | None = None, rz: str | None = None):
        self.path, self.rx, self.rz = path, rx, rz
        self.width, self.height, _ = region_header(path)

    def partitions(self):
        side = lambda n, only: range(n) if only is None else [k for k in [int(only)] if 0 <= k < n]
        # no region asked for: one partition that reads nothing
        return [_At(rx, rz) for rx in side(self.width // REGION, self.rx) for rz in side(self.height // REGION, self.rz)] or [_At(-1, -1)]

    def read(self, p):
        if p.a < 0:
            return
        with open(self.path, "rb") as f:
            f.seek(REGION_HEADER.size + (p.a * (self.height // REGION) + p.b) * REGION_BYTES)
            data = f.read(REGION_BYTES)
        yield (p.b, p.a, *(data[i * PLANE_BYTES : (i + 1) * PLANE_BYTES] for i in range(len(PLANES))))


class RegionSource(DataSource):
    @classmethod
    def name(cls):
        return "map_regions"

    def schema(self):
        return "rz int, rx int, " + ", ".join(f"{p} binary" for p in PLANES)

    def reader(self, schema):
        return RegionReader(self.options["path"], self.options.get("rx"), self.options.get("rz"))


class ClimateReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows
        self.width, self.height, _ = climate_header(path)

    def partitions(self):
        n = samples(self.height)
        return [_At(a, min(a + self.rows, n)) for a in range(0, n, self.rows)]

    def read(self, p):
        w = samples(self.width)
        with open(self.path, "rb") as f:
            f.seek(CLIMATE_HEADER.size + p.a * w * SAMPLE.itemsize)
            r = np.frombuffer(f.read((p.b - p.a) * w * SAMPLE.itemsize), SAMPLE)
        z, x = np.divmod(np.arange(len(r), dtype=np.int32), np.int32(w))
        months = pa.ListArray.from_arrays(pa.array(np.arange(0, 12 * len(r) + 1, 12, dtype=np.int32)), pa.array(r["temperature"].astype(np.int32).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(z + np.int32(p.a)), pa.array(x), months, *(pa.array(r[k].astype(np.int32)) for k in ("precipitation", "pet", "terrain_y"))], names=["sz", "sx", "temperature", "precipitation", "pet", "terrain_y"])


class ClimateSource(DataSource):
    @classmethod
    def name(cls):
        return "map_climate"

    def schema(self):
        return "sz int, sx int, temperature array<int>, precipitation int, pet int, terrain_y int"

    def reader(self, schema):
        return ClimateReader(self.options["path"], int(self.options.get("stripe", "128")))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Tiles (rz, rx, nine planes)."""
    spark.dataSource.register(RegionSource)
    return spark.read.format("map_regions").option("path", path).load()


def read_climate(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ClimateSource)
    return spark.read.format("map_climate").option("path", path).load()


def _publish(path: str, size: int, header: bytes, df: DataFrame, offset, payload, columns: list[str]) -> None:
    """Writes each row's payload at its offset, then renames. The count of rows written must be that of the map."""
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(tmp, "wb") as f:
            f.write(header)
            f.truncate(size)

        def write(batches):
            fd = os.open(tmp, os.O_WRONLY)
            n = 0
            try:
                for batch in batches:
                    for row in batch.to_pylist():
                        data = payload(row)
                        os.pwrite(fd, data, offset(row))
                        n += len(data)
                os.fsync(fd)
            finally:
                os.close(fd)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

        n = df.select(*columns).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
        if n != size - len(header):
            raise ValueError(f"{n} bytes for a map of {size - len(header)}: rows are missing or repeated")
        os.replace(tmp, path)
    finally:
        if os.path.exists(tmp):
            os.remove(tmp)


def baked(cells: DataFrame, sea: int = 60, least: int = 50) -> DataFrame:
    """Cells with their heights and depths as a store holds them: to be packed to tiles, then written."""
    land = F.col("landmask")
    return cells.withColumn("heightmap", bake_height(F.col("heightmap"), land)).withColumn("bathymetry_heightmap", bake_bathymetry(F.col("bathymetry_heightmap"), land, sea, least))


def write_regions(tiles: DataFrame, path: str, width: int, height: int, sea: int = 60) -> None:
    """Tiles (rz, rx, nine planes, see ``baked``) as a region store: regions column by column, each plane after plane."""
    across, down = (n // REGION if n > 0 and n % REGION == 0 else 0 for n in (width, height))
    if not across * down:
        raise ValueError(f"a store holds whole regions of {REGION} cells, not {width} x {height}")
    if not 2 <= sea <= 254:
        raise ValueError(f"sea level {sea} leaves no room below or above it")
    head = REGION_HEADER.pack(REGION_MAGIC, REGION_VERSION, width, height, REGION, sea)
    place = lambda r: REGION_START + (r["rx"] * down + r["rz"]) * REGION_BYTES
    _publish(path, len(head) + across * down * REGION_BYTES, head, tiles, place, lambda r: b"".join(r[p] for p in PLANES), ["rz", "rx", *PLANES])


def write_climate(records: DataFrame, path: str, width: int, height: int, lapse: float) -> None:
    """Samples (sz, sx, temperature[12] in tenths, precipitation, pet, terrain_y) as a climate grid; the lapse is known before the one write."""
    w, h = samples(width), samples(height)
    size = CLIMATE_HEADER.size + w * h * SAMPLE.itemsize
    head = CLIMATE_HEADER.pack(CLIMATE_MAGIC, CLIMATE_VERSION, width, height, SPACING, min(max(lapse, -0.5), 0.0))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        """A stretch of a row of samples -> its runs without gaps, as bytes."""
        t = t.sort_by("sx")
        sx = t.column("sx").to_numpy().astype(np.int64)
        out = np.zeros(len(sx), SAMPLE)
        # a null or a list of another length raises
        out["temperature"] = pa.compute.list_flatten(t.column("temperature")).to_numpy().reshape(len(sx), 12)
        for c in ("precipitation", "pet", "terrain_y"):
            out[c] = t.column(c).to_numpy()
        first = np.flatnonzero(np.r_[True, np.diff(sx) != 1])
        at = CLIMATE_START + (key[0].as_py() * w + sx[first]) * SAMPLE.itemsize
        return pa.table({"at": pa.array(at, pa.int64()), "bytes": pa.array([run.tobytes() for run in np.split(out, first[1:])], pa.binary())})

    stretch = F.floor(F.col("sx") / STRETCH)
    runs = records.groupBy("sz", stretch.alias("_s")).applyInArrow(pack, "at long, bytes binary")
    _publish(path, size, head, runs, lambda r: r["at"], lambda r: r["bytes"], ["at", "bytes"])


def region(spark: SparkSession, path: str, rx: int, rz: int) -> DataFrame:
    """Point access: only this region's bytes are read."""
    spark.dataSource.register(RegionSource)
    return spark.read.format("map_regions").options(path=path, rx=rx, rz=rz).load()


def climate_tile(records: DataFrame, rx: int, rz: int, width: int, height: int, side: int = 64) -> DataFrame:
    """The 65 x 65 samples of a region with its far edge, repeated where the map ends: (tz, tx, ...)."""
    w, h = samples(width), samples(height)
    at = F.sequence(F.lit(0), F.lit(side))
    grid = records.sparkSession.range(1).select(F.explode(at).alias("tz")).withColumn("tx", F.explode(at))
    grid = grid.withColumn("sz", F.least(F.col("tz") + rz * side, F.lit(h - 1))).withColumn("sx", F.least(F.col("tx") + rx * side, F.lit(w - 1)))
    return grid.join(records, ["sz", "sx"])
