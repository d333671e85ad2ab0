"""Arc/Info binary grids: a folder of header, bounds and tiles of blocks, each block packed in one of some ways.

A partition is a run of rows of blocks; the tile index says where its blocks are, and
nothing else is read. Cells without data are null; blocks that were never written too.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terraspark.grid import Grid
from terraspark.sources.window import Bounds, option

# Fixed values of the format: its mark, the least number (no data) and the ways to pack a block.
MARK = b"GRID1."
NO_DATA, NO_FLOAT = -2147483647, -3.4e38
CONSTANT, BITS_1, BITS_4, BITS_8, BITS_16, BITS_32 = 0x00, 0x01, 0x04, 0x08, 0x10, 0x20
LITERAL_16, LITERAL_8, LITERAL_LEAST, RUNS_32, RUNS_16, RUNS_8, RUNS_8_OTHER = 0xCF, 0xD7, 0xDF, 0xE0, 0xF0, 0xFC, 0xF8
HEAD = 100


def tile_name(ty: int, tx: int) -> str:
    """The file of a tile, without its ending."""
    if ty < 2:
        return f"w{tx + 1:03d}{1 - ty:03d}"
    return f"z{tx + 1:03d}{ty - 1:03d}"


class ArcGrid:
    """Header and bounds of a grid's folder, or of the folder of one of its files."""

    def __init__(self, path: str):
        self.folder = path if os.path.isdir(path) else os.path.dirname(path)
        with open(os.path.join(self.folder, "hdr.adf"), "rb") as f:
            head = f.read(308)
        if head[:6] != MARK:
            raise ValueError(f"{path} is no Arc/Info grid")
        (self.kind,) = struct.unpack_from(">i", head, 16)
        self.cell = struct.unpack_from(">2d", head, 256)
        # blocks along and down a tile, cells along and down a block
        self.along, self.down, self.bw, _, self.bh = struct.unpack_from(">5i", head, 288)
        with open(os.path.join(self.folder, "dblbnd.adf"), "rb") as f:
            self.bounds = struct.unpack(">4d", f.read(32))
        self.width, self.height = round((self.bounds[2] - self.bounds[0]) / self.cell[0]), round((self.bounds[3] - self.bounds[1]) / self.cell[1])

    def grid(self, crs: str = "EPSG:4326") -> Grid:
        return Grid(self.cell[0], 0.0, self.bounds[0], 0.0, -self.cell[1], self.bounds[3], self.width, self.height, crs)

    def index(self, ty: int, tx: int) -> np.ndarray | None:
        """(first byte, bytes) of a tile's blocks; None for a tile without a file."""
        path = os.path.join(self.folder, tile_name(ty, tx) + "x.adf")
        if not os.path.exists(path):
            return None
        with open(path, "rb") as f:
            raw = f.read()[HEAD:]
        return np.frombuffer(raw[: len(raw) // 8 * 8], ">i4").reshape(-1, 2).astype(np.int64) * 2

    def block(self, raw: bytes) -> np.ndarray:
        """A block's cells from its bytes behind the size, as doubles; no data is NaN."""
        n = self.bw * self.bh
        if self.kind == 2:
            v = np.full(n, np.nan)
            given = np.frombuffer(raw[: min(len(raw) // 4, n) * 4], ">f4").astype(float)
            v[: len(given)] = given
            return np.where(v < NO_FLOAT * 0.99, np.nan, v).reshape(self.bh, self.bw)
        v = unpacked(raw, n)
        return np.where(v == NO_DATA, np.nan, v.astype(float)).reshape(self.bh, self.bw)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    """``n`` whole numbers of a block: what it holds over its least value."""
    way, size = raw[0], raw[1]
    least, data = int.from_bytes(raw[2 : 2 + size], "big", signed=True), raw[2 + size :]
    if way == CONSTANT:
        return np.full(n, least, np.int64)
    plain = {BITS_8: ">u1", BITS_16: ">u2", BITS_32: ">u4"}
    if way in plain:
        v = np.frombuffer(data, plain[way], n).astype(np.int64)
    elif way == BITS_4:
        v = np.frombuffer(data, np.uint8, -(-n // 2))
        v = np.stack([v >> 4, v & 15], axis=1).ravel()[:n].astype(np.int64)
    elif way == BITS_1:
        v = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8)))[:n].astype(np.int64)
    elif way in (RUNS_32, RUNS_16, RUNS_8, RUNS_8_OTHER):
        kind = {RUNS_32: ">u4", RUNS_16: ">u2"}.get(way, "u1")
        pair = np.dtype([("n", "u1"), ("v", kind)])
        runs = np.frombuffer(data[: len(data) // pair.itemsize * pair.itemsize], pair)
        v = np.repeat(runs["v"].astype(np.int64), runs["n"])[:n]
    elif way in (LITERAL_16, LITERAL_8, LITERAL_LEAST):
        return _literal(data, way, least, n)
    else:
        raise ValueError(f"blocks packed as {way:#x} are not supported")
    if len(v) < n:
        raise ValueError(f"a block packed as {way:#x} holds {len(v)} of {n} cells")
    v = v + least
    # numbers of four bytes wrap around
    return (v + 2**31) % 2**32 - 2**31 if way in (BITS_32, RUNS_32) else v


def _literal(data: bytes, way: int, least: int, n: int) -> np.ndarray:
    """Marks up to 127 stand before as many values, those above for 256 less the mark cells without data."""
    size = {LITERAL_16: 2, LITERAL_8: 1, LITERAL_LEAST: 0}[way]
    out, at, have = [], 0, 0
    while have < n and at < len(data):
        mark, at = data[at], at + 1
        if mark > 127:
            out.append(np.full(256 - mark, NO_DATA, np.int64))
        else:
            out.append((np.frombuffer(data, f">u{size}", mark, at).astype(np.int64) if size else np.zeros(mark, np.int64)) + least)
            at += mark * size
        have += len(out[-1])
    if have < n:
        raise ValueError(f"a block packed as {way:#x} holds {have} of {n} cells")
    return np.concatenate(out)[:n]


class _Run(InputPartition):
    def __init__(self, a: int, b: int):
        self.a, self.b = a, b


class ArcReader(DataSourceReader):
    def __init__(self, options):
        self.g = ArcGrid(options["path"])
        self.bounds = Bounds(self.g.height, self.g.width, options.get("window"))
        self.step = max(1, int(options.get("stripe", "512")) // self.g.bh)

    def partitions(self):
        # rows of blocks; a tile's rows stand in one file
        rows = -(-self.g.height // self.g.bh)
        runs = [_Run(a, min(a + self.step, rows)) for a in range(0, rows, self.step)]
        return [r for r in runs if self.bounds.meets(z=(r.a * self.g.bh, r.b * self.g.bh))] or [_Run(0, 0)]

    def read(self, p) -> Iterator[pa.RecordBatch]:
        g, index, files = self.g, {}, {}
        across = -(-g.width // g.bw)
        try:
            for row in range(p.a, p.b):
                z0 = row * g.bh
                if not self.bounds.meets(z=(z0, z0 + g.bh)):
                    continue
                for col in range(across):
                    x0 = col * g.bw
                    if not self.bounds.meets(x=(x0, x0 + g.bw)):
                        continue
                    tile = (row // g.down, col // g.along)
                    if tile not in index:
                        index[tile] = g.index(*tile)
                        if index[tile] is not None:
                            files[tile] = open(os.path.join(g.folder, tile_name(*tile) + ".adf"), "rb")
                    at = (row % g.down) * g.along + col % g.along
                    if index[tile] is None or at >= len(index[tile]) or not index[tile][at, 1]:
                        continue  # no rows for what was never written
                    files[tile].seek(index[tile][at, 0] + 2)
                    yield from self._cells(g.block(files[tile].read(int(index[tile][at, 1]))), z0, x0)
        finally:
            for f in files.values():
                f.close()

    def _cells(self, v: np.ndarray, z0: int, x0: int) -> Iterator[pa.RecordBatch]:
        (za, zb), (xa, xb) = self.bounds.z, self.bounds.x
        top, left = max(za - z0, 0), max(xa - x0, 0)
        v = v[top : max(zb - z0, 0), left : max(xb - x0, 0)]
        if v.size:
            z, x = np.mgrid[: v.shape[0], : v.shape[1]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array((z + np.int32(z0 + top)).ravel()), pa.array((x + np.int32(x0 + left)).ravel()), pa.array(v.ravel(), mask=np.isnan(v).ravel())], names=["z", "x", "v"])


class ArcSource(DataSource):
    @classmethod
    def name(cls):
        return "arc_grid"

    def schema(self):
        return "z int, x int, v double"

    def reader(self, schema):
        return ArcReader(self.options)


def read_arc_grid(spark: SparkSession, path: str, stripe: int = 512, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(z, x, v) of a grid's folder or of a file in it, all of it or its cells in ``window`` (z0, x0, z1, x1); cells without data are null, blocks that were never written give no rows."""
    spark.dataSource.register(ArcSource)
    return spark.read.format("arc_grid").options(path=path, stripe=stripe, **option(window)).load()
