"""Two-dimensional variables of HDF5 files (NetCDF-4): one partition for each run of chunks, of which only those in the window are read.

Read are superblocks 0 to 3, object headers 1 and 2, groups as symbol tables or as link
messages, contiguous and chunked layouts (version 3) with their chunk tree, and the
filters deflate, shuffle and fletcher32. Links or attributes kept in a fractal heap
(groups or variables with very many of them) and other chunk indexes are an error that
says so; with ``scale`` and ``offset`` given, attributes are not needed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terraspark.sources.window import Bounds, option

# Fixed values of the format: its mark, message types and filter numbers.
MARK = b"\x89HDF\r\n\x1a\n"
NIL, DATASPACE, LINK_INFO, DATATYPE, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUES, SYMBOLS, ATTRIBUTE_INFO = 0, 1, 2, 3, 5, 6, 8, 11, 12, 16, 17, 21
DEFLATE, SHUFFLE, FLETCHER = 1, 2, 3
NOWHERE = (1 << 64) - 1
#: Cells of an Arrow batch.
BATCH = 1 << 18


class Hdf5File:
    """Headers of a file, read as needed."""

    def __init__(self, path: str):
        self.path, self.f = path, open(path, "rb")
        start = 0
        while self.at(start, 8) != MARK:
            start = max(512, start * 2)
            if start > 1 << 24 or not self.at(start, 8):
                raise ValueError(f"{path} is not HDF5")
        head = self.at(start, 96)
        version = head[8]
        if version > 3:
            raise ValueError(f"{path}: superblock {version} is not known")
        sizes = head[13:15] if version < 2 else head[9:11]
        if tuple(sizes) != (8, 8):
            raise ValueError(f"{path}: addresses of {sizes[0]} bytes are not known")
        if version < 2:
            skip = start + (24 if version == 0 else 28)
            self.base, *_ = struct.unpack("<Q", self.at(skip, 8))
            (self.root,) = struct.unpack("<Q", self.at(skip + 32 + 8, 8))
        else:
            self.base, _, _, self.root = struct.unpack("<4Q", head[12:44])

    def at(self, address: int, n: int) -> bytes:
        self.f.seek(address)
        return self.f.read(n)

    def part(self, address: int, n: int) -> bytes:
        return self.at(self.base + address, n)

    # -- objects

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        """(type, data) of an object's header and its continuations."""
        head = self.part(address, 16)
        out: list[tuple[int, bytes]] = []
        if head[:4] == b"OHDR":
            flags, at = head[5], 6 + (16 if head[5] & 32 else 0) + (4 if head[5] & 16 else 0)
            width = 1 << (flags & 3)
            size = int.from_bytes(self.part(address + at, width), "little")
            blocks = [(address + at + width, size)]
            lead = 4 + (2 if flags & 4 else 0)
            while blocks:
                a, n = blocks.pop(0)
                self._walk(self.part(a, n), lead, lambda d: (d[0], struct.unpack_from("<H", d, 1)[0]), out, blocks, 8)
        elif head[0] == 1:
            (size,) = struct.unpack_from("<I", head, 8)
            blocks = [(address + 16, size)]
            while blocks:
                a, n = blocks.pop(0)
                self._walk(self.part(a, n), 8, lambda d: struct.unpack_from("<HH", d), out, blocks, 0)
        else:
            raise ValueError(f"{self.path}: no object header at {address}")
        return out

    @staticmethod
    def _walk(data: bytes, lead: int, kind, out: list, blocks: list, marks: int) -> None:
        at = 0
        while at + lead <= len(data):
            what, n = kind(data[at : at + lead])
            body = data[at + lead : at + lead + n]
            if what == CONTINUES:
                a, size = struct.unpack("<QQ", body[:16])
                blocks.append((a + 4, size - 8) if marks else (a, size))
            elif what != NIL:
                out.append((what, body))
            at += lead + n

    def members(self, address: int) -> dict[str, int]:
        """Names in a group and where their objects are."""
        out = {}
        for what, d in self.messages(address):
            if what == LINK:
                flags, at = d[1], 2
                soft = bool(flags & 8) and d[at] != 0
                at += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 16)
                width = 1 << (flags & 3)
                n = int.from_bytes(d[at : at + width], "little")
                name = d[at + width : at + width + n].decode()
                if not soft:
                    (out[name],) = struct.unpack_from("<Q", d, at + width + n)
            elif what == LINK_INFO:
                heap = struct.unpack_from("<Q", d, 2 + 8 * (d[1] & 1))[0]
                if heap != NOWHERE:
                    raise ValueError(f"{self.path}: a group with its links in a heap is not supported")
            elif what == SYMBOLS:
                tree, heap = struct.unpack("<QQ", d[:16])
                (names,) = struct.unpack("<Q", self.part(heap + 24, 8))
                for node in self._leaves(tree):
                    (n,) = struct.unpack("<H", self.part(node + 6, 2))
                    for i in range(n):
                        name, to = struct.unpack("<QQ", self.part(node + 8 + 40 * i, 16))
                        out[self.part(names + name, 256).split(b"\0", 1)[0].decode()] = to
        return out

    def _leaves(self, tree: int) -> Iterator[int]:
        head = self.part(tree, 24)
        n, level = struct.unpack_from("<H", head, 6)[0], head[5]
        for i in range(n):
            (child,) = struct.unpack("<Q", self.part(tree + 24 + 8 + 16 * i, 8))
            yield from (self._leaves(child) if level else [child])

    def find(self, path: str) -> int:
        at = self.root
        for name in filter(None, path.split("/")):
            found = self.members(at)
            if name not in found:
                raise ValueError(f"{path} is not in {self.path}, which holds {sorted(found)}")
            at = found[name]
        return at

    def chunks(self, tree: int, rank: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """(first cell, bytes, filters left out, address) of the chunks of a tree."""
        head = self.part(tree, 24)
        if head[:4] != b"TREE" or head[4] != 1:
            raise ValueError(f"{self.path}: no chunk tree at {tree}")
        n, level = struct.unpack_from("<H", head, 6)[0], head[5]
        key = 8 + 8 * (rank + 1)
        data = self.part(tree + 24, n * (key + 8))
        for i in range(n):
            size, mask, *first = struct.unpack_from(f"<II{rank + 1}Q", data, i * (key + 8))
            (child,) = struct.unpack_from("<Q", data, i * (key + 8) + key)
            if level:
                yield from self.chunks(child, rank)
            else:
                yield tuple(first[:rank]), size, mask, child


def _dtype(d: bytes) -> np.dtype:
    size = struct.unpack_from("<I", d, 4)[0]
    order = ">" if d[1] & 1 else "<"
    if d[0] & 15 == 0:
        return np.dtype(f"{order}{'i' if d[1] & 8 else 'u'}{size}")
    if d[0] & 15 == 1:
        return np.dtype(f"{order}f{size}")
    raise ValueError("only whole and floating numbers are supported")


def _shape(d: bytes) -> tuple[int, ...]:
    return struct.unpack_from(f"<{d[1]}Q", d, 8 if d[0] == 1 else 4)


def _filters(d: bytes) -> list[tuple[int, tuple[int, ...]]]:
    out, at = [], 8 if d[0] == 1 else 2
    for _ in range(d[1]):
        what = struct.unpack_from("<H", d, at)[0]
        named = d[0] == 1 or what >= 256
        length = struct.unpack_from("<H", d, at + 2)[0] if named else 0
        at += 4 if named else 2
        n = struct.unpack_from("<H", d, at + 2)[0]
        at += 4 + (-(-length // 8) * 8 if d[0] == 1 else length)
        out.append((what, struct.unpack_from(f"<{n}I", d, at)))
        at += 4 * n + (4 * (n % 2) if d[0] == 1 else 0)
    return out


def _attribute(d: bytes) -> tuple[str, list[float] | None]:
    sizes = struct.unpack_from("<3H", d, 2)
    at, pad = (8, 8) if d[0] == 1 else (8 + (d[0] == 3), 1)
    parts = []
    for n in sizes:
        parts.append(d[at : at + n])
        at += -(-n // pad) * pad
    name = parts[0].split(b"\0", 1)[0].decode()
    if parts[1][0] & 15 > 1:
        return name, None
    return name, np.frombuffer(d, _dtype(parts[1]), int(np.prod(_shape(parts[2]), dtype=np.int64)), at).tolist()


class Variable:
    """What is needed to read a two-dimensional variable."""

    def __init__(self, file: Hdf5File, path: str, scale: float | None = None, offset: float | None = None):
        found = file.messages(file.find(path))
        one = {k: d for k, d in found if k != ATTRIBUTE}
        if not {DATASPACE, DATATYPE, LAYOUT} <= one.keys():
            raise ValueError(f"{path} is not a variable")
        self.kind, shape = _dtype(one[DATATYPE]), _shape(one[DATASPACE])
        if len(shape) != 2:
            raise ValueError(f"{path} has {len(shape)} dimensions, not two")
        self.height, self.width = shape
        extra = dict(_attribute(d) for k, d in found if k == ATTRIBUTE)
        heap = ATTRIBUTE_INFO in one and struct.unpack_from("<Q", one[ATTRIBUTE_INFO], 2 + 2 * (one[ATTRIBUTE_INFO][1] & 1))[0] != NOWHERE
        if heap and (scale is None or offset is None):
            raise ValueError(f"{path} keeps its attributes in a heap: give scale and offset")
        number = lambda k, given, usual: given if given is not None else float((extra.get(k) or [usual])[0])
        self.scale, self.offset = number("scale_factor", scale, 1.0), number("add_offset", offset, 0.0)
        self.none = (extra.get("_FillValue") or extra.get("missing_value") or [None])[0]
        self.fill = self._fill(one.get(FILL))
        if self.none is None and heap:
            self.none = self.fill
        self.filters = _filters(one[FILTERS]) if FILTERS in one else []
        d = one[LAYOUT]
        if d[0] != 3 or d[1] not in (1, 2):
            raise ValueError(f"{path}: layout {d[0]} of class {d[1]} is not supported")
        if d[1] == 1:
            self.chunk, (self.begin,) = None, struct.unpack_from("<Q", d, 2)
            self.tree = NOWHERE
        else:
            (self.tree,) = struct.unpack_from("<Q", d, 3)
            self.chunk = struct.unpack_from("<2I", d, 11)

    def _fill(self, d: bytes | None):
        if d is None or (d[0] == 3 and not d[1] & 32) or (d[0] == 2 and not d[3]):
            return None
        n, at = (struct.unpack_from("<I", d, 2)[0], 6) if d[0] == 3 else (struct.unpack_from("<I", d, 4)[0], 8)
        return np.frombuffer(d, self.kind, 1, at)[0].item() if n == self.kind.itemsize else None

    def unpacked(self, raw: bytes, mask: int) -> np.ndarray:
        """The cells of a chunk: its filters undone, last first."""
        for i, (what, _) in reversed(list(enumerate(self.filters))):
            if mask >> i & 1:
                continue
            if what == DEFLATE:
                raw = zlib.decompress(raw)
            elif what == SHUFFLE:
                n = len(raw) // self.kind.itemsize
                raw = np.frombuffer(raw, np.uint8)[: n * self.kind.itemsize].reshape(self.kind.itemsize, n).T.tobytes()
            elif what == FLETCHER:
                raw = raw[:-4]
            else:
                raise ValueError(f"filter {what} is not supported")
        return np.frombuffer(raw, self.kind).reshape(self.chunk)

    def values(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = raw.astype(np.float64)
        return v * self.scale + self.offset, np.isnan(v) if self.none is None else np.isnan(v) | (v == self.none)


class _Run(InputPartition):
    """Rows [a, b) and the chunks that lie there."""

    def __init__(self, a: int, b: int, chunks: list):
        self.a, self.b, self.chunks = a, b, chunks


class Hdf5Reader(DataSourceReader):
    def __init__(self, options):
        number = lambda k: float(options[k]) if k in options else None
        self.path, self.rows = options["path"], int(options.get("stripe", "512"))
        self.file = Hdf5File(self.path)
        self.v = Variable(self.file, options["variable"], number("scale"), number("offset"))
        self.bounds = Bounds(self.v.height, self.v.width, options.get("window"))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "file"}

    def partitions(self):
        v = self.v
        if not self.bounds.meets(x=(0, v.width)):
            return [_Run(0, 0, [])]
        step = self.rows if v.chunk is None else max(1, self.rows // v.chunk[0]) * v.chunk[0]
        runs = {a: _Run(a, min(a + step, v.height), []) for a in range(0, v.height, step) if self.bounds.meets(z=(a, min(a + step, v.height)))}
        if v.tree != NOWHERE:
            for c in self.file.chunks(v.tree, 2):
                (z, x), run = c[0], runs.get(c[0][0] // step * step)
                if run and self.bounds.meets(z=(z, z + v.chunk[0]), x=(x, x + v.chunk[1])):
                    run.chunks.append(c)
        return list(runs.values()) or [_Run(0, 0, [])]

    def read(self, p):
        v = self.v
        with open(self.path, "rb") as f:
            base = Hdf5File(self.path).base
            if v.chunk is None:
                step = max(1, BATCH // v.width)
                for z in range(max(p.a, self.bounds.z[0]), min(p.b, self.bounds.z[1]), step):
                    n = min(step, p.b - z)
                    f.seek(base + v.begin + z * v.width * v.kind.itemsize)
                    raw = np.frombuffer(f.read(n * v.width * v.kind.itemsize), v.kind)
                    yield from self._cells(raw.reshape(n, v.width), z, 0)
                return
            for (z, x), size, mask, address in p.chunks:
                f.seek(base + address)
                yield from self._cells(v.unpacked(f.read(size), mask)[: v.height - z, : v.width - x], z, x)
            if v.fill is not None and v.fill != v.none:
                # chunks that were never written hold the fill value, which stands for itself here
                have = {c[0] for c in p.chunks}
                for z in range(p.a, p.b, v.chunk[0]):
                    for x in range(0, v.width, v.chunk[1]):
                        if (z, x) not in have and self.bounds.meets(z=(z, z + v.chunk[0]), x=(x, x + v.chunk[1])):
                            yield from self._cells(np.full(v.chunk, v.fill, v.kind)[: v.height - z, : v.width - x], z, x)

    def _cells(self, raw: np.ndarray, z0: int, x0: int) -> Iterator[pa.RecordBatch]:
        (zlo, zhi), (xlo, xhi) = self.bounds.z, self.bounds.x
        top, left = max(zlo - z0, 0), max(xlo - x0, 0)
        raw = raw[top : max(zhi - z0, 0), left : max(xhi - x0, 0)]
        if not raw.size:
            return
        step = max(1, BATCH // raw.shape[1])
        for i in range(0, len(raw), step):
            part = raw[i : i + step]
            z, x = np.mgrid[: part.shape[0], : part.shape[1]].astype(np.int32)
            value, gone = self.v.values(part)
            yield pa.RecordBatch.from_arrays([pa.array((z + np.int32(z0 + top + i)).ravel()), pa.array((x + np.int32(x0 + left)).ravel()), pa.array(value.ravel(), mask=gone.ravel())], names=["z", "x", "v"])


class Hdf5Source(DataSource):
    @classmethod
    def name(cls):
        return "hdf5_grid"

    def schema(self):
        return "z int, x int, v double"

    def reader(self, schema):
        return Hdf5Reader(self.options)


def read_hdf5(spark: SparkSession, path: str, variable: str, stripe: int = 512, scale: float | None = None, offset: float | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(z, x, v) of a two-dimensional variable, or of its cells in ``window`` (z0, x0, z1, x1); missing cells are null, chunks that were never written give no rows unless a fill value stands for them."""
    spark.dataSource.register(Hdf5Source)
    read = spark.read.format("hdf5_grid").option("path", path).option("variable", variable).option("stripe", stripe).options(**option(window))
    for k, v in (("scale", scale), ("offset", offset)):
        read = read if v is None else read.option(k, repr(float(v)))
    return read.load()
