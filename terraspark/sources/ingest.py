"""What comes before a scan: files found, archives unpacked, pinned datasets checked, settings, releases.

These run on the driver over a handful of files in a folder that all executors share;
what they find is then read by Spark. Everything is published by one rename, so a
cut-off run leaves no half file.
"""

from __future__ import annotations

import dataclasses
import json
import os
import re
import shutil
import struct
import urllib.request
import uuid
import zipfile
from collections.abc import Callable, Iterable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terraspark.sources.hdf5 import BATCH, read_hdf5
from terraspark.sources.window import Bounds, option

STEP = 1 << 20


def first_match(folder: str, pattern: str) -> str | None:
    """The first file by path that fits a pattern, at any depth."""
    return min((str(p) for p in Path(folder).rglob(pattern) if p.is_file()), default=None)


def first_existing(*candidates: str) -> str:
    """The first of several places at which a dataset may lie."""
    for c in candidates:
        if os.path.exists(c):
            return c
    raise FileNotFoundError(f"none of {', '.join(candidates)}")


def _published(target: str, make: Callable[[str], None]) -> str:
    part = f"{target}.{uuid.uuid4().hex}.part"
    os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
    try:
        make(part)
        os.replace(part, target)
    finally:
        if os.path.isdir(part):
            shutil.rmtree(part)
        elif os.path.exists(part):
            os.remove(part)
    return target


def fetch(url: str, target: str, check: Callable[[str], None] = lambda path: None, timeout: float = 60.0) -> str:
    """``target``, copied from a URL in steps of 1 MiB unless it is there; ``check`` raises for a file that must not be used."""

    def make(part: str) -> None:
        with urllib.request.urlopen(url, timeout=timeout) as src, open(part, "wb") as out:
            shutil.copyfileobj(src, out, STEP)
        check(part)

    if os.path.exists(target):
        check(target)
        return target
    return _published(target, make)


def holds(name: str) -> Callable[[str], None]:
    """A check that an archive has a member of this file name."""

    def check(path: str) -> None:
        with zipfile.ZipFile(path) as z:
            if name not in (os.path.basename(n) for n in z.namelist()):
                raise ValueError(f"{name} is not in {path}")

    return check


def single_band(path: str) -> None:
    """A check that a GeoTIFF has one band and says where it lies."""
    from terraspark.sources.formats import tiff_tags, tiff_transform

    _, tags = tiff_tags(path)
    if tags.get(277, [1])[0] != 1 or tiff_transform(path) is None:
        raise ValueError(f"{path}: one band with a place on the map is needed")


def unpack(archive: str, folder: str, wanted: str) -> str:
    """``folder`` with the archive's files, unless ``wanted`` is there already; a single folder around all of them is left out.

    The archive is unpacked beside the folder and checked. Then its files move in, over files of the
    same name; whatever else the folder holds stays.
    """

    def make(part: str) -> None:
        with zipfile.ZipFile(archive) as z:
            names = [n for n in z.namelist() if not n.endswith("/")]
            top = {n.split("/", 1)[0] for n in names}
            cut = len(next(iter(top))) + 1 if len(top) == 1 and all("/" in n for n in names) else 0
            for n in names:
                to = os.path.normpath(os.path.join(part, n[cut:]))
                if not to.startswith(os.path.normpath(part) + os.sep):
                    raise ValueError(f"{archive}: {n} leads out of the archive")
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with z.open(n) as src, open(to, "wb") as out:
                    shutil.copyfileobj(src, out, STEP)
        if not os.path.exists(os.path.join(part, wanted)):
            raise ValueError(f"{wanted} is not in {archive}")

    if os.path.exists(os.path.join(folder, wanted)):
        return folder
    if not os.path.isdir(folder):
        return _published(folder, make)
    part = f"{folder.rstrip(os.sep)}.{uuid.uuid4().hex}.part"
    try:
        make(part)
        last = os.path.normpath(os.path.join(part, wanted))
        files = sorted((os.path.join(d, n) for d, _, names in os.walk(part) for n in names), key=lambda p: p == last)
        for path in files:  # the wanted file last: once it is there, all are
            to = os.path.join(folder, os.path.relpath(path, part))
            os.makedirs(os.path.dirname(to), exist_ok=True)
            os.replace(path, to)
    finally:
        if os.path.isdir(part):
            shutil.rmtree(part)
    return folder


def is_geographic(path: str) -> bool:
    """Whether the .prj beside a shapefile names longitude and latitude of WGS 84; one without it counts as such."""
    prj = os.path.splitext(path)[0] + ".prj"
    if not os.path.exists(prj):
        return True
    text = Path(prj).read_text(errors="replace").upper()
    return text.lstrip().startswith("GEOGCS") and ("WGS_1984" in text or "WGS 84" in text)


def read_reaches(spark: SparkSession, *candidates: str) -> DataFrame:
    """The river features at the first place that exists; raises unless they are in longitude and latitude."""
    from terraspark.sources.formats import read_features

    path = first_existing(*candidates)
    if not is_geographic(path):
        raise ValueError(f"{path} must be in EPSG:4326")
    return read_features(spark, path)


def climatology(spark: SparkSession, folder: str, variables: dict[str, tuple[float, float]], name: str = "{variable}_{month:02d}.tif", months: Iterable[int] = range(1, 13)) -> DataFrame:
    """(variable, month, z, x, raw, scale, offset) of monthly single-band rasters; ``variables``: scale and offset of each. A filter on variable or month drops whole files."""
    from terraspark.sources.formats import read_tiff

    parts = []
    for variable, (scale, offset) in variables.items():
        for month in months:
            path = os.path.join(folder, name.format(variable=variable, month=month))
            single_band(path)
            parts.append(read_tiff(spark, path).select(F.lit(variable).alias("variable"), F.lit(month).alias("month"), "z", "x", F.col("v").alias("raw"), F.lit(scale).alias("scale"), F.lit(offset).alias("offset")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- NetCDF classic

# Fixed values of the classic format: tags of lists, and types by number.
NC_DIMENSION, NC_VARIABLE, NC_ATTRIBUTE = 10, 11, 12
NC_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


def netcdf_variable(path: str, variable: str) -> tuple[list[tuple[str, int]], np.dtype, int, dict]:
    """(dimensions, type, first byte, attributes) of a fixed-size variable of a NetCDF classic file (CDF-1, CDF-2)."""
    size = 1 << 20
    while True:  # a longer header is read again as a whole
        with open(path, "rb") as f:
            head = f.read(size)
        if head[:3] != b"CDF" or head[3] not in (1, 2):
            raise ValueError(f"{path} is not NetCDF classic")
        try:
            return _classic_variable(path, head, variable)
        except (struct.error, ValueError):
            if len(head) < size:
                raise
            size *= 4


def _classic_variable(path: str, head: bytes, variable: str) -> tuple[list[tuple[str, int]], np.dtype, int, dict]:
    at = 8

    def number(form: str = ">i") -> int:
        nonlocal at
        (v,) = struct.unpack_from(form, head, at)
        at += struct.calcsize(form)
        return v

    def text() -> str:
        nonlocal at
        n = number()
        s = head[at : at + n].decode()
        at += -(-n // 4) * 4
        return s

    def attributes() -> dict:
        nonlocal at
        number()
        out = {}
        for _ in range(number()):
            key, kind, n = text(), number(), number()
            size = np.dtype(NC_TYPES[kind]).itemsize * n
            raw = head[at : at + size]
            out[key] = raw.decode() if kind == 2 else np.frombuffer(raw, NC_TYPES[kind]).tolist()
            at += -(-size // 4) * 4
        return out

    number()
    dims = [(text(), number()) for _ in range(number())]
    attributes()
    number()
    for _ in range(number()):
        key = text()
        on = [dims[number()] for _ in range(number())]
        extra = attributes()
        kind, _, begin = number(), number(), number(">i" if head[3] == 1 else ">q")
        if key == variable:
            if any(n == 0 for _, n in on):
                raise ValueError(f"{variable} grows along a record dimension")
            return on, np.dtype(NC_TYPES[kind]), begin, extra
    raise ValueError(f"{variable} is not in {path}")


class _Rows(InputPartition):
    def __init__(self, a: int, b: int):
        self.a, self.b = a, b


class NetcdfReader(DataSourceReader):
    def __init__(self, path: str, variable: str, rows: int, window: str | None):
        self.path, self.rows = path, rows
        dims, self.kind, self.begin, extra = netcdf_variable(path, variable)
        if len(dims) != 2:
            raise ValueError(f"{variable} has {len(dims)} dimensions, not two")
        self.height, self.width = (n for _, n in dims)
        self.scale, self.offset = (float(extra.get(k, [d])[0]) for k, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
        self.none = extra.get("_FillValue", extra.get("missing_value", [None]))[0]
        self.bounds = Bounds(self.height, self.width, window)

    def partitions(self):
        lo, hi = self.bounds.z
        runs = [_Rows(max(a, lo), min(a + self.rows, hi)) for a in range(0, self.height, self.rows)]
        return [r for r in runs if r.a < r.b] or [_Rows(0, 0)]

    def read(self, p):
        row = self.width * self.kind.itemsize
        step = max(1, BATCH // self.width)
        with open(self.path, "rb") as f:
            for a in range(p.a, p.b, step):
                f.seek(self.begin + a * row)
                n, (lo, hi) = min(step, p.b - a), self.bounds.x
                raw = np.frombuffer(f.read(n * row), self.kind).reshape(n, self.width)[:, lo : max(lo, hi)]
                z, x = (g.ravel() for g in np.mgrid[:n, lo : max(lo, hi)].astype(np.int32))
                v = raw.astype(np.float64).ravel()
                gone = np.isnan(v) if self.none is None else np.isnan(v) | (v == self.none)
                yield pa.RecordBatch.from_arrays([pa.array(z + np.int32(a)), pa.array(x), pa.array(v * self.scale + self.offset, mask=gone)], names=["z", "x", "v"])


class NetcdfSource(DataSource):
    @classmethod
    def name(cls):
        return "netcdf_classic"

    def schema(self):
        return "z int, x int, v double"

    def reader(self, schema):
        return NetcdfReader(self.options["path"], self.options["variable"], int(self.options.get("stripe", "512")), self.options.get("window"))


def read_netcdf(spark: SparkSession, uri: str, stripe: int = 512, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(z, x, v) of a two-dimensional variable of a classic or NetCDF-4 file, named "NETCDF:path:variable"; missing cells are null. One partition for each ``stripe`` rows or so, of those that ``window`` (z0, x0, z1, x1) leaves."""
    path, variable = uri.split(":", 1)[1].rsplit(":", 1)
    with open(path, "rb") as f:
        if f.read(3) != b"CDF":  # NetCDF-4
            return read_hdf5(spark, path, variable, stripe, window=window)
    spark.dataSource.register(NetcdfSource)
    return spark.read.format("netcdf_classic").options(path=path, variable=variable, stripe=stripe, **option(window)).load()


# ---- settings, folders, releases


@dataclasses.dataclass(frozen=True)
class Settings:
    sea_level: int = 60
    least_depth: int = 50
    snowpack_warmest: float = 5.0
    width: int = 25600
    height: int = 25600


def settings(path: str) -> Settings:
    """The settings of a JSON file, those it lacks by default, and the file put right; a file that cannot be read gives the defaults and stays as it is."""
    made = Settings()
    if os.path.exists(path):
        try:
            found = json.loads(Path(path).read_text())
            made = Settings(**{f.name: type(f.default)(found.get(f.name, f.default)) for f in dataclasses.fields(Settings)})
        except (ValueError, TypeError, AttributeError):
            return Settings()
    _published(path, lambda part: Path(part).write_text(json.dumps(dataclasses.asdict(made), indent=2)) and None)
    return made


def map_folder(usual: str, override: str) -> str:
    """The folder that the file ``override`` names, which must exist; without that file the usual one, made if it is not there."""
    if not os.path.exists(override):
        os.makedirs(usual, exist_ok=True)
        return usual
    named = Path(override).read_text().strip()
    if not os.path.isdir(named):
        raise NotADirectoryError(f"{override} names {named}, which is no folder")
    return named


#: Two to four numbers, and a tag of words and numbers.
VERSION = r"^[0-9]+(\.[0-9]+){1,3}(-[0-9A-Za-z]+([.-][0-9A-Za-z]+)*)?$"


def is_version(column):
    return F.coalesce(column.rlike(VERSION), F.lit(False))


def release(target: str, root: str, files: Iterable[str], version: str) -> str:
    """A zip of files under ``root`` that is the same bytes whenever it is made: sorted, with one date and one mode."""
    if not re.fullmatch(VERSION, version):
        raise ValueError(f"{version!r} is no version")
    names = sorted(files)
    lost = [n for n in names if not os.path.isfile(os.path.join(root, n))]
    if lost:
        raise FileNotFoundError(", ".join(lost))

    def make(part: str) -> None:
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
            for n in names:
                entry = zipfile.ZipInfo(n)  # its date is that of the format's first day
                entry.external_attr, entry.create_system = 0o644 << 16, 3
                z.writestr(entry, Path(root, n).read_bytes(), zipfile.ZIP_DEFLATED, 9)

    return _published(target, make)
