"""Grids: projections in closed form, master grid, affine maps, bounds."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RADIUS = 6378137.0


@dataclass(frozen=True)
class Grid:
    """World = (a*col + b*row + c, d*col + e*row + f)."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float
    width: int
    height: int
    crs: str

    def scaled(self, width: int, height: int) -> Grid:
        """The same extent at another size."""
        sx, sy = self.width / width, self.height / height
        return Grid(self.a * sx, self.b * sy, self.c, self.d * sx, self.e * sy, self.f, width, height, self.crs)

    def to_world(self, col: Column, row: Column) -> tuple[Column, Column]:
        return self.a * col + self.b * row + self.c, self.d * col + self.e * row + self.f

    def to_pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        det = self.a * self.e - self.b * self.d
        dx, dy = x - self.c, y - self.f
        return (self.e * dx - self.b * dy) / det, (self.a * dy - self.d * dx) / det

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(getattr(self, n) for n in "abcdef") + (self.width, self.height, self.crs)], "a double, b double, c double, d double, e double, f double, width int, height int, crs string")


def choose_crs(lon_min: float, lon_max: float, lat_min: float, lat_max: float, forced: str | None = None) -> str:
    """The forced system, else the UTM zone of the middle for spans under 13 degrees, else web Mercator."""
    if forced:
        return forced
    if lon_max - lon_min < 13:
        zone = min(60, math.floor(((lon_min + lon_max) / 2 + 180) / 6) + 1)
        return f"EPSG:{(32600 if (lat_min + lat_max) / 2 >= 0 else 32700) + zone}"
    return "EPSG:3857"


def _krueger() -> tuple[float, list[float], float]:
    f = 1 / 298.257223563
    n = f / (2 - f)
    big = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    return big, [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240], 2 * math.sqrt(n) / (1 + n)


def _inverse_krueger() -> tuple[list[float], list[float]]:
    f = 1 / 298.257223563
    n = f / (2 - f)
    return [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480], [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]


def _utm(crs: str) -> tuple[int, float]:
    """Middle meridian and false northing of a UTM zone; other systems are an error."""
    code = int(crs.rpartition(":")[2])
    if not (32601 <= code <= 32660 or 32701 <= code <= 32760):
        raise ValueError(f"unsupported system {crs}")
    return code % 100 * 6 - 183, 1e7 if code > 32700 else 0.0


def project(lon, lat, crs: str, m=F):
    """Degrees to metres: web Mercator, or UTM by Krueger's series; EPSG:4326 stays. ``m``: functions of columns, or numpy for arrays."""
    if crs == "EPSG:4326":
        return lon, lat
    if crs == "EPSG:3857":
        return m.radians(lon) * RADIUS, m.log(m.tan(math.pi / 4 + m.radians(lat) / 2)) * RADIUS
    middle, northing = _utm(crs)
    big, alpha, k = _krueger()
    phi, lam = m.radians(lat), m.radians(lon - middle)
    t = m.sinh(m.atanh(m.sin(phi)) - k * m.atanh(k * m.sin(phi)))
    xi, eta = m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
        north = north + a * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
    return 500000 + 0.9996 * big * east, northing + 0.9996 * big * north


def unproject(x, y, crs: str, m=F):
    """Metres to degrees, the inverse of ``project``: UTM by the inverse series, to some millimetres within a zone."""
    if crs == "EPSG:4326":
        return x, y
    if crs == "EPSG:3857":
        return m.degrees(x / RADIUS), m.degrees(2 * m.atan(m.exp(y / RADIUS)) - math.pi / 2)
    middle, northing = _utm(crs)
    big = _krueger()[0]
    beta, delta = _inverse_krueger()
    xi, eta = (y - northing) / (0.9996 * big), (x - 500000) / (0.9996 * big)
    u, v = xi, eta
    for j, b in enumerate(beta, 1):
        u = u - b * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        v = v - b * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
    chi = m.asin(m.sin(u) / m.cosh(v))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * m.sin(2 * j * chi)
    return middle + m.degrees(m.atan2(m.sinh(v), m.cos(u))), m.degrees(phi)


def transform(x, y, source: str, target: str, m=F):
    """A place of one system in another."""
    return (x, y) if source == target else project(*unproject(x, y, source, m), target, m)


def unproject_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return unproject(x, y, "EPSG:3857")


def outline(spark: SparkSession, lon_min: float, lat_min: float, lon_max: float, lat_max: float, points: int = 21) -> DataFrame:
    """(lon, lat) along the edges of a box, each edge cut ``points`` times."""
    t = spark.range(points + 1).select((F.col("id") / points).alias("t"))
    lon, lat = lon_min + F.col("t") * (lon_max - lon_min), lat_min + F.col("t") * (lat_max - lat_min)
    edges = [(lon, F.lit(lat_min)), (lon, F.lit(lat_max)), (F.lit(lon_min), lat), (F.lit(lon_max), lat)]
    out = [t.select(a.cast("double").alias("lon"), b.cast("double").alias("lat")) for a, b in edges]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


def master_grid(spark: SparkSession, lon_min: float, lat_min: float, lon_max: float, lat_max: float, metres: float, crs: str) -> Grid:
    """North-up grid over a box: the projected outline's extent, sizes rounded up."""
    p = outline(spark, lon_min, lat_min, lon_max, lat_max)
    x, y = project(F.col("lon"), F.col("lat"), crs)
    r = p.select(x.alias("x"), y.alias("y")).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    return Grid(metres, 0.0, r[0], 0.0, -metres, r[3], math.ceil((r[1] - r[0]) / metres), math.ceil((r[3] - r[2]) / metres), crs)


def grid_bounds(spark: SparkSession, grid: Grid) -> tuple[float, float, float, float]:
    """(lon_min, lat_min, lon_max, lat_max) of a grid's four corners, in any system that ``project`` knows."""
    corners = spark.createDataFrame([(0.0, 0.0), (float(grid.width), 0.0), (0.0, float(grid.height)), (float(grid.width), float(grid.height))], "c double, r double")
    lon, lat = unproject(*grid.to_world(F.col("c"), F.col("r")), grid.crs)
    return tuple(corners.select(lon.alias("lon"), lat.alias("lat")).agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first())


mercator_bounds = grid_bounds
