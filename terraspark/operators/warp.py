"""Warps: a raster on another grid, in the same or another coordinate system.

The target is dealt into tiles. The outline of a tile, taken back to the source grid,
gives the window of source cells that its kernels reach; a source cell goes to the tiles
whose window holds it, once each, and a tile is computed from its window alone. So what
is shuffled is the source and a rim, and not a row for each weight of each target cell.

Within a tile the kernel is separable: where columns depend on columns only (the same
system, or degrees and web Mercator) it is two passes of weights along the axes; else the
weights of rows and columns are taken cell by cell. Either way value and weight sums are
carried side by side, so that cells without a value count for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspark.grid import Grid, transform
from terraspark.sources.tiles import windows

#: Target cells along a side of a tile, and source cells along a side of a tile's window at most.
SIDE, WINDOW = 256, 2048
#: Source cells along a side of the buckets that tiles and source cells meet in.
BUCKET = 256
METHODS = {"nearest": 0, "bilinear": 1, "cubic": 2}


def _triangle(d: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(d))


def _spline(d: np.ndarray) -> np.ndarray:
    a = np.abs(d)
    return np.where(a < 1, (4 - 6 * a * a + 3 * a * a * a) / 6, np.where(a < 2, (2 - a) ** 3 / 6, 0.0))


KERNELS = {"bilinear": _triangle, "cubic": _spline}


def source_place(source: Grid, target: Grid, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the target's world in cells of the source (row, column), cell middles at halves; outside of the other system's world they are infinite."""
    with np.errstate(all="ignore"):
        x, y = transform(*target.to_world(col, row), target.crs, source.crs, np)
        c, r = source.to_pixel(x, y)
    return np.where(np.isfinite(r), r, np.inf), np.where(np.isfinite(c), c, np.inf)


def _outline(z0, x0, z1, x1, points: int = 33) -> tuple[np.ndarray, np.ndarray]:
    z, x = np.linspace(z0, z1, points), np.linspace(x0, x1, points)
    return np.concatenate([np.full(points, z0), np.full(points, z1), z, z]), np.concatenate([x, x, np.full(points, x0), np.full(points, x1)])


def source_scale(source: Grid, target: Grid) -> tuple[float, float]:
    """Source cells to a target cell along rows and columns, over the whole target; at least 1."""
    r, c = source_place(source, target, *_outline(0, 0, target.height, target.width))
    r, c = r[np.isfinite(r)], c[np.isfinite(c)]
    if not len(r) or not len(c):
        raise ValueError("the target lies outside of the source's world")
    return max(1.0, float(np.ptp(r)) / target.height), max(1.0, float(np.ptp(c)) / target.width)


def _separable(source: Grid, target: Grid) -> bool:
    plain = {"EPSG:4326", "EPSG:3857"}
    straight = all(g.b == 0 and g.d == 0 for g in (source, target))
    return straight and (source.crs == target.crs or {source.crs, target.crs} <= plain)


def _axis(f: np.ndarray, lo: int, n: int, kernel, scale: float) -> np.ndarray:
    """Weights of a window's cells (columns) for target cells at ``f`` (rows)."""
    return kernel((np.arange(lo, lo + n)[None, :] - f[:, None]) / scale)


def compute(tile: np.ndarray, z: tuple[int, int], x: tuple[int, int], lo: tuple[int, int], source: Grid, target: Grid, method: str, scale: tuple[float, float]) -> np.ndarray:
    """The target cells [z), [x) from a window of source cells that begins at ``lo``; no value is NaN."""
    rows, cols = np.arange(*z) + 0.5, np.arange(*x) + 0.5
    if method == "nearest":
        r, c = source_place(source, target, *np.meshgrid(rows, cols, indexing="ij"))
        r, c = (np.floor(np.where(np.isfinite(v), v, -1e9)).astype(np.int64) - o for v, o in ((r, lo[0]), (c, lo[1])))
        inside = (r >= 0) & (r < tile.shape[0]) & (c >= 0) & (c < tile.shape[1])
        return np.where(inside, tile[np.where(inside, r, 0), np.where(inside, c, 0)], np.nan)
    valid = np.isfinite(tile)
    value = np.where(valid, tile, 0.0)
    kernel, radius = KERNELS[method], METHODS[method]
    if _separable(source, target):
        r = source_place(source, target, rows, np.full(len(rows), cols[0]))[0] - 0.5
        c = source_place(source, target, np.full(len(cols), rows[0]), cols)[1] - 0.5
        wr, wc = (np.where(np.isfinite(f)[:, None], _axis(np.where(np.isfinite(f), f, -1e9), o, n, kernel, s), 0.0) for f, o, n, s in ((r, lo[0], tile.shape[0], scale[0]), (c, lo[1], tile.shape[1], scale[1])))
        total, weight = wr @ (value @ wc.T), wr @ (valid.astype(float) @ wc.T)
    else:
        r, c = source_place(source, target, *np.meshgrid(rows, cols, indexing="ij"))
        r, c = (np.where(np.isfinite(v), v - 0.5, -1e9) for v in (r, c))
        total, weight = np.zeros(r.shape), np.zeros(r.shape)
        first_r, first_c = np.ceil(r - radius * scale[0]).astype(np.int64), np.ceil(c - radius * scale[1]).astype(np.int64)
        for i in range(int(2 * radius * scale[0]) + 1):
            zi = first_r + i
            wz = kernel((zi - r) / scale[0])
            in_z = (zi >= lo[0]) & (zi < lo[0] + tile.shape[0]) & (wz > 0)
            for j in range(int(2 * radius * scale[1]) + 1):
                xj = first_c + j
                w = wz * kernel((xj - c) / scale[1])
                at = np.flatnonzero(in_z & (xj >= lo[1]) & (xj < lo[1] + tile.shape[1]) & (w > 0))
                a, b, k = zi.ravel()[at] - lo[0], xj.ravel()[at] - lo[1], w.ravel()[at]
                total.ravel()[at] += k * value[a, b]
                weight.ravel()[at] += k * valid[a, b]
    with np.errstate(all="ignore"):
        return np.where(weight > 0, total / weight, np.nan)


def warp(raster: DataFrame, source: Grid, target: Grid, value: str = "v", method: str = "bilinear", window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(z, x, value) of a raster on another grid: nearest, bilinear or cubic spline, by valid (non-null) source cells; null where there are none.

    Systems are EPSG:4326, web Mercator and the UTM zones. Where target cells are larger than source
    cells the kernel is widened, so that all of them count. ``window``: (z0, x0, z1, x1) of the
    target to read; only source cells it needs are. Kernels give doubles, nearest keeps the type.
    """
    spark = raster.sparkSession
    radius = METHODS[method]
    scale = source_scale(source, target)
    side = max(16, min(SIDE, int(WINDOW / max(scale))))
    z0, x0, z1, x1 = window or (0, 0, target.height, target.width)
    shape = "tz int, tx int, z0 int, x0 int, z1 int, x1 int, s0 int, c0 int, s1 int, c1 int"

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles -> tiles with their windows of the source; those without one have an empty window."""
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                r, c = source_place(source, target, *_outline(t["z0"], t["x0"], t["z1"], t["x1"]))
                r, c = r[np.isfinite(r)], c[np.isfinite(c)]
                box = [0, 0, 0, 0]
                if len(r) and len(c):
                    # the outline is sampled: between two points it stays within a cell or so
                    edge = [radius * s + 2 for s in scale]
                    box = [max(0, int(np.floor(r.min() - edge[0]))), max(0, int(np.floor(c.min() - edge[1]))), min(source.height, int(np.ceil(r.max() + edge[0])) + 1), min(source.width, int(np.ceil(c.max() + edge[1])) + 1)]
                    if box[0] >= box[2] or box[1] >= box[3]:
                        box = [0, 0, 0, 0]
                out.append([t[k] for k in ("rz", "rx", "z0", "x0", "z1", "x1")] + box)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()) for v in zip(*out, strict=True)] if out else [pa.array([], pa.int32())] * 10, names=[f.split()[0] for f in shape.split(", ")])

    tiles = windows(spark, target.width, target.height, side)
    if window:
        cut = lambda c, least, most: F.least(F.greatest(F.col(c), F.lit(least)), F.lit(most)).alias(c)
        tiles = tiles.select("rz", "rx", cut("z0", z0, z1), cut("x0", x0, x1), cut("z1", z0, z1), cut("x1", x0, x1)).filter("z0 < z1 AND x0 < x1")
    tiles = tiles.mapInArrow(reach, shape)
    low = lambda c: F.floor(F.col(c) / BUCKET).cast("int")
    last = lambda c: F.floor((F.col(c) - 1) / BUCKET).cast("int")
    needs = tiles.filter("s0 < s1 AND c0 < c1").withColumn("_bz", F.explode(F.sequence(low("s0"), last("s1")))).withColumn("_bx", F.explode(F.sequence(low("c0"), last("c1"))))
    cells = raster.filter(F.col(value).isNotNull()).select(F.col("z").alias("sz"), F.col("x").alias("sx"), F.col(value).cast("double").alias("_v"), low("z").alias("_bz"), low("x").alias("_bx"))
    met = cells.join(needs, ["_bz", "_bx"]).filter("sz >= s0 AND sz < s1 AND sx >= c0 AND sx < c1").drop("_bz", "_bx")
    # a row without a value for every tile, so that those without source cells are there too
    given = met.unionByName(tiles.select(F.lit(None).cast("int").alias("sz"), F.lit(None).cast("int").alias("sx"), F.lit(None).cast("double").alias("_v"), "*"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        z_lo, x_lo, z_hi, x_hi, s_lo, c_lo, s_hi, c_hi = (t.column(k)[0].as_py() for k in ("z0", "x0", "z1", "x1", "s0", "c0", "s1", "c1"))
        block = np.full((max(s_hi - s_lo, 1), max(c_hi - c_lo, 1)), np.nan)
        t = t.filter(pa.compute.is_valid(t.column("_v")))
        block[t.column("sz").to_numpy() - s_lo, t.column("sx").to_numpy() - c_lo] = t.column("_v").to_numpy()
        found = compute(block, (z_lo, z_hi), (x_lo, x_hi), (s_lo, c_lo), source, target, method, scale)
        z, x = np.mgrid[z_lo:z_hi, x_lo:x_hi].astype(np.int32)
        return pa.table({"z": z.ravel(), "x": x.ravel(), "_v": pa.array(found.ravel(), from_pandas=True)})

    got = given.groupBy("tz", "tx").applyInArrow(run, "z int, x int, _v double")
    kind = raster.schema[value].dataType if method == "nearest" else "double"
    return got.select("z", "x", F.col("_v").cast(kind).alias(value))
