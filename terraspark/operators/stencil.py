"""Focal operators over dense cells (z, x, value), tile by tile.

Cells are dealt out to square tiles once; cells near a border go to the tiles beside it
too, a share of about 4 x margin / TILE. A kernel then sees a tile with its margin as
NumPy arrays, so a chain of filters (``focal`` with a kernel of several steps) is one
exchange, whatever the size of the map. Beyond the map there is nothing: least and
greatest skip it, medians and means repeat the border, differences don't count it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Cells to a side of a tile.
TILE = 256


class Plane:
    """Values of a tile with its margin, and where there are any."""

    def __init__(self, value: np.ndarray, valid: np.ndarray):
        self.value, self.valid = value, valid

    def filled(self, empty) -> np.ndarray:
        return np.where(self.valid, self.value, empty)


def _limits(kind: np.dtype) -> tuple:
    return (-np.inf, np.inf) if kind.kind == "f" else (False, True) if kind.kind == "b" else (np.iinfo(kind).min, np.iinfo(kind).max)


def _slide(a: np.ndarray, before: int, after: int, empty, fn) -> np.ndarray:
    """fn over frames of both axes, one after the other."""
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (before, after)
        wide = np.pad(a, pad, constant_values=empty)
        n = a.shape[axis]
        a = fn.reduce([wide.take(np.arange(k, k + n), axis) for k in range(before + after + 1)])
    return a


def least(p: Plane, size: int = 3) -> Plane:
    """Least over size x size cells; an even size reaches one further back."""
    top = _limits(p.value.dtype)[1]
    frame = size // 2, size - 1 - size // 2
    return Plane(_slide(p.filled(top), *frame, top, np.minimum), _slide(p.valid, *frame, False, np.logical_or))


def greatest(p: Plane, size: int = 3) -> Plane:
    low = _limits(p.value.dtype)[0]
    frame = size // 2, size - 1 - size // 2
    return Plane(_slide(p.filled(low), *frame, low, np.maximum), _slide(p.valid, *frame, False, np.logical_or))


def _bordered(p: Plane, here: np.ndarray, margin: int) -> tuple[np.ndarray, tuple[slice, slice]]:
    """The part on the map, its border repeated, and where that part lies."""
    rows, cols = np.flatnonzero(here.any(1)), np.flatnonzero(here.any(0))
    at = slice(rows[0], rows[-1] + 1), slice(cols[0], cols[-1] + 1)
    return np.pad(p.value[at], margin, mode="edge"), at


def median9(p: Plane, here: np.ndarray) -> Plane:
    """Median of 3 x 3 cells, the border repeated."""
    wide, at = _bordered(p, here, 1)
    h, w = wide.shape[0] - 2, wide.shape[1] - 2
    nine = np.sort(np.stack([wide[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0)[4]
    out = p.value.copy()
    out[at] = nine
    return Plane(out, here)


def mean(p: Plane, here: np.ndarray, size: int) -> Plane:
    """Mean of size x size cells (odd size), the border repeated."""
    wide, at = _bordered(Plane(p.value.astype(np.float64), p.valid), here, size // 2)
    total = wide
    for axis in (0, 1):
        n = total.shape[axis] - size + 1
        # added in one order everywhere, so that a tile's place does not change the sum
        total = sum((total.take(np.arange(k, k + n), axis) for k in range(1, size)), start=total.take(np.arange(n), axis)) / size
    out = np.zeros(p.value.shape)
    out[at] = total
    return Plane(out, here)


def beside4(p: Plane) -> list[Plane]:
    """What lies before and after a cell, in its row and in its column."""
    out = []
    for axis in (1, 0):
        for step in (1, -1):
            edge = [slice(None)] * 2
            edge[axis] = slice(0, 1) if step == 1 else slice(-1, None)
            valid = np.roll(p.valid, step, axis)
            valid[tuple(edge)] = False
            out.append(Plane(np.roll(p.value, step, axis), valid))
    return out


def focal(cells: DataFrame, inputs: list[str], margin: int, outs: dict[str, str], kernel: Callable[[dict[str, Plane], np.ndarray], dict[str, Plane]], size: int = TILE) -> DataFrame:
    """``cells`` with the columns ``outs`` (name: type), which the kernel makes of the planes ``inputs`` and of where there are cells; it looks at most ``margin`` cells away."""
    kept = [c for c in cells.columns if c not in outs]
    made = [StructField(k, next(iter(StructType.fromDDL(f"a {t}"))).dataType) for k, t in outs.items()]
    schema = StructType([cells.schema[c] for c in kept] + made)
    at = {c: kept.index(c) for c in ("z", "x", *inputs)}

    def run(key: tuple, t: pa.Table) -> pa.Table:
        tz, tx = (int(k.as_py()) for k in key)
        z, x = (t.column(at[c]).to_numpy().astype(np.int64) for c in ("z", "x"))
        z, x = z - (tz * size - margin), x - (tx * size - margin)
        shape = (size + 2 * margin,) * 2
        here = np.zeros(shape, bool)
        here[z, x] = True
        planes = {}
        for c in inputs:
            column = t.column(at[c]).combine_chunks()
            known = column.is_valid().to_numpy(zero_copy_only=False)
            v = column.fill_null(False if pa.types.is_boolean(column.type) else 0).to_numpy(zero_copy_only=False)
            value, valid = np.zeros(shape, v.dtype), np.zeros(shape, bool)
            value[z, x], valid[z, x] = v, known
            planes[c] = Plane(value, valid)
        found = kernel(planes, here)
        core = (z >= margin) & (z < size + margin) & (x >= margin) & (x < size + margin)
        z, x = z[core], x[core]
        own = t.select(range(len(kept))).filter(pa.array(core))
        arrays = []
        for f, kind in zip(made, target, strict=True):
            p = found[f.name]
            arrays.append(pa.array(p.value[z, x], mask=~p.valid[z, x]).cast(kind))
        return pa.table([*own.columns, *arrays], names=[*kept, *outs])

    from pyspark.sql.pandas.types import to_arrow_type

    target = [to_arrow_type(f.dataType) for f in made]
    dealt = halo(cells.select(*kept), size, margin).drop("core") if margin else cells.select(*kept, F.floor(F.col("z") / size).alias("tz"), F.floor(F.col("x") / size).alias("tx"))
    return dealt.groupBy("tz", "tx").applyInArrow(run, schema)


def _kind(cells: DataFrame, column: str) -> str:
    return cells.schema[column].dataType.simpleString()


def min_filter(cells: DataFrame, value: str, out: str, size: int = 3) -> DataFrame:
    return focal(cells, [value], size // 2, {out: _kind(cells, value)}, lambda p, here: {out: least(p[value], size)})


def max_filter(cells: DataFrame, value: str, out: str, size: int = 3) -> DataFrame:
    return focal(cells, [value], size // 2, {out: _kind(cells, value)}, lambda p, here: {out: greatest(p[value], size)})


def median3(cells: DataFrame, value: str, out: str) -> DataFrame:
    """Median of 3 x 3 cells, the border repeated."""
    return focal(cells, [value], 1, {out: _kind(cells, value)}, lambda p, here: {out: median9(p[value], here)})


def mean_filter(cells: DataFrame, value: str, out: str, size: int) -> DataFrame:
    """Mean of size x size cells (odd size), the border repeated."""
    return focal(cells, [value], size // 2, {out: "double"}, lambda p, here: {out: mean(p[value], here, size)})


def touching(p: Plane, here: np.ndarray) -> Plane:
    on = p.value & p.valid
    return Plane(np.logical_or.reduce([on, *(q.value & q.valid for q in beside4(Plane(on, here)))]), here)


def dilate4(cells: DataFrame, flag: str, out: str) -> DataFrame:
    """True where a cell or one of its four neighbours is true."""
    return focal(cells, [flag], 1, {out: "boolean"}, lambda p, here: {out: touching(p[flag], here)})


def slope(cells: DataFrame, value: str, out: str) -> DataFrame:
    """Greatest difference to the four neighbours; those outside don't count."""

    def run(p, here):
        v = p[value]
        return {out: Plane(np.maximum.reduce([np.where(q.valid, np.abs(q.value - v.value), 0) for q in beside4(v)]), here)}

    return focal(cells, [value], 1, {out: _kind(cells, value)}, run)


def opening(cells: DataFrame, value: str, mask: str, out: str, size: int = 5) -> DataFrame:
    """Least, then greatest filter over masked cells only; never raises a value. Unmasked cells give null."""

    def run(p, here):
        on = p[mask].value & p[mask].valid & p[value].valid
        v = Plane(p[value].value, on)
        low = least(v, size)
        high = greatest(Plane(low.value, low.valid & on), size)
        return {out: Plane(np.minimum(v.value, high.value), on)}

    return focal(cells, [value, mask], 2 * (size // 2), {out: _kind(cells, value)}, run)


def floor_filter(cells: DataFrame, value: str, mask: str, out: str, size: int = 3) -> DataFrame:
    """Least of the masked cells around, for masked cells."""

    def run(p, here):
        v = Plane(p[value].value, p[mask].value & p[mask].valid & p[value].valid)
        return {out: Plane(least(v, size).value, v.valid)}

    return focal(cells, [value, mask], size // 2, {out: _kind(cells, value)}, run)


def grade_banks(cells: DataFrame, height: str, water: str, level: str, out: str, rings: int = 3, slope_: int = 1) -> DataFrame:
    """Lowers dry banks ring by ring: the first ring takes the greatest level of the water it touches, later ones the least handed on."""

    def run(p, here):
        done = p[water].value & p[water].valid
        h = p[height].value.copy()
        handed = Plane(p[level].value, done & p[level].valid)
        for ring in range(1, rings + 1):
            near = beside4(handed)
            any_ = np.logical_or.reduce([q.valid for q in near])
            low, top = _limits(h.dtype)
            n = np.maximum.reduce([q.filled(low) for q in near]) if ring == 1 else np.minimum.reduce([q.filled(top) for q in near])
            new = here & ~done & any_
            h = np.where(new, np.minimum(h, np.where(new, n, 0) + ring * slope_), h)
            handed, done = Plane(n, new), done | new
        return {out: Plane(h, here & p[height].valid)}

    return focal(cells, [height, water, level], rings, {out: _kind(cells, height)}, run)


def capped(background: np.ndarray, cap: int, taxicab: bool = False) -> Plane:
    """Chessboard (or taxicab) distance to the nearest background cell up to ``cap``."""
    far = cap + 1
    d = np.where(background, 0, far)
    for axis in (1, 0):
        n = d.shape[axis]
        pad = [(0, 0), (0, 0)]
        pad[axis] = (cap, cap)
        wide = np.pad(d, pad, constant_values=far)
        parts = [wide.take(np.arange(cap + k, cap + k + n), axis) for k in range(-cap, cap + 1)]
        d = np.minimum.reduce([q + abs(k) if taxicab or axis == 1 else np.maximum(q, abs(k)) for q, k in zip(parts, range(-cap, cap + 1), strict=True)])
    return Plane(np.minimum(d, far), d <= cap)


def capped_distance(cells: DataFrame, background: str, cap: int, out: str, taxicab: bool = False) -> DataFrame:
    """Chessboard (or taxicab) distance to the nearest background cell up to ``cap``; null beyond it or where there is none.

    What lies outside the map is not background.
    """

    def run(p, here):
        d = capped(p[background].value & p[background].valid, cap, taxicab)
        return {out: Plane(d.value, d.valid & here)}

    return focal(cells, [background], cap, {out: "int"}, run)


def running_min(cells: DataFrame, way: str, order: str, value: str, out: str) -> DataFrame:
    return cells.withColumn(out, F.min(value).over(W.partitionBy(way).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def running_sum(cells: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    return cells.withColumn(out, F.sum(value).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def drop_repeats(cells: DataFrame, way: str, order: str, value: str) -> DataFrame:
    """Rows without those that repeat the one before."""
    return cells.withColumn("_p", F.lag(value).over(W.partitionBy(way).orderBy(order))).filter(~F.col(value).eqNullSafe(F.col("_p")) | F.col("_p").isNull()).drop("_p")


def halo(tiles: DataFrame, size: int, margin: int) -> DataFrame:
    """(tz, tx, core, z, x, ...): each cell in its own tile and in those whose halo it lies in; a margin wider than a tile is an error."""
    if margin > size:
        raise ValueError(f"a margin of {margin} cells reaches beyond the next tile of {size}")
    side = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - margin) / size), F.floor(F.col(c) / size), F.floor((F.col(c) + margin) / size)))
    out = tiles.withColumn("tz", F.explode(side("z"))).withColumn("tx", F.explode(side("x")))
    return out.withColumn("core", (F.floor(F.col("z") / size) == F.col("tz")) & (F.floor(F.col("x") / size) == F.col("tx")))


def depth_from_distance(distance: Column, low: int, high: int) -> Column:
    """Depth by distance to the shore: clipped; no shore at all gives the least depth only where none exists."""
    return F.coalesce(F.least(F.greatest(distance, F.lit(low)), F.lit(high)), F.lit(high))
