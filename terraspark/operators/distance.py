"""Nearest-source operators: exact Euclidean fill over the whole map, and bounded searches."""

from __future__ import annotations



import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _envelope(gap: np.ndarray, z: np.ndarray) -> np.ndarray:
    """For each z the index whose parabola gap**2 + (z - z_i)**2 is lowest; the first of equals. gap < 0: no source in that row."""
    have = np.flatnonzero(gap >= 0)
    if not len(have):
        return np.full(len(z), -1)
    hull: list[int] = []
    cut: list[float] = []
    g2 = gap.astype(np.float64) ** 2
    for q in have:
        while hull:
            p = hull[-1]
            s = ((g2[q] + z[q] ** 2) - (g2[p] + z[p] ** 2)) / (2.0 * (z[q] - z[p]))
            if len(hull) > 1 and s < cut[-1]:
                hull.pop()
                cut.pop()
            else:
                break
        if hull:
            cut.append(s)
        hull.append(q)
    return np.array(hull)[np.searchsorted(np.array(cut), z, side="left")]


def nearest_source(cells: DataFrame, source: str) -> DataFrame:
    """``cells`` (z, x dense, integers) with nz, nx: the nearest cell whose ``source`` is true, by Euclidean distance.

    Rows first, by windows; then one lower envelope per column, in a grouped kernel
    that holds a single column. Ties: the lesser x in a row, the lesser z in a column.
    Without any source both are null.
    """
    row = W.partitionBy("z").orderBy("x")
    here = F.when(F.col(source), F.col("x"))
    # the right one from behind: a frame that ends with the row is added to, one that starts with it is read anew for each row
    left = F.last(here, True).over(row.rowsBetween(W.unboundedPreceding, 0))
    right = F.last(here, True).over(W.partitionBy("z").orderBy(F.desc("x")).rowsBetween(W.unboundedPreceding, 0))
    # only keys and the row's nearest travel; the other columns are joined back
    rows = cells.select("z", "x", left.alias("_l"), right.alias("_r"))
    pick = F.when(F.col("_r").isNull() | (F.col("x") - F.col("_l") <= F.col("_r") - F.col("x")), F.col("_l")).otherwise(F.col("_r"))
    rows = rows.select(F.col("z").cast("int").alias("z"), F.col("x").cast("int").alias("x"), pick.cast("int").alias("_c"))

    def column(t: pa.Table) -> pa.Table:
        z = t.column("z").to_numpy()
        order = np.argsort(z, kind="stable")
        z, x = z[order], t.column("x").to_numpy()[order]
        c = t.column("_c").to_pandas().to_numpy(dtype="float64")[order]
        at = _envelope(np.where(np.isnan(c), -1, np.abs(np.nan_to_num(c) - x)), z.astype(np.float64))
        none = at < 0
        nz, nx = z[at], np.nan_to_num(c[at]).astype(np.int32)
        return pa.table({"z": z, "x": x, "nz": pa.array(nz, mask=none), "nx": pa.array(nx, mask=none)})

    found = rows.groupBy("x").applyInArrow(column, "z int, x int, nz int, nx int")
    return cells.join(found, ["z", "x"])


def fill_nearest(cells: DataFrame, value: str, out: str) -> DataFrame:
    """Nulls take the value of the nearest cell that has one."""
    known = cells.withColumn("_k", F.col(value).isNotNull())
    found = nearest_source(known, "_k")
    src = cells.select(F.col("z").alias("nz"), F.col("x").alias("nx"), F.col(value).alias(out))
    return found.join(src, ["nz", "nx"], "left").drop("_k", "nz", "nx")


def ring(radius: int, round_: bool = True) -> list[tuple[int, int]]:
    return [(dz, dx) for dz in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if not round_ or dz * dz + dx * dx <= radius * radius]


def around(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """One row per cell and offset: (.., dz, dx, nz, nx). The number of offsets is fixed, so rows grow by a constant."""
    every = F.array(*(F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dx")) for a, b in offsets))
    out = cells.withColumn("_o", F.explode(every)).select("*", F.col("_o.dz").alias("dz"), F.col("_o.dx").alias("dx")).drop("_o")
    return out.withColumn("nz", F.col("z") + F.col("dz")).withColumn("nx", F.col("x") + F.col("dx"))


def near_flag(cells: DataFrame, flag: str, out: str, radius: int = 4) -> DataFrame:
    """Whether a flagged cell lies within a round neighbourhood: flagged cells are spread, then joined once."""
    spread = around(cells.filter(F.col(flag)).select("z", "x"), ring(radius)).select(F.col("nz").alias("z"), F.col("nx").alias("x")).distinct().withColumn(out, F.lit(True))
    return cells.join(spread, ["z", "x"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def nearest_within(cells: DataFrame, sources: DataFrame, radius: int, sz: float = 1.0, sx: float = 1.0) -> DataFrame:
    """(z, x, nz, nx, d2): the nearest of ``sources(z, x)`` within ``radius`` cells, cells being sz by sx large; ties by (z, x)."""
    s = around(sources.select(F.col("z"), F.col("x")), ring(radius, False))
    d2 = (F.col("dz") * sz) ** 2 + (F.col("dx") * sx) ** 2
    s = s.select(F.col("nz").alias("_z"), F.col("nx").alias("_x"), F.struct(d2.alias("d2"), F.col("z").alias("nz"), F.col("x").alias("nx")).alias("_m"))
    best = s.groupBy(F.col("_z").alias("z"), F.col("_x").alias("x")).agg(F.min("_m").alias("_m"))
    return cells.select("z", "x").join(best, ["z", "x"], "left").select("z", "x", "_m.nz", "_m.nx", "_m.d2")


def feather(cells: DataFrame, klass: str, land: str, out: str, height: int | None, width: int) -> DataFrame:
    """Classes along borders mixed by a hashed offset of up to four cells; water is neither changed nor sampled. ``height`` None: as far as there are cells.

    The offset depends on world cells only, so any tiling gives the same map.
    """
    from terraspark.functions.scalars import cell_hash

    from terraspark.operators.aggregates import with_global

    last = F.lit(height - 1) if height is not None else F.col("_last")
    n = cell_hash(F.col("x"), F.col("z"))
    byte = lambda k: F.shiftright(n, 8 * k).bitwiseAND(255) % 5
    df = cells if height is not None else with_global(cells, _last=F.max("z"))
    df = df.withColumn("_sx", F.least(F.greatest(F.col("x") + byte(0) + byte(1) - 4, F.lit(0)), F.lit(width - 1)))
    df = df.withColumn("_sz", F.least(F.greatest(F.col("z") + byte(2) + byte(3) - 4, F.lit(0)), last)).drop("_last")
    src = cells.select(F.col("z").cast("long").alias("_sz"), F.col("x").cast("long").alias("_sx"), F.when(F.col(land) != 0, F.col(klass)).otherwise(0).alias("_c"))
    df = df.withColumn("_sz", F.col("_sz").cast("long")).withColumn("_sx", F.col("_sx").cast("long")).join(src, ["_sz", "_sx"], "left")
    return df.withColumn(out, F.when((F.col(land) != 0) & (F.coalesce("_c", F.lit(0)) != 0), F.col("_c")).otherwise(F.col(klass))).drop("_sz", "_sx", "_c")




def fill_interpolated(cells: DataFrame, value: str, out: str, reach: int = 500) -> DataFrame:
    """``cells`` with ``out``: the value, or where it is null the mean of the nearest values to the left, right, above and below, at most ``reach`` cells away, weighed by the inverse of their distance; null where there are none.

    Each search is a window along a band of a row or a column, at least four times as long as
    the reach, with the values that lie within reach of it; so no task holds more than its
    bands, however long a column is, and an exchange serves both ways along a line.
    """
    band = 4 * max(reach, 256)
    found = cells.withColumn("_own", F.lit(True))
    for key, along, names in (("z", "x", ("_a", "_b")), ("x", "z", ("_c", "_d"))):
        here = F.floor(F.col(along) / band)
        # only values are of use to the bands beside their own
        beside = found.filter(F.col(value).isNotNull()).withColumn("_band", F.explode(F.sequence(F.floor((F.col(along) - reach) / band), F.floor((F.col(along) + reach) / band)))).filter(F.col("_band") != here)
        found = found.withColumn("_band", here).unionByName(beside.withColumn("_own", F.lit(False)))
        w = W.partitionBy(key, "_band")
        known = F.when(F.col(value).isNotNull(), F.struct(F.col(along).alias("at"), F.col(value).cast("double").alias("v")))
        # both from the start of a frame: one that starts with the row and ends with the line is read anew for each row
        for name, order in zip(names, (F.asc(along), F.desc(along))):
            found = found.withColumn(name, F.last(known, True).over(w.orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
        found = found.filter("_own").drop("_band")
    sides = [(F.col(n), F.abs(F.col(n)["at"] - F.col(c))) for n, c in (("_a", "x"), ("_b", "x"), ("_c", "z"), ("_d", "z"))]
    total = lambda part: sum((F.when((d > 0) & (d <= reach), part(n) / d).otherwise(0.0) for n, d in sides), F.lit(0.0))
    weight = total(lambda n: F.lit(1.0))
    mean = F.when(weight > 0, total(lambda n: n["v"]) / weight)
    return found.withColumn(out, F.coalesce(F.col(value).cast("double"), mean)).drop("_own", "_a", "_b", "_c", "_d")
