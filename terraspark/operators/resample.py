"""Resampling: exact byte resizes with integer weights, and interpolation with valid weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 22


def _line(cells: DataFrame, axis: str, src: int | None, dst: int) -> DataFrame:
    """(i, _n): the target's cells along an axis, and the source's extent; None takes it from the cells, as one row that goes along."""
    spark = cells.sparkSession
    one = spark.range(1).select(F.lit(src).alias("_n")) if src is not None else cells.agg((F.max(axis) + 1).cast("int").alias("_n"))
    return spark.range(dst).select(F.col("id").cast("int").alias("i")).crossJoin(F.broadcast(one))


def resize_nearest(cells: DataFrame, value: str, src: tuple[int | None, int | None], dst: tuple[int, int]) -> DataFrame:
    """(z, x, value) at another size, every target cell from the source cell under its middle."""
    at = lambda m: F.least(F.floor((F.col("i") + 0.5) * (F.col("_n") / F.lit(m))), F.col("_n") - 1).cast("int")
    side = lambda axis, n, m: _line(cells, axis, n, m).select(F.col("i").alias(axis), at(m).alias(f"_s{axis}"))
    by_row = cells.select(F.col("z").alias("_sz"), F.col("x").alias("_sx"), value).join(side("z", src[0], dst[0]), "_sz")
    return by_row.join(side("x", src[1], dst[1]), "_sx").select("z", "x", value)


def weights(cells: DataFrame, axis: str, src: int | None, dst: int) -> DataFrame:
    """(i, s, k): integer weights of a triangle filter, of 22 bits."""
    scale = F.col("_n") / F.lit(dst)
    t = _line(cells, axis, src, dst).select("i", "_n", ((F.col("i") + 0.5) * scale).alias("_c"), F.greatest(F.lit(1.0), scale).alias("_r"))
    lo = F.greatest(F.lit(0), F.floor(F.col("_c") - F.col("_r") + 0.5)).cast("int")
    hi = F.least(F.col("_n"), F.floor(F.col("_c") + F.col("_r") + 0.5)).cast("int")
    t = t.select("i", "_c", "_r", F.explode(F.sequence(lo, hi - 1)).alias("s"))
    t = t.withColumn("_w", F.greatest(F.lit(0.0), 1.0 - F.abs((F.col("s") - F.col("_c") + 0.5) / F.col("_r"))))
    total = t.groupBy("i").agg(F.sum("_w").alias("_t"))
    return t.join(total, "i").select("i", "s", F.floor(F.col("_w") / F.col("_t") * (1 << BITS) + 0.5).cast("long").alias("k")).filter("k <> 0")


def _pass(cells: DataFrame, value: str, axis: str, other: str, w: DataFrame) -> DataFrame:
    j = cells.join(w.withColumnRenamed("s", axis), axis).groupBy("i", other).agg(F.sum(F.col("k") * F.col(value)).alias("_v"))
    v = F.least(F.greatest(F.shiftright(F.col("_v") + (1 << (BITS - 1)), BITS), F.lit(0)), F.lit(255)).cast("int")
    return j.select(F.col("i").alias(axis), other, v.alias(value))


def resize_bilinear(cells: DataFrame, value: str, src: tuple[int | None, int | None], dst: tuple[int, int]) -> DataFrame:
    """Bytes at another size by a triangle filter: columns first, rounded to bytes, then rows. Exact integers; at the same size every weight is one."""
    c = cells.select("z", "x", F.col(value).cast("long").alias(value))
    mid = _pass(c, value, "x", "z", weights(c, "x", src[1], dst[1])) if src[1] != dst[1] else c
    out = _pass(mid, value, "z", "x", weights(c, "z", src[0], dst[0])) if src[0] != dst[0] else mid
    return out.select("z", "x", F.col(value).cast("int").alias(value))


def sample_bilinear(points: DataFrame, raster: DataFrame, value: str, out: str, height: int, width: int, clamp: bool = True) -> DataFrame:
    """``points(pid, fz, fx)`` in cell units, cell middles at integers: four corners, weighed by those that are valid (not null).

    With ``clamp`` corners beyond the edge are the edge; else they count as invalid.
    """
    return sample_fields(points, raster, {value: out}, height, width, clamp)


def sample_fields(points: DataFrame, raster: DataFrame, fields: dict[str, str], height: int, width: int, clamp: bool = True) -> DataFrame:
    """``sample_bilinear`` of several values at once (name in the raster: name in the result): corners are joined once, each field weighs those where it is valid."""
    z0, x0 = F.floor("fz").cast("int"), F.floor("fx").cast("int")
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dx")) for a in (0, 1) for b in (0, 1))))
    p = points.select("pid", "fz", "fx", corner.alias("_c")).withColumn("_tz", F.col("fz") - F.floor("fz")).withColumn("_tx", F.col("fx") - F.floor("fx"))
    weight = F.when(F.col("_c.dz") == 0, 1 - F.col("_tz")).otherwise(F.col("_tz")) * F.when(F.col("_c.dx") == 0, 1 - F.col("_tx")).otherwise(F.col("_tx"))
    z, x = z0 + F.col("_c.dz"), x0 + F.col("_c.dx")
    if clamp:
        z, x = F.least(F.greatest(z, F.lit(0)), F.lit(height - 1)), F.least(F.greatest(x, F.lit(0)), F.lit(width - 1))
    p = p.select("pid", z.alias("z"), x.alias("x"), weight.alias("_w"))
    known = F.coalesce(*(F.col(v).cast("string") for v in fields)).isNotNull()
    j = p.join(raster.filter(known).select("z", "x", *(F.col(v).alias(f"_v{i}") for i, v in enumerate(fields))), ["z", "x"])
    mean = lambda v: F.sum(F.col("_w") * F.col(v)) / F.nullif(F.sum(F.when(F.col(v).isNotNull(), F.col("_w"))), F.lit(0.0))
    s = j.groupBy("pid").agg(*(mean(f"_v{i}").alias(out) for i, out in enumerate(fields.values())))
    return points.join(s, "pid", "left")


def triangle(d):
    return F.greatest(F.lit(0.0), 1 - F.abs(d))


def cubic_spline(d):
    a = F.abs(d)
    return F.when(a < 1, (4 - 6 * a * a + 3 * a * a * a) / 6).when(a < 2, (2 - a) * (2 - a) * (2 - a) / 6).otherwise(0.0)


def sample_kernel(points: DataFrame, raster: DataFrame, value: str, out: str, kernel, radius: int, scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """``points(pid, fz, fx)`` in cell units, cell middles at integers: the mean of the valid cells around by a separable kernel of ``radius`` cells.

    ``scale`` (rows, columns): source cells to a target cell; above 1 the kernel is widened by it,
    so that shrinking averages all cells and does not alias. Points without a valid cell give null.
    """
    sz, sx = (max(1.0, s) for s in scale)
    side = lambda c, s: F.explode(F.sequence(F.ceil(F.col(c) - radius * s).cast("int"), F.floor(F.col(c) + radius * s).cast("int")))
    p = points.select("pid", "fz", "fx").withColumn("z", side("fz", sz)).withColumn("x", side("fx", sx))
    p = p.withColumn("_w", kernel((F.col("z") - F.col("fz")) / sz) * kernel((F.col("x") - F.col("fx")) / sx)).filter("_w > 0")
    j = p.join(raster.select("z", "x", value).filter(F.col(value).isNotNull()), ["z", "x"])
    s = j.groupBy("pid").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(out))
    return points.join(s, "pid", "left")


def sample_cubic(points: DataFrame, raster: DataFrame, value: str, out: str) -> DataFrame:
    """As sample_bilinear, with the 4 x 4 cubic B-spline kernel."""
    return sample_kernel(points, raster, value, out, cubic_spline, 2)
