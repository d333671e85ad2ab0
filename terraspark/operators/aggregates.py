"""Zonal and global aggregates. Each is a partial and a final aggregate, or a window within one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_global(df: DataFrame, **aggs: Column) -> DataFrame:
    """Every row with the one-row aggregates: the single row is what is sent to all."""
    one = df.agg(*(v.alias(k) for k, v in aggs.items()))
    return df.crossJoin(F.broadcast(one))


def lower_median(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Lower median of a byte-valued column: counts per value first, so a group is at most 256 rows."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*by)
    n = n.withColumn("_c", F.sum("_n").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("_t", F.sum("_n").over(w))
    return n.filter(F.col("_c") >= F.floor((F.col("_t") + 1) / 2)).groupBy(*by).agg(F.min(value).alias(out))


def footprint_mean(cells: DataFrame, value: str, out: str, spacing: int, samples_z: int | None, samples_x: int | None, n: str | None = None) -> DataFrame:
    """Mean over the cells nearest to each sample: blocks of ``spacing``, shifted by half, clipped at the map (None: as far as there are cells); ``n``: name for the number of cells."""
    sz, sx = F.floor((F.col("z") + spacing // 2) / spacing), F.floor((F.col("x") + spacing // 2) / spacing)
    s = cells.select(sz.cast("int").alias("sz"), sx.cast("int").alias("sx"), value)
    for c, limit in (("sz", samples_z), ("sx", samples_x)):
        s = s if limit is None else s.filter(F.col(c) < limit)
    return s.groupBy("sz", "sx").agg(F.avg(value).alias(out), *([F.count(F.lit(1)).alias(n)] if n else []))


def lapse_rate(cells: DataFrame, height: str, temperature: str, size: int = 21) -> DataFrame:
    """One row: regression through the origin of local anomalies, between -0.5 and 0; 0 if the heights don't vary."""
    from terraspark.operators.stencil import focal, mean

    df = focal(cells, [height, temperature], size // 2, {"_hm": "double", "_tm": "double"}, lambda p, here: {"_hm": mean(p[height], here, size), "_tm": mean(p[temperature], here, size)})
    h, t = F.col(height) - F.col("_hm"), F.col(temperature) - F.col("_tm")
    return df.agg(F.sum(h * t).alias("ht"), F.sum(h * h).alias("hh")).select(F.when(F.col("hh") < 1e-6, 0.0).otherwise(F.least(F.greatest(F.col("ht") / F.col("hh"), F.lit(-0.5)), F.lit(0.0))).alias("lapse"))


def group_min(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Each row with its group's least value: aggregated first, so that a hot group is one row to join."""
    return df.join(df.groupBy(*by).agg(F.min(value).alias(out)), by)


def argmin(df: DataFrame, by: list[str], value: str, order: list[str], out: str) -> DataFrame:
    """Per group the row (as columns of ``order``) of least value, first in ``order`` on ties."""
    m = df.groupBy(*by).agg(F.min(F.struct(value, *order)).alias("_m"))
    return m.select(*by, F.col("_m")[value].alias(out), *(F.col("_m")[c].alias(c) for c in order))


def annual_sum(months: DataFrame, by: list[str], value: str, out: str, top: int = 65535, order: str | None = None) -> DataFrame:
    """Sum of monthly values, negative ones as 0, rounded half to even and clipped; ``order``: the months' order, for a sum whose last bits don't depend on the shuffle."""
    if order is None:
        s = months.groupBy(*by).agg(F.sum(F.greatest(F.col(value), F.lit(0.0))).alias("_s"))
    else:
        m = months.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_m"))
        s = m.select(*by, F.aggregate("_m", F.lit(0.0), lambda a, r: a + F.greatest(r[value], F.lit(0.0))).alias("_s"))
    return s.select(*by, F.rint(F.least(F.greatest("_s", F.lit(0.0)), F.lit(float(top)))).cast("int").alias(out))


def annual_mean(months: DataFrame, by: list[str], value: str, out: str, order: str = "month") -> DataFrame:
    """Sum of twelfths in single precision, month after month: a group is at most twelve rows."""
    m = months.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.col(value).cast("float").alias("v")))).alias("_m"))
    add = lambda a, r: (a + (r["v"] / F.lit(12.0)).cast("float")).cast("float")
    return m.select(*by, F.aggregate("_m", F.lit(0.0).cast("float"), add).alias(out))


def own_banks(candidates: DataFrame, water: DataFrame) -> DataFrame:
    """Of (z, x, lake, distance) one row per dry cell: the least distance, the first lake on ties; cells of ``water`` never count."""
    dry = candidates.join(water.select("z", "x").distinct(), ["z", "x"], "left_anti")
    return dry.groupBy("z", "x").agg(F.min(F.struct("distance", "lake")).alias("_m")).select("z", "x", "_m.lake", "_m.distance")


def ordered_digest(tiles: DataFrame, by: list[str], order: list[str], data: str, out: str) -> DataFrame:
    """SHA-256 over the SHA-256 of each part, in order: parts are hashed where they lie, only digests meet."""
    parts = tiles.select(*by, F.struct(*order, F.sha2(F.col(data), 256).alias("_d")).alias("_p"))
    return parts.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("_p")), lambda p: p["_d"]), ""), 256).alias(out))
