"""Rasters, ways and features derived from the driver tables, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r1(spark: SparkSession, sf: str) -> DataFrame:
    """Dense raster (z, x, v) with the label of its row."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("z"), "label", F.posexplode("embedding").alias("x", "_e"))
    return e.select("z", "x", F.floor((F.col("_e").cast("double") + 1) * 127.5).cast("int").alias("v"), "label")


R1 = "r1 AS MATERIALIZED (SELECT CAST(vec_id AS INT) AS z, CAST(i - 1 AS INT) AS x, CAST(floor((CAST(embedding[i] AS DOUBLE) + 1) * 127.5) AS INT) AS v, label FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"


def r2(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse raster of 100 x 250 cells."""
    return table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 100).cast("int").alias("z"), (F.col("l_partkey") % 250).cast("int").alias("x")).agg(F.floor(F.sum("l_quantity")).cast("int").alias("v"))


R2 = "r2 AS MATERIALIZED (SELECT CAST(l_suppkey % 100 AS INT) AS z, CAST(l_partkey % 250 AS INT) AS x, CAST(floor(sum(l_quantity)) AS INT) AS v FROM lineitem GROUP BY 1, 2)"


def r3(spark: SparkSession, sf: str) -> DataFrame:
    """Planes of a map over R1."""
    v, label = F.col("v"), F.col("label")
    lake = v >= 140
    land = (v >= 120) | lake
    river = land & ~lake & (label % 3 == 0) & F.col("x").between(16, 40)
    return r1(spark, sf).select(
        "z", "x", v.alias("height"), F.when(land, 255).otherwise(0).alias("land"), lake.alias("lake"), river.alias("river"),
        F.when(lake, F.when(label % 2 == 0, 128).otherwise(255)).otherwise(0).alias("lake_mask"), (1 + v % 12).alias("lake_depth"), (45 + v % 20).alias("bathy"),
        (v - 1).alias("river_surface"), (1 + v % 3).alias("river_depth"), (1 + v % 32).alias("vegetation"),
    )


R3 = (
    R1
    + """, r3 AS MATERIALIZED (SELECT z, x, v AS height, CASE WHEN v >= 120 THEN 255 ELSE 0 END AS land, v >= 140 AS lake, v >= 120 AND v < 140 AND label % 3 = 0 AND x BETWEEN 16 AND 40 AS river,
 CASE WHEN v >= 140 THEN CASE WHEN label % 2 = 0 THEN 128 ELSE 255 END ELSE 0 END AS lake_mask, 1 + v % 12 AS lake_depth, 45 + v % 20 AS bathy, v - 1 AS river_surface, 1 + v % 3 AS river_depth, 1 + v % 32 AS vegetation FROM r1)"""
)


def r4(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered ways (way, ord, cell, level)."""
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("way"), F.row_number().over(w).alias("ord"), F.col("l_partkey").alias("cell"), F.floor("l_quantity").cast("int").alias("level"))


R4 = "r4 AS MATERIALIZED (SELECT l_orderkey AS way, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS ord, l_partkey AS cell, CAST(floor(l_quantity) AS INT) AS level FROM lineitem)"


def r5(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly means (sample, month, t); months may be missing.

    Values have two decimals, so many means lie halfway between two numbers of four decimals
    and the last bits of the sum decide: it is taken in the order of events, and rounded as in
    DuckDB, by 10,000 times the mean.
    """
    from pyspark.sql import Window as W

    e = table(spark, sf, "events").select(F.col("user_id").alias("sample"), (1 + (F.dayofmonth("ts") - 1) % 12).alias("month"), "event_id", "ts", "value")
    w = W.partitionBy("sample", "month").orderBy("event_id", "ts", "value").rowsBetween(W.unboundedPreceding, 0)
    e = e.select("sample", "month", F.sum("value").over(w).alias("_s"), F.count("value").over(w).alias("_n"), F.row_number().over(w).alias("_k"))
    mean = F.max_by("_s", "_k") / F.max("_n")
    return e.groupBy("sample", "month").agg((F.round(mean * 10000) / 10000).alias("t"))


R5 = "r5 AS (SELECT user_id AS sample, CAST(1 + (day(ts) - 1) % 12 AS INT) AS month, round(avg(value), 4) AS t FROM events GROUP BY 1, 2)"


def r6(spark: SparkSession, sf: str) -> DataFrame:
    """Points with a biome and climate (part, biome, warmest, annual, wet)."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("part"), (F.col("p_size") % 33).cast("int").alias("biome"), (k % 35 - 2).cast("double").alias("warmest"), (k % 50 - 18).cast("double").alias("annual"), ((k % 101) / 100.0).alias("wet"))


R6 = "r6 AS (SELECT p_partkey AS part, CAST(p_size % 33 AS INT) AS biome, CAST(p_partkey % 35 - 2 AS DOUBLE) AS warmest, CAST(p_partkey % 50 - 18 AS DOUBLE) AS annual, (p_partkey % 101) / 100.0::DOUBLE AS wet FROM part)"


def r7(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of 5 x 5 cells (id, x0, z0)."""
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 50).cast("int").alias("x0"), ((F.col("s_suppkey") * 7) % 400).cast("int").alias("z0"))


R7 = "r7 AS (SELECT s_suppkey AS id, CAST(s_suppkey % 50 AS INT) AS x0, CAST((s_suppkey * 7) % 400 AS INT) AS z0 FROM supplier)"
R7_CELLS = R7 + ", r7c AS MATERIALIZED (SELECT id, CAST(z0 + a AS INT) AS z, CAST(x0 + b AS INT) AS x FROM r7, (SELECT unnest(range(0, 5)) AS a), (SELECT unnest(range(0, 5)) AS b))"


def r8(spark: SparkSession, sf: str) -> DataFrame:
    """Tile requests in order (player, tile, release, event)."""
    return table(spark, sf, "events").select(F.col("user_id").alias("player"), (F.col("event_id") % 40).cast("int").alias("tile"), (F.col("event_type") == "error").alias("release"), F.col("event_id").alias("event"), "ts")


R8 = "r8 AS (SELECT user_id AS player, CAST(event_id % 40 AS INT) AS tile, event_type = 'error' AS release, event_id AS event, ts FROM events)"
