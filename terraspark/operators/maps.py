"""Compositions: coast, lakes, vegetation, surface, rivers and columns of a map of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspark.functions import scalars as S
from terraspark.operators import stencil as T

# Biome, forest, shrub, grass, fertility, soil depth, bare.
PROFILES = [
    (1, 245, 35, 0.15, 0.65, 4, False), (2, 225, 55, 0.30, 0.65, 4, False), (3, 175, 90, 0.55, 0.65, 3, False), (4, 225, 45, 0.30, 0.65, 4, False), (7, 245, 55, 0.35, 0.65, 4, False),
    (8, 225, 35, 0.30, 0.35, 3, False), (9, 230, 50, 0.35, 0.65, 4, False), (13, 220, 50, 0.40, 0.65, 4, False), (14, 180, 65, 0.45, 0.35, 3, False), (15, 205, 45, 0.30, 0.35, 3, False),
    (16, 95, 155, 0.65, 0.35, 2, False), (17, 120, 110, 0.60, 0.35, 2, False), (18, 70, 110, 0.90, 0.35, 2, False), (19, 80, 110, 0.85, 0.35, 2, False), (20, 35, 155, 0.45, 0.10, 1, True),
    (22, 5, 70, 0.95, 0.35, 2, False), (27, 0, 25, 0.10, 0.10, 1, True), (28, 0, 40, 0.75, 0.10, 1, False), (30, 0, 130, 0.45, 0.10, 1, False), (31, 0, 170, 0.40, 0.10, 1, False), (32, 0, 80, 0.35, 0.10, 1, False),
]
# Classes of water bodies that count as natural lakes, and biomes in which trees make a forest floor.
NATURAL = ["Lake", "Alkaline Lake"]
FOREST_FLOOR = [1, 2, 3, 4, 7, 8, 9, 13, 14, 15, 17]


def profiles(spark: SparkSession) -> DataFrame:
    """The dimension of biomes: 21 rows."""
    return spark.createDataFrame(PROFILES, "biome int, forest0 int, shrub0 int, grass0 double, fertility0 double, soil0 int, bare boolean")


def vegetation_profile(cells: DataFrame, biome: str = "biome", warmest: str = "warmest", annual: str = "annual", wet: str = "wet", snow_line: float = 5.0) -> DataFrame:
    """Adds forest, shrub, grass, fertility, soil, bare, snow; biomes that aren't listed have none of them, nor has a cell whose climate is not finite."""
    df = cells.join(F.broadcast(profiles(cells.sparkSession).withColumnRenamed("biome", "_b")), F.col(biome) == F.col("_b"), "left").drop("_b")
    w, a, m = F.col(wet), F.col(annual), F.col(warmest)
    grow = F.least(S.smoothstep(snow_line, 12.0, m), S.smoothstep(-18.0, -2.0, a), 1.0 - S.smoothstep(32.0, 42.0, a))
    known = S.finite(m) & S.finite(a) & S.finite(w)
    u, none, snow = S.smoothstep(0.015, 0.25, w), F.col("forest0").isNull() | ~known, m < snow_line
    fert = F.when(snow | (w < 0.08), 0.10).when((F.col("fertility0") > 0.35) & (w < 0.20), 0.35).otherwise(F.col("fertility0"))
    soil = F.when(snow | (w < 0.04), F.least("soil0", F.lit(1))).otherwise(F.col("soil0"))
    zero = lambda c, v: F.when(none, F.lit(v)).otherwise(c)
    return (
        df.withColumn("forest", zero(F.when(m < 10, 0).otherwise(S.scale_byte(F.col("forest0"), grow * S.smoothstep(0.07, 0.55, w))), 0))
        .withColumn("shrub", zero(S.scale_byte(F.col("shrub0"), grow * (0.35 + 0.65 * u)), 0))
        .withColumn("grass", zero(F.col("grass0") * grow * u, 0.0))
        .withColumn("fertility", zero(fert, 0.0))
        .withColumn("soil", zero(soil, 0))
        .withColumn("bare", F.coalesce(F.col("bare") & known, F.lit(False)))
        .withColumn("snow", zero(snow, False))
        .drop("forest0", "shrub0", "grass0", "fertility0", "soil0")
    )


def vegetation_density(cells: DataFrame, plane: str, **columns) -> DataFrame:
    """``cells`` with column ``plane`` (forest or shrub): the profile's density on dry land of the map, 0 on water and where there is no climate.

    cells hold land, lake_mask, river, inside (boolean) and what ``vegetation_profile`` reads.
    """
    kept = cells.columns
    p = vegetation_profile(cells, **columns)
    dry = F.col("inside") & (F.col("land") != 0) & (F.col("lake_mask") == 0) & (F.col("river") == 0)
    return p.select(*(c for c in kept if c != plane), F.when(F.coalesce(dry, F.lit(False)), F.col(plane)).otherwise(0).alias(plane))


def trees_grow(warmest: Column) -> Column:
    """Trees need a warmest month of 10 degrees; without a climate they grow."""
    return F.coalesce(warmest >= 10, F.lit(True))


def surface_materials(spark: SparkSession, rocks: list[str], present: list[str]) -> DataFrame:
    """(rock, gravel, sand): what lies on a rock; the rock itself where the world has no such block."""
    have = set(present)
    rows = [(r, *(f"{k}-{r}" if f"{k}-{r}" in have else f"rock-{r}" for k in ("gravel", "sand"))) for r in rocks]
    return spark.createDataFrame(rows, "rock string, gravel string, sand string")


def snow_balance(hours: DataFrame, since: Column) -> DataFrame:
    """(z, x, snow): snow gathered and melted over the hours(z, x, hour, temperature, rain) after ``since``, the hour of the last update."""
    rate = S.snow_rate(F.col("temperature"), F.col("rain"))
    return hours.filter(F.col("hour") > since).groupBy("z", "x").agg(F.sum(rate).alias("snow"))


def climate_report(c: DataFrame, snowpack: float = 5.0, growing: float = 5.0) -> Column:
    """Text about a place's climate: annual, warmest, p, pet, wet and months (array of 12) by column."""
    f = lambda n, v: F.format_string(f"%.{n}f", v.cast("double"))
    p, pet, wet, warm = F.col("p"), F.col("pet"), F.col("wet"), F.col("warmest")
    months = F.array_join(F.transform("months", lambda t, i: F.concat(F.lpad((i + 1).cast("string"), 2, "0"), F.lit(": "), F.format_string("%.1f", t.cast("double")))), " ")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("annual "), f(1, F.col("annual")), F.lit(", warmest "), f(1, warm), F.lit(", snowpack "), (warm < snowpack).cast("string")),
        F.concat(F.lit("P "), f(0, p), F.lit(", PET "), f(0, pet), F.lit(", ratio "), f(3, p / (p + F.greatest(pet, F.lit(1.0)))), F.lit(", cap "), f(3, F.least(F.lit(1.0), p / 200))),
        F.concat(F.lit("wetness "), f(3, wet), F.lit(", of the soil "), f(3, F.when(warm < growing, 0.0).otherwise(wet)), F.lit(", rain factor "), f(3, S.rain_factor(p))),
        months,
    )


def ground_cover(fertility: Column, cover: Column, grass: Column, forest: Column, biome: Column, temperature: Column, near_river: Column, roll: Column) -> dict[str, Column]:
    """fertility class 0-3, grass used, cover class 0-3, forest stage -1 or 1-7."""
    mild = temperature >= -10
    fc = F.when(fertility >= 0.7, 3).when(fertility >= 0.3, 2).when(fertility >= 0.15, 1).otherwise(0)
    fc = F.when(near_river, F.greatest(fc, F.lit(2))).otherwise(fc)
    g = F.when(near_river & mild, F.greatest(grass, F.least(F.lit(0.2), 0.08 + 0.6 * grass))).otherwise(grass)
    cc = F.when(cover >= 0.65, 3).when(cover >= 0.3, 2).when(cover >= 0.1, 1).otherwise(0)
    cc = F.when(~mild, 0).when((fc < 2) & (roll > g), 0).when(near_river & (cc == 0) & (g > 0), 1).when((fc >= 2) & (cc == 0), 1).otherwise(cc)
    stage = F.when((forest >= 96) & biome.isin(FOREST_FLOOR) & mild, F.least(F.greatest(F.floor((forest - 64) / 32).cast("int"), F.lit(1)), F.lit(7))).otherwise(-1)
    return {"fertility_class": fc, "grass_used": g, "cover_class": cc, "forest_stage": stage}


def surface_kind(bare: Column, soil: Column, slope: Column, near: Column, biome: Column, wet: Column, roll: Column, roll2: Column) -> dict[str, Column]:
    """What lies on top - bare rock, sand or soil - and how deep."""
    chance = S.clip(F.when(bare, 0.45).otherwise(0.03) + 0.14 * slope - F.when(near, 0.22).otherwise(0.0), 0.0, 0.95)
    rock = (roll < chance) | (soil == 0)
    sandy = (biome == 27) & (wet < 0.2) & (slope < 1) & (roll2 < 0.5)
    depth = F.least(F.greatest(soil - slope + F.when(near, 1).otherwise(0), F.lit(1)), F.lit(4))
    return {"kind": F.when(rock, "rock").when(sandy, "sand").otherwise("soil"), "depth": F.when(rock, 0).otherwise(depth)}


def tall_grass(kind: Column, grass: Column, forest: Column, roll: Column) -> Column:
    return (kind == "soil") & (grass > 0.15) & (roll < grass * (1 - forest / 320.0) * 0.35)


def snow_layer(temperature: Column, solid: Column, fluid: Column) -> Column:
    return (temperature <= 0) & solid & ~fluid


def column_class(height: int, sea: int = 60) -> dict[str, Column]:
    """Ground, surface and fluid of a column from its planes: lake over ocean over river over dry land."""
    wy = lambda c: S.world_y(c, height)
    low = lambda c: F.greatest(F.lit(1), wy(F.greatest(F.lit(1), c)))
    lake, ocean, river = F.col("lake_mask") > 0, F.col("land") == 0, F.col("river") > 0
    pick = lambda a, b, c, d: F.when(lake, a).when(ocean, b).when(river, c).otherwise(d)
    return {
        "ground": pick(low(F.col("height") - F.col("lake_depth")), low(F.col("bathy") - 1), low(F.col("river_surface") - F.col("river_depth")), wy(F.col("height"))),
        "surface": pick(wy(F.col("height")), wy(F.lit(sea)), wy(F.col("river_surface")), wy(F.col("height"))),
        "fluid": pick(F.when(F.col("lake_mask") == 128, "salt").otherwise("fresh"), F.lit("salt"), F.lit("fresh"), F.lit("none")),
        "kind": pick(F.lit("lake"), F.lit("ocean"), F.lit("river"), F.lit("land")),
    }


def fill_column(columns: DataFrame, top: str = "surface", ground: str = "ground", max_y: Column | None = None) -> DataFrame:
    """A row per block: rock up to the ground, fluid up to the surface, air above."""
    y = F.explode(F.sequence(F.lit(1), max_y if max_y is not None else F.greatest(F.col(top), F.col(ground))))
    return columns.withColumn("y", y).withColumn("block", F.when(F.col("y") <= F.col(ground), "rock").when(F.col("y") <= F.col(top), F.col("fluid")).otherwise("air"))


def repair_coast(cells: DataFrame, sea: int = 60, least: int = 50, cap: int = 16) -> DataFrame:
    """Ocean shallower than allowed becomes sea level; dry land below sea level within ``cap`` cells of non-land is flooded.

    cells(z, x, height, land, lake, bathy). Lakes are never flooded, and count as land for the distance.
    """
    df = cells.withColumn("_out", (F.col("land") == 0) & (F.col("lake") == 0))
    df = T.capped_distance(df, "_out", cap, "_d")
    flood = (F.col("land") != 0) & (F.col("lake") == 0) & (F.col("height") < sea) & F.col("_d").isNotNull()
    ocean = F.col("land") == 0
    return df.select(
        "z", "x",
        F.when(flood, 0).otherwise(F.col("height")).alias("height"),
        F.when(flood, 0).otherwise(F.col("land")).alias("land"),
        "lake",
        F.when(flood | (ocean & (F.col("bathy") < least)), sea).otherwise(F.col("bathy")).alias("bathy"),
    )


def lake_maps(cells: DataFrame, lakes: DataFrame, reach: int = 6) -> DataFrame:
    """Levels, depths, masks and banks of all lakes at once.

    cells(z, x, height, land); lakes(z, x, lake, saline): the cells of each lake. A lake's
    level is the lower median of the original heights; depth is the clipped chessboard
    distance to its shore; banks follow the nearest lake, the first on ties, and never
    change a lake cell.
    """
    from terraspark.operators.aggregates import lower_median, own_banks
    from terraspark.operators.distance import around

    in_lake = lakes.groupBy("z", "x").agg(F.min("lake").alias("lake"), F.max("saline").alias("saline"))
    level = lower_median(in_lake.join(cells.select("z", "x", "height"), ["z", "x"]), ["lake"], "height", "level")
    salt = in_lake.groupBy("lake").agg(F.max("saline").alias("saline"))
    ring = [(dz, dx) for dz in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if 0 < abs(dz) + abs(dx) <= reach]
    # only a cell with dry land beside it can be the nearest of its lake; the others are not spread
    wet = in_lake.select("z", "x").withColumn("_wet", F.lit(True))
    beside = around(in_lake.select("z", "x", "lake"), [(0, 1), (0, -1), (1, 0), (-1, 0)]).select("z", "x", "lake", "nz", "nx")
    shore = beside.join(wet.withColumnsRenamed({"z": "nz", "x": "nx"}), ["nz", "nx"], "left_anti").select("z", "x", "lake").distinct()
    spread = around(shore, ring)
    reachd = spread.select(F.col("nz").alias("z"), F.col("nx").alias("x"), "lake", (F.abs("dz") + F.abs("dx")).alias("distance"))
    banks = own_banks(reachd, in_lake)
    df = cells.join(in_lake.select("z", "x", F.col("lake").alias("_l")), ["z", "x"], "left").withColumn("_dry", F.col("_l").isNull())
    df = T.capped_distance(df, "_dry", 12, "_d")
    df = df.join(banks.select("z", "x", F.col("lake").alias("_b"), F.col("distance").alias("_t")), ["z", "x"], "left")
    df = df.withColumn("_own", F.coalesce("_l", "_b")).join(level.withColumnRenamed("lake", "_own"), "_own", "left").join(salt.select(F.col("lake").alias("_own"), "saline"), "_own", "left")
    from terraspark.operators.vector import bank_height

    wet = F.col("_l").isNotNull()
    return df.select(
        "z", "x",
        F.when(wet, F.col("level")).when(F.col("_b").isNotNull(), bank_height(F.col("height"), F.col("level"), F.col("_t"))).otherwise(F.col("height")).alias("height"),
        F.when(wet, 255).otherwise(F.col("land")).alias("land"),
        F.when(wet, T.depth_from_distance(F.col("_d"), 1, 12)).otherwise(0).alias("lake_depth"),
        F.when(wet, F.when(F.col("saline"), 128).otherwise(255)).otherwise(0).alias("lake_mask"),
    )


def natural_lakes(features: DataFrame, reservoir_ids: DataFrame, reservoir_names: DataFrame) -> DataFrame:
    """Features of a natural class that no list of reservoirs names; a missing id or name is in no list."""
    f = features.filter(F.col("featurecla").isin(NATURAL))
    return f.join(reservoir_ids, "wikidataid", "left_anti").join(reservoir_names, "name", "left_anti")


def check_classes(cells: DataFrame, klass: str, known: list[int]) -> None:
    """Raises if a class is not in the list."""
    odd = cells.select(klass).distinct().filter(~F.col(klass).isin(known)).limit(5).collect()
    if odd:
        raise ValueError(f"unknown classes {[r[0] for r in odd]}")


def river_bounds(cells: DataFrame, floor: int = 5) -> DataFrame:
    """Ceiling, fitted height, floor and first surface of river cells.

    cells(z, x, height, river boolean, lake boolean). The ceiling is the least dry height
    around; the first surface the least of floor and its median; at a lake (four
    neighbours) it is the least lake height around.
    """
    import numpy as np

    def run(p, here):
        river, lake, h = (p[k].value for k in ("river", "lake", "height"))
        ceiling = T.least(T.Plane(np.where(~river & ~lake, h, 255), here))
        fit = T.Plane(np.where(river, np.minimum(h, ceiling.value), h), here)
        low = T.least(fit, floor)
        surface = np.minimum(low.value, T.median9(low, here).value)
        shore = T.touching(p["lake"], here).value & ~lake
        at_lake = T.least(T.Plane(np.where(lake, h, 255), here))
        return {"ceiling": ceiling, "fit": fit, "floor": low, "surface0": T.Plane(np.where(shore, at_lake.value, surface), here)}

    # the whole chain looks no further than its steps together: one exchange
    return T.focal(cells, ["height", "river", "lake"], 2 + floor // 2, dict.fromkeys(("ceiling", "fit", "floor", "surface0"), cells.schema["height"].dataType.simpleString()), run)


def write_values(raster: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """The raster with sparse new values; other cells as they are."""
    v = values.select("z", "x", F.col(column).alias("_new"))
    return raster.join(v, ["z", "x"], "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def climate_at(points: DataFrame, samples: DataFrame, fields: list[str], spacing: int, height: int, width: int) -> DataFrame:
    """Bilinear lookup of per-sample fields at blocks ``points(pid, z, x)``; fields are derived per sample before they are blended."""
    from terraspark.operators.resample import sample_fields

    p = points.select("pid", (F.col("z") / spacing).alias("fz"), (F.col("x") / spacing).alias("fx"))
    got = sample_fields(p, samples.select(F.col("sz").alias("z"), F.col("sx").alias("x"), *fields), {f: f for f in fields}, height, width)
    return points.join(got.select("pid", *fields), "pid", "left")


def odd_keys(cells: DataFrame, key: str, size: int) -> DataFrame:
    """(key, n): keys that repeat, are missing or lie outside 0..size-1. Partial counts, nothing is sorted."""
    return cells.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull() | (F.col(key) < 0) | (F.col(key) >= size))


def check_keys(cells: DataFrame, key: str, size: int) -> None:
    odd = odd_keys(cells, key, size).limit(5).collect()
    if odd:
        raise ValueError(f"keys that repeat or lie outside the map: {[r[0] for r in odd]}")


def dissolve(spark: SparkSession, parts: DataFrame, height: int, width: int) -> DataFrame:
    """(id, whole): shapes that touch, as one; ``parts(id, z, x)`` are their cells, ``whole`` the least id of those that share a cell or have cells side by side."""
    from terraspark.operators.distance import around
    from terraspark.operators.graph import components

    least = parts.groupBy("z", "x").agg(F.min("id").alias("owner"))
    same = parts.join(least, ["z", "x"]).select(F.col("id").alias("src"), F.col("owner").alias("dst"))
    beside = around(least, [(0, 1), (1, 0)]).filter((F.col("nz") < height) & (F.col("nx") < width))
    side = beside.select(F.col("owner").alias("src"), F.col("nz").alias("z"), F.col("nx").alias("x")).join(least.withColumnRenamed("owner", "dst"), ["z", "x"]).select("src", "dst")
    return components(spark, same.unionByName(side).distinct(), parts.select("id").distinct()).withColumnRenamed("component", "whole")
