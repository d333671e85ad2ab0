"""Queries over the driver tables, one or more for each operator, with DuckDB SQL of the same result."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraspark.functions import scalars as S
from terraspark.operators import aggregates as A
from terraspark.operators import distance as D
from terraspark.operators import graph as G
from terraspark.operators import maps as M
from terraspark.operators import resample as R
from terraspark.operators import stencil as T
from terraspark.operators import vector as V
from terraspark.plans.catalog import query
from terraspark.plans.fixtures import R1, R2, R3, R4, R5, R6, R7, R7_CELLS, R8, r1, r2, r3, r4, r5, r6, r7, r8, table

SS = lambda lo, hi, v: (lambda t: f"({t} * {t} * (3.0::DOUBLE - 2.0::DOUBLE * {t}))")(f"greatest(least(({v} - {lo}::DOUBLE) / ({hi}::DOUBLE - {lo}::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE)")
ELEV = "(v - 100) * 20"


# ---- map algebra -----------------------------------------------------------------------------


@query("prj10_terrain_encode", f"WITH {R1}, e AS (SELECT z, x, {ELEV} AS e FROM r1), p AS (SELECT greatest(max(e), 0) AS peak FROM e) SELECT z, x, CAST(greatest(least(60 + round_even(CAST(CAST(e AS FLOAT) * CAST((195.0::DOUBLE / peak) AS FLOAT) AS DOUBLE), 0), 255), 1) AS INT) AS y FROM e, p")
def prj10(spark, sf):
    e = r1(spark, sf).select("z", "x", ((F.col("v") - 100) * 20).alias("e"))
    df = A.with_global(e, peak=F.greatest(F.max("e"), F.lit(0)))
    return df.select("z", "x", S.terrain_byte(F.col("e"), F.col("peak")).alias("y"))


_BATHY = "CASE WHEN e >= 0 THEN 0 WHEN e > -100 THEN CAST(floor(55 + ((e + 100) / 100.0::DOUBLE) * 5) AS INT) ELSE CAST(floor(50 + ((e - m) / (-100.0::DOUBLE - m)) * 5) AS INT) END"


@query("prj07_bathymetry", f"WITH {R1}, e AS (SELECT z, x, (v - 128) * 7 AS e FROM r1), p AS (SELECT min(e) AS m FROM e) SELECT z, x, {_BATHY} AS y FROM e, p")
def prj07(spark, sf):
    e = r1(spark, sf).select("z", "x", ((F.col("v") - 128) * 7).alias("e"))
    return A.with_global(e, m=F.min("e")).select("z", "x", S.bathymetry(F.col("e"), F.col("m")).alias("y"))


@query("prj07_bathymetry_linear", f"WITH {R1}, e AS (SELECT z, x, (v - 128) * 7 AS e FROM r1), p AS (SELECT min(e) AS m FROM e) SELECT z, x, CASE WHEN e < 0 THEN CAST(floor(((e + abs(m)) / abs(m)::DOUBLE) * 10 + 50) AS INT) ELSE 0 END AS y FROM e, p")
def prj07b(spark, sf):
    e = r1(spark, sf).select("z", "x", ((F.col("v") - 128) * 7).alias("e"))
    return A.with_global(e, m=F.min("e")).select("z", "x", S.bathymetry(F.col("e"), F.col("m"), piecewise=False).alias("y"))


@query("prj08_ocean_only", f"WITH {R1} SELECT z, x, CASE WHEN v < 128 THEN v - 128 ELSE 0 END AS depth FROM r1")
def prj08(spark, sf):
    return r1(spark, sf).select("z", "x", F.when(F.col("v") < 128, F.col("v") - 128).otherwise(0).alias("depth"))


@query("prj06_rescale", f"WITH {R1} SELECT z, x, round(greatest(least(10 + (v - 60) * (80 / 120.0::DOUBLE), 90), 10), 6) AS y FROM r1")
def prj06(spark, sf):
    return r1(spark, sf).select("z", "x", F.round(S.rescale(F.col("v"), 60, 180, 10.0, 90.0), 6).alias("y"))


@query("prj09_dem_merge", f"WITH {R3} SELECT z, x, CASE WHEN lake THEN height + 5 ELSE height END AS e FROM r3")
def prj09(spark, sf):
    a = r3(spark, sf)
    b = a.filter("lake").select("z", "x", (F.col("height") + 5).alias("_g"))
    return a.join(b, ["z", "x"], "left").select("z", "x", F.coalesce("_g", "height").alias("e"))


@query("prj11_coast_depth", f"WITH {R3} SELECT z, x, CASE WHEN land = 0 AND bathy < 50 THEN 60 ELSE bathy END AS bathy FROM r3")
def prj11(spark, sf):
    return r3(spark, sf).select("z", "x", F.when((F.col("land") == 0) & (F.col("bathy") < 50), 60).otherwise(F.col("bathy")).alias("bathy"))


@query(
    "prj12_coast_repair",
    f"""WITH {R3}, o AS MATERIALIZED (SELECT z, x FROM r3 WHERE land = 0 AND NOT lake), k AS MATERIALIZED (SELECT a, b FROM (SELECT unnest(range(-3, 4)) AS a), (SELECT unnest(range(-3, 4)) AS b)), n AS MATERIALIZED (SELECT DISTINCT z + a AS z, x + b AS x FROM o, k),
 f AS (SELECT r3.*, land <> 0 AND NOT lake AND height < 125 AND n.z IS NOT NULL AS flood FROM r3 LEFT JOIN n ON r3.z = n.z AND r3.x = n.x)
 SELECT z, x, CASE WHEN flood THEN 0 ELSE height END AS height, CASE WHEN flood THEN 0 ELSE land END AS land, CAST(lake AS INT) AS lake, CASE WHEN flood OR (land = 0 AND bathy < 50) THEN 125 ELSE bathy END AS bathy FROM f""",
)
def prj12(spark, sf):
    c = r3(spark, sf).select("z", "x", "height", "land", F.col("lake").cast("int").alias("lake"), "bathy")
    return M.repair_coast(c, sea=125, least=50, cap=3)


@query("prj13_vegetation_mask", f"WITH {R3} SELECT z, x, CASE WHEN land = 0 THEN 0 ELSE vegetation END AS vegetation FROM r3")
def prj13(spark, sf):
    return r3(spark, sf).select("z", "x", F.when(F.col("land") == 0, 0).otherwise(F.col("vegetation")).alias("vegetation"))


@query("prj16_reach_filter", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice >= 20000 AND l_quantity >= 10")
def prj16(spark, sf):
    return table(spark, sf, "lineitem").filter((F.col("l_extendedprice") >= 20000) & (F.col("l_quantity") >= 10)).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("prj18_river_width", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity - 5 <= 0 THEN 90.0 ELSE least(5.4 * 30, 90.0 + 30 * sqrt((l_quantity - 5) / 8.0)) END, 6) AS w FROM lineitem")
def prj18(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.river_width(F.col("l_quantity") - 5, 30.0), 6).alias("w"))


@query("prj19_bake_planes", f"WITH {R3} SELECT z, x, CASE WHEN land > 0 THEN greatest(height, 1) ELSE 0 END AS h, CASE WHEN land = 0 THEN greatest(least(bathy, 60), 50) ELSE 60 END AS b FROM r3")
def prj19(spark, sf):
    return r3(spark, sf).select("z", "x", S.bake_height(F.col("height"), F.col("land")).alias("h"), S.bake_bathymetry(F.col("bathy"), F.col("land")).alias("b"))


@query("prj20_river_mask", f"WITH {R3} SELECT z, x FROM r3 WHERE x BETWEEN 16 AND 40 AND land > 0 AND NOT lake")
def prj20(spark, sf):
    return r3(spark, sf).filter(F.col("x").between(16, 40) & (F.col("land") > 0) & ~F.col("lake")).select("z", "x")


@query("prj21_prebank_height", f"WITH {R3} SELECT z, x, CASE WHEN river THEN river_surface ELSE height END AS h FROM r3")
def prj21(spark, sf):
    return r3(spark, sf).select("z", "x", F.when(F.col("river"), F.col("river_surface")).otherwise(F.col("height")).alias("h"))


@query("prj23_world_y", f"WITH {R1} SELECT z, x, CAST((v::BIGINT * 383 + 127) // 255 AS INT) AS y FROM r1")
def prj23(spark, sf):
    return r1(spark, sf).select("z", "x", S.world_y(F.col("v"), 384).alias("y"))


@query("prj24_packed_climate", f"WITH {R6} SELECT part, ((CAST(warmest AS INT) + 20) << 16) | (CAST(round_even(wet * 255, 0) AS INT) << 8) AS packed FROM r6")
def prj24(spark, sf):
    return r6(spark, sf).select("part", S.pack_climate(F.col("warmest").cast("int") + 20, F.col("wet")).alias("packed"))


@query("prj25_strided_sample", f"WITH {R1}, g AS (SELECT CAST(a AS INT) AS z, CAST(b AS INT) AS x FROM (SELECT unnest(range(0, (SELECT max(z) + 101 FROM r1), 4)) AS a), (SELECT unnest(range(0, 80, 4)) AS b)) SELECT g.z, g.x, coalesce(v * 2, 0) AS v FROM g LEFT JOIN r1 ON g.z = r1.z AND g.x = r1.x")
def prj25(spark, sf):
    c = r1(spark, sf)
    # beyond the last row and column the sample is 0
    g = c.agg(F.max("z").alias("m")).select(F.explode(F.sequence(F.lit(0), F.col("m") + 100, F.lit(4))).alias("z")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(79), F.lit(4))))
    return g.join(c, ["z", "x"], "left").select("z", "x", F.coalesce(F.col("v") * 2, F.lit(0)).alias("v"))


def _wy(c):
    return f"CAST((({c})::BIGINT * 255 + 127) // 255 AS INT)"


_LOW = lambda c: f"greatest(1, {_wy(f'greatest(1, {c})')})"
_COLUMN = f"""WITH {R3} SELECT z, x,
 CASE WHEN lake_mask > 0 THEN {_LOW('height - lake_depth')} WHEN land = 0 THEN {_LOW('bathy - 1')} WHEN river THEN {_LOW('river_surface - river_depth')} ELSE {_wy('height')} END AS ground,
 CASE WHEN lake_mask > 0 THEN {_wy('height')} WHEN land = 0 THEN {_wy('60')} WHEN river THEN {_wy('river_surface')} ELSE {_wy('height')} END AS surface,
 CASE WHEN lake_mask > 0 THEN CASE WHEN lake_mask = 128 THEN 'salt' ELSE 'fresh' END WHEN land = 0 THEN 'salt' WHEN river THEN 'fresh' ELSE 'none' END AS fluid,
 CASE WHEN lake_mask > 0 THEN 'lake' WHEN land = 0 THEN 'ocean' WHEN river THEN 'river' ELSE 'land' END AS kind FROM r3"""


def _columns(spark, sf):
    c = r3(spark, sf).withColumn("river", F.col("river").cast("int"))
    return c.select("z", "x", *(v.alias(k) for k, v in M.column_class(256).items()))


@query("prj26_column_class", _COLUMN)
def prj26(spark, sf):
    return _columns(spark, sf)


@query("prj27_vertical_fill", f"WITH c AS ({_COLUMN}), f AS (SELECT *, unnest(range(1, greatest(surface, ground) + 1)) AS y FROM c) SELECT z, CASE WHEN y <= ground THEN 'rock' WHEN y <= surface THEN fluid ELSE 'air' END AS block, count(*) AS n FROM f GROUP BY 1, 2")
def prj27(spark, sf):
    return M.fill_column(_columns(spark, sf)).groupBy("z", "block").agg(F.count(F.lit(1)).alias("n"))


@query("prj28_terrain_temperature", f"WITH {R6} SELECT part, round(annual - 0.05 * (biome * 255.0 / 255 - 8), 6) AS t FROM r6")
def prj28(spark, sf):
    return r6(spark, sf).select("part", F.round(S.terrain_temperature(F.col("annual"), F.lit(-0.05), F.col("biome"), F.lit(8), 256), 6).alias("t"))


_HOUR = "(part % 24)::DOUBLE"
_CYC = f"abs(((({_HOUR} - 4.0 + 12.0) % 24.0::DOUBLE) + 24.0) % 24.0::DOUBLE - 12.0) / 12.0::DOUBLE"


@query("prj29_instant_temperature", f"WITH {R6} SELECT part, round(annual - 0.05 * (255.0 * biome / 255 - 8) + ({SS('0.0', '1.0', _CYC)} - 0.5) * (18.0 - 13.0 * wet) + 3.0 * 0.1 + 0.2, 3)::DOUBLE AS t FROM r6")
def prj29(spark, sf):
    t = S.instant_temperature(F.col("annual"), F.lit(-0.05), F.col("biome"), F.lit(8), F.col("part") % 24, F.col("wet"), 256, F.lit(0.1), F.lit(0.2))
    return r6(spark, sf).select("part", F.round(t, 3).alias("t"))


@query("prj30_rain_factor", "SELECT p_partkey AS part, round(p_size * 40 / (p_size * 40 + 800.0), 6) AS f FROM part")
def prj30(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.round(S.rain_factor(F.col("p_size") * 40), 6).alias("f"))


@query("prj31_colour_word", f"WITH {R6}, w AS (SELECT part, (CAST(warmest AS INT) + 20) | ((part % 256)::INT << 8) | (biome << 16) | CASE WHEN warmest < 0 THEN 16777216 ELSE 0 END AS word FROM r6) SELECT part, word, (word >> 8) & 255 AS rain FROM w")
def prj31(spark, sf):
    w = S.pack_colour(F.col("warmest").cast("int") + 20, F.col("part") % 256, F.col("biome"), F.col("warmest") < 0)
    return r6(spark, sf).select("part", w.alias("word")).withColumn("rain", S.unpack_bits(F.col("word"), 8, 8))


@query("prj05_affine_round_trip", f"WITH {R1} SELECT z, x, round(1000 + 30.0 * (x + 0.5), 6)::DOUBLE AS wx, round(9000 - 30.0 * (z + 0.5), 6)::DOUBLE AS wy, x AS cx, z AS cz FROM r1")
def prj05(spark, sf):
    from terraspark.grid import Grid

    g = Grid(30.0, 0.0, 1000.0, 0.0, -30.0, 9000.0, 64, 500, "EPSG:3857")
    wx, wy = g.to_world(F.col("x") + 0.5, F.col("z") + 0.5)
    c = r1(spark, sf).select("z", "x", wx.alias("_x"), wy.alias("_y"))
    px, py = g.to_pixel(F.col("_x"), F.col("_y"))
    return c.select("z", "x", F.round("_x", 6).alias("wx"), F.round("_y", 6).alias("wy"), F.rint(px - 0.5).cast("int").alias("cx"), F.rint(py - 0.5).cast("int").alias("cz"))


@query("prj04_mercator", "SELECT s_suppkey, CAST(floor(radians((s_suppkey % 300) - 150) * 6378137.0 + 0.25) AS BIGINT) AS x, CAST(floor(ln(tan(pi() / 4 + radians((s_suppkey % 160) - 80) / 2)) * 6378137.0 + 0.25) AS BIGINT) AS y FROM supplier")
def prj04(spark, sf):
    from terraspark.grid import project

    k = F.col("s_suppkey")
    x, y = project((k % 300 - 150).cast("double"), (k % 160 - 80).cast("double"), "EPSG:3857")
    return table(spark, sf, "supplier").select("s_suppkey", F.floor(x + 0.25).alias("x"), F.floor(y + 0.25).alias("y"))


# ---- joins -----------------------------------------------------------------------------------


@query("jon01_co_grid", f"WITH {R3}, b AS (SELECT z, x, v % 7 AS k FROM r1) SELECT r3.z, r3.x, height, k FROM r3 JOIN b ON r3.z = b.z AND r3.x = b.x")
def jon01(spark, sf):
    return r3(spark, sf).select("z", "x", "height").join(r1(spark, sf).select("z", "x", (F.col("v") % 7).alias("k")), ["z", "x"])


@query("jon02_pixel_lookup", f"WITH {R3}, s AS (SELECT z * 64 + x AS pixel, river_surface FROM r3 WHERE river), q AS (SELECT DISTINCT l_partkey % 32000 AS pixel FROM lineitem) SELECT pixel, river_surface FROM q JOIN s USING (pixel)")
def jon02(spark, sf):
    s = r3(spark, sf).filter("river").select((F.col("z") * 64 + F.col("x")).cast("long").alias("pixel"), "river_surface")
    return table(spark, sf, "lineitem").select((F.col("l_partkey") % 32000).alias("pixel")).distinct().join(s, "pixel")


_N8 = "(SELECT unnest(range(-1, 2)) AS dz), (SELECT unnest(range(-1, 2)) AS dx)"


@query("jon03_neighbour_edges", f"WITH {R3}, c AS (SELECT z * 64 + x AS id, z, x FROM r3 WHERE river) SELECT a.id AS src, b.id AS dst, CASE WHEN a.z <> b.z AND a.x <> b.x THEN 1.41421356 ELSE 1.0 END::DOUBLE AS cost FROM c a JOIN c b ON b.z BETWEEN a.z - 1 AND a.z + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND a.id <> b.id")
def jon03(spark, sf):
    return G.neighbour_edges(_river_cells(spark, sf))


def _river_cells(spark, sf):
    return r3(spark, sf).filter("river").select((F.col("z") * 64 + F.col("x")).alias("id"), "z", "x", F.col("height").alias("level"))


@query("jon04_box_tile_join", f"WITH {R7}, t AS (SELECT id, unnest(range(x0 // 16, (x0 + 5) // 16 + 1)) AS tx, z0 FROM r7) SELECT id, tx, unnest(range(z0 // 16, (z0 + 5) // 16 + 1)) AS tz FROM t")
def jon04(spark, sf):
    b = r7(spark, sf).withColumn("pts", V.box_ring(F.col("x0"), F.col("z0"), F.col("x0") + 5, F.col("z0") + 5))
    return V.by_tile(b, "pts", 16).select("id", "tx", "tz")


@query("jon05_nearest_center", f"WITH {R3}, c AS (SELECT z * 64 + x AS id, z, x FROM r3 WHERE river), k AS (SELECT id AS center, z, x FROM c WHERE id % 5 = 0), j AS (SELECT c.id, k.center, (c.z - k.z) ** 2 + (c.x - k.x) ** 2 AS d2, row_number() OVER (PARTITION BY c.id ORDER BY (c.z - k.z) ** 2 + (c.x - k.x) ** 2, k.z, k.x) AS n FROM c JOIN k ON k.z BETWEEN c.z - 4 AND c.z + 4 AND k.x BETWEEN c.x - 4 AND c.x + 4 AND (c.z - k.z) ** 2 + (c.x - k.x) ** 2 <= 16) SELECT id, center, CAST(d2 AS INT) AS d2 FROM j WHERE n = 1")
def jon05(spark, sf):
    c = _river_cells(spark, sf)
    return G.nearest_center(c, c.filter("id % 5 = 0"), 4)


@query("jon06_bilinear_lookup", f"""WITH {R1}, p AS (SELECT s_suppkey AS pid, (s_suppkey % 480) + 0.25 AS fz, (s_suppkey % 60) + 0.75 AS fx FROM supplier),
 c AS (SELECT pid, fz, fx, CAST(floor(fz) AS INT) + a AS z, CAST(floor(fx) AS INT) + b AS x, (CASE a WHEN 0 THEN 1 - (fz - floor(fz)) ELSE fz - floor(fz) END) * (CASE b WHEN 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) AS w FROM p, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))
 SELECT pid, round(sum(w * v) / sum(w), 6)::DOUBLE AS v FROM c JOIN r1 USING (z, x) GROUP BY pid""")
def jon06(spark, sf):
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pid"), (F.col("s_suppkey") % 480 + 0.25).alias("fz"), (F.col("s_suppkey") % 60 + 0.75).alias("fx"))
    return R.sample_bilinear(p, r1(spark, sf), "v", "_o", 500, 64).select("pid", F.round("_o", 6).alias("v"))


@query("jon07_gather_nearest", f"""WITH {R2}, g AS (SELECT CAST(a AS INT) AS z, CAST(b AS INT) AS x FROM (SELECT unnest(range(0, 100)) AS a), (SELECT unnest(range(0, 250)) AS b)), h AS (SELECT z, x FROM g ANTI JOIN r2 USING (z, x)),
 j AS (SELECT h.z, h.x, min((h.z - r.z) ** 2 + (h.x - r.x) ** 2) AS d2 FROM h JOIN r2 r ON true GROUP BY 1, 2) SELECT z, x, CAST(d2 AS INT) AS d2 FROM j""")
def jon07(spark, sf):
    g = _dense_r2(spark, sf)
    n = D.nearest_source(g.withColumn("_k", F.col("v").isNotNull()), "_k").filter("v IS NULL")
    return n.select("z", "x", ((F.col("z") - F.col("nz")) * (F.col("z") - F.col("nz")) + (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx"))).alias("d2"))


def _dense_r2(spark, sf):
    g = spark.range(100).select(F.col("id").cast("int").alias("z"), F.explode(F.sequence(F.lit(0), F.lit(249))).alias("x"))
    return g.join(r2(spark, sf), ["z", "x"], "left")


@query("jon08_point_in_box", f"WITH {R7}, q AS (SELECT p_partkey AS pid, p_partkey % 60 AS x, p_partkey % 410 AS z FROM part) SELECT pid, id FROM q JOIN r7 ON x >= x0 AND x < x0 + 5 AND z >= z0 AND z < z0 + 5")
def jon08(spark, sf):
    b = r7(spark, sf).withColumn("pts", V.box_ring(F.col("x0"), F.col("z0"), F.col("x0") + 5, F.col("z0") + 5))
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("pid"), (F.col("p_partkey") % 60).alias("x"), (F.col("p_partkey") % 410).alias("z"))
    j = q.withColumn("tx", F.floor(F.col("x") / 16)).withColumn("tz", F.floor(F.col("z") / 16)).join(V.by_tile(b, "pts", 16), ["tx", "tz"])
    return j.filter("x >= x0 AND x < x0 + 5 AND z >= z0 AND z < z0 + 5").select("pid", "id")


@query("jon09_semi", f"WITH {R6} SELECT part, biome FROM r6 WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = part AND l_quantity >= 49)")
def jon09(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("part"))
    return r6(spark, sf).select("part", "biome").join(li, "part", "left_semi")


_PROFILE_VALUES = ", ".join(f"({b}, {f}, {s}, {g}::DOUBLE, {q}::DOUBLE, {d}, {str(x).lower()})" for b, f, s, g, q, d, x in M.PROFILES)
_PROFILE = f"bp(biome, forest0, shrub0, grass0, fertility0, soil0, bare0) AS (VALUES {_PROFILE_VALUES})"


@query("jon10_anti", f"WITH {R6}, {_PROFILE} SELECT part, biome FROM r6 WHERE NOT EXISTS (SELECT 1 FROM bp WHERE bp.biome = r6.biome)")
def jon10(spark, sf):
    return r6(spark, sf).select("part", "biome").join(M.profiles(spark), "biome", "left_anti").select("part", "biome")


@query("jon11_dimension", f"WITH {R6}, {_PROFILE} SELECT part, r6.biome, coalesce(forest0, 0) AS forest FROM r6 LEFT JOIN bp ON bp.biome = r6.biome")
def jon11(spark, sf):
    return r6(spark, sf).join(F.broadcast(M.profiles(spark)), "biome", "left").select("part", "biome", F.coalesce("forest0", F.lit(0)).alias("forest"))


@query("jon12_near_river", f"WITH {R3}, k AS MATERIALIZED (SELECT dz, dx FROM (SELECT unnest(range(-4, 5)) AS dz), (SELECT unnest(range(-4, 5)) AS dx) WHERE dz * dz + dx * dx <= 16), w AS MATERIALIZED (SELECT z, x FROM r3 WHERE river), r AS MATERIALIZED (SELECT DISTINCT z + dz AS z, x + dx AS x FROM w, k) SELECT r3.z, r3.x, r.z IS NOT NULL AS near FROM r3 LEFT JOIN r ON r3.z = r.z AND r3.x = r.x")
def jon12(spark, sf):
    return D.near_flag(r3(spark, sf).select("z", "x", "river"), "river", "near").select("z", "x", "near")


@query("jon14_region_join", f"WITH {R1} SELECT CAST(z // 32 AS BIGINT) AS rz, CAST(x // 32 AS BIGINT) AS rx, count(*) AS n, max(v) AS top FROM r1 GROUP BY 1, 2")
def jon14(spark, sf):
    return r1(spark, sf).groupBy(F.floor(F.col("z") / 32).alias("rz"), F.floor(F.col("x") / 32).alias("rx")).agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))


# ---- aggregates ------------------------------------------------------------------------------


@query("agg01_02_extremes", f"WITH {R1} SELECT min(v) AS lo, max(v) AS hi FROM r1")
def agg01(spark, sf):
    return r1(spark, sf).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


@query("agg03_lower_median", f"WITH {R1}, {R7_CELLS} SELECT id, CAST(quantile_disc(v, 0.5) AS INT) AS level FROM r7c JOIN r1 USING (z, x) GROUP BY id")
def agg03(spark, sf):
    c = _box_cells(spark, sf).join(r1(spark, sf).select("z", "x", "v"), ["z", "x"])
    return A.lower_median(c, ["id"], "v", "level")


def _box_cells(spark, sf):
    b = r7(spark, sf).select("id", F.array(V.box_ring(F.col("x0"), F.col("z0"), F.col("x0") + 5, F.col("z0") + 5)).alias("rings"))
    return V.fill_polygons(b, 500, 64)


@query("agg04_annual_mean", f"WITH {R5} SELECT sample, CAST(floor(CAST(list_reduce(list(CAST(t AS FLOAT) / CAST(12 AS FLOAT) ORDER BY month), lambda a, b: CAST(a + b AS FLOAT)) AS DOUBLE) * 1000 + 0.25) AS BIGINT) AS t FROM r5 GROUP BY sample")
def agg04(spark, sf):
    return A.annual_mean(r5(spark, sf), ["sample"], "t", "t").withColumn("t", F.floor(F.col("t").cast("double") * 1000 + 0.25))


@query("agg05_annual_sum", f"WITH {R5} SELECT sample, CAST(round_even(greatest(least(sum(greatest(t - 5, 0.0)), 65535), 0), 0) AS INT) AS p FROM r5 GROUP BY sample")
def agg05(spark, sf):
    return A.annual_sum(r5(spark, sf).withColumn("t", F.col("t") - 5), ["sample"], "t", "p", order="month")


@query("agg06_footprint_mean", f"WITH {R1} SELECT CAST((z + 4) // 8 AS INT) AS sz, CAST((x + 4) // 8 AS INT) AS sx, round(avg(v), 6) AS y, count(*) AS n FROM r1 WHERE (x + 4) // 8 < 8 GROUP BY 1, 2")
def agg06(spark, sf):
    return A.footprint_mean(r1(spark, sf), "v", "y", 8, None, 8, "n").withColumn("y", F.round("y", 6))


@query("agg07_lapse", f"""WITH {R1}, d AS (SELECT z, x, v AS h, 30.0 - 0.1 * v + (x % 3) AS t FROM r1), s AS (SELECT max(z) AS mz FROM d),
 w AS (SELECT d.z, d.x, d.h, d.t, a, b, greatest(least(d.z + a, mz), 0) AS nz, greatest(least(d.x + b, 63), 0) AS nx FROM d, s, (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b)),
 m AS (SELECT w.z, w.x, any_value(w.h) AS h, any_value(w.t) AS t, avg(n.h) AS hm, avg(n.t) AS tm FROM w JOIN d n ON n.z = nz AND n.x = nx GROUP BY 1, 2)
 SELECT round(greatest(least(sum((h - hm) * (t - tm)) / sum((h - hm) * (h - hm)), 0), -0.5), 6)::DOUBLE AS lapse FROM m""")
def agg07(spark, sf):
    d = r1(spark, sf).select("z", "x", F.col("v").cast("double").alias("h"), (30.0 - 0.1 * F.col("v") + F.col("x") % 3).alias("t"))
    return A.lapse_rate(d, "h", "t", 5).select(F.round("lapse", 6).alias("lapse"))


@query("agg08_group_min", f"WITH {R4} SELECT way, ord, min(level) OVER (PARTITION BY cell) AS low FROM r4")
def agg08(spark, sf):
    return A.group_min(r4(spark, sf), ["cell"], "level", "low").select("way", "ord", "low")


@query("agg10_counts", f"WITH {R3} SELECT count(*) FILTER (WHERE river) AS rivers, count(*) FILTER (WHERE lake) AS lakes, count(*) AS cells FROM r3")
def agg10(spark, sf):
    return r3(spark, sf).agg(F.count_if("river").alias("rivers"), F.count_if("lake").alias("lakes"), F.count(F.lit(1)).alias("cells"))


@query("agg11_distinct_classes", f"WITH {R3} SELECT DISTINCT vegetation FROM r3")
def agg11(spark, sf):
    return r3(spark, sf).select("vegetation").distinct()


@query("agg12_argmin", f"WITH {R4} SELECT way, level, ord FROM (SELECT *, row_number() OVER (PARTITION BY way ORDER BY level, ord) AS n FROM r4) WHERE n = 1")
def agg12(spark, sf):
    return A.argmin(r4(spark, sf), ["way"], "level", ["ord"], "level")


@query("agg13_any_all", f"WITH {R3} SELECT z, bool_or(river) AS any_river, bool_and(land > 0) AS all_land FROM r3 GROUP BY z")
def agg13(spark, sf):
    return r3(spark, sf).groupBy("z").agg(F.bool_or("river").alias("any_river"), F.bool_and(F.col("land") > 0).alias("all_land"))


@query("agg14_month_array", f"WITH {R5} SELECT sample, CAST(floor(sum(t) / 120.0 * 1000 + 0.25) AS BIGINT) AS mean, CAST(floor(max(t) * 0.1 * 1000 + 0.25) AS BIGINT) AS warm FROM r5 GROUP BY sample")
def agg14(spark, sf):
    m = r5(spark, sf).filter("t IS NOT NULL").groupBy("sample").agg(F.transform(F.sort_array(F.collect_list(F.struct("month", "t"))), lambda r: r["t"]).alias("m"))
    return m.select("sample", F.floor(S.annual_mean(F.col("m")) * 1000 + 0.25).alias("mean"), F.floor(S.warmest(F.col("m")) * 1000 + 0.25).alias("warm"))


@query("agg15_chunk_max", f"WITH {R1} SELECT CAST(z // 32 AS BIGINT) AS cz, CAST(x // 32 AS BIGINT) AS cx, max(v) AS top FROM r1 GROUP BY 1, 2")
def agg15(spark, sf):
    return r1(spark, sf).groupBy(F.floor(F.col("z") / 32).alias("cz"), F.floor(F.col("x") / 32).alias("cx")).agg(F.max("v").alias("top"))


@query("agg16_digest", f"WITH {R1}, t AS (SELECT z, string_agg(v, ',' ORDER BY x) AS d FROM r1 GROUP BY z) SELECT CAST(z // 50 AS BIGINT) AS g, sha256(string_agg(sha256(d), '' ORDER BY z)) AS digest FROM t GROUP BY 1")
def agg16(spark, sf):
    rows = r1(spark, sf).groupBy("z").agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("_l"))
    rows = rows.select("z", F.floor(F.col("z") / 50).alias("g"), F.array_join(F.transform("_l", lambda p: p["v"].cast("string")), ",").alias("d"))
    return A.ordered_digest(rows, ["g"], ["z"], "d", "digest")


_DIST6 = "(SELECT unnest(range(-6, 7)) AS a), (SELECT unnest(range(-6, 7)) AS b)"


@query("agg17_lake_ownership", f"WITH {R7_CELLS}, w AS (SELECT z, x, min(id) AS id FROM r7c GROUP BY 1, 2), s AS (SELECT z + a AS z, x + b AS x, id, abs(a) + abs(b) AS d FROM w, {_DIST6} WHERE abs(a) + abs(b) BETWEEN 1 AND 6), n AS (SELECT *, row_number() OVER (PARTITION BY z, x ORDER BY d, id) AS k FROM s WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.z = s.z AND w.x = s.x)) SELECT CAST(z AS INT) AS z, CAST(x AS INT) AS x, id AS lake, CAST(d AS INT) AS distance FROM n WHERE k = 1 AND z >= 0 AND x >= 0 AND z < 500 AND x < 64")
def agg17(spark, sf):
    w = _box_cells(spark, sf).groupBy("z", "x").agg(F.min("id").alias("lake"))
    ring = [(a, b) for a in range(-6, 7) for b in range(-6, 7) if 0 < abs(a) + abs(b) <= 6]
    s = D.around(w, ring).select(F.col("nz").alias("z"), F.col("nx").alias("x"), "lake", (F.abs("dz") + F.abs("dx")).alias("distance"))
    return A.own_banks(s.filter(F.col("z").between(0, 499) & F.col("x").between(0, 63)), w)


# ---- stencils --------------------------------------------------------------------------------


def _win(fn: str, h0: int, h1: int, src: str = "r1", col: str = "v", out: str = "m") -> str:
    return f"SELECT z, x, {fn}(a) OVER (PARTITION BY x ORDER BY z ROWS BETWEEN {h0} PRECEDING AND {h1} FOLLOWING) AS {out} FROM (SELECT z, x, {fn}({col}) OVER (PARTITION BY z ORDER BY x ROWS BETWEEN {h0} PRECEDING AND {h1} FOLLOWING) AS a FROM {src})"


@query("stn01_min3", f"WITH {R1} {_win('min', 1, 1)}")
def stn01(spark, sf):
    return T.min_filter(r1(spark, sf), "v", "m", 3).select("z", "x", "m")


@query("stn02_min5", f"WITH {R1} {_win('min', 2, 2)}")
def stn02(spark, sf):
    return T.min_filter(r1(spark, sf), "v", "m", 5).select("z", "x", "m")


@query("stn02_min4_even", f"WITH {R1} {_win('min', 2, 1)}")
def stn02e(spark, sf):
    return T.min_filter(r1(spark, sf), "v", "m", 4).select("z", "x", "m")


_CLAMP = f"s AS (SELECT max(z) AS mz FROM r1), w AS (SELECT r1.z, r1.x, greatest(least(r1.z + dz, mz), 0) AS nz, greatest(least(r1.x + dx, 63), 0) AS nx FROM r1, s, {_N8})"


@query("stn03_median3", f"WITH {R1}, {_CLAMP} SELECT w.z, w.x, list_sort(list(n.v))[5] AS m FROM w JOIN r1 n ON n.z = nz AND n.x = nx GROUP BY 1, 2")
def stn03(spark, sf):
    return T.median3(r1(spark, sf), "v", "m").select("z", "x", "m")


@query("stn04_dilate4", f"WITH {R3}, k AS MATERIALIZED (SELECT unnest([0, 0, 0, 1, -1]) AS a, unnest([0, 1, -1, 0, 0]) AS b), w AS MATERIALIZED (SELECT z, x FROM r3 WHERE lake), d AS MATERIALIZED (SELECT DISTINCT z + a AS z, x + b AS x FROM w, k) SELECT r3.z, r3.x, d.z IS NOT NULL AS touch FROM r3 LEFT JOIN d ON d.z = r3.z AND d.x = r3.x")
def stn04(spark, sf):
    return T.dilate4(r3(spark, sf), "lake", "touch").select("z", "x", "touch")


@query("stn06_mean5", f"WITH {R1}, s AS (SELECT max(z) AS mz FROM r1), w AS (SELECT r1.z, r1.x, greatest(least(r1.z + a, mz), 0) AS nz, greatest(least(r1.x + b, 63), 0) AS nx FROM r1, s, (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b)) SELECT w.z, w.x, round(avg(n.v), 6) AS m FROM w JOIN r1 n ON n.z = nz AND n.x = nx GROUP BY 1, 2")
def stn06(spark, sf):
    return T.mean_filter(r1(spark, sf), "v", "m", 5).select("z", "x", F.round("m", 6).alias("m"))


@query("stn07_sampling_floor", f"WITH {R3}, f AS ({_win('min', 2, 2, 'r3', 'height', 'floor5')}), o AS ({_win('min', 1, 1, 'r3', 'land', 'land3')}) SELECT r3.z, r3.x, floor5, land3 = 0 AS ocean_near FROM r3 JOIN f USING (z, x) JOIN o USING (z, x) WHERE river")
def stn07(spark, sf):
    df = T.min_filter(T.min_filter(r3(spark, sf), "height", "floor5", 5), "land", "land3", 3)
    return df.filter("river").select("z", "x", "floor5", (F.col("land3") == 0).alias("ocean_near"))


@query("stn09_opening5", f"WITH {R1}, m AS (SELECT z, x, CASE WHEN v >= 120 THEN v END AS v FROM r1), a AS ({_win('min', 2, 2, 'm', 'v', 'lo')}), b AS (SELECT a.z, a.x, CASE WHEN m.v IS NOT NULL THEN lo END AS lo FROM a JOIN m USING (z, x)), c AS ({_win('max', 2, 2, 'b', 'lo', 'hi')}) SELECT z, x, least(m.v, hi) AS m FROM m JOIN c USING (z, x) WHERE m.v IS NOT NULL")
def stn09(spark, sf):
    df = r1(spark, sf).withColumn("_k", F.col("v") >= 120)
    return T.opening(df, "v", "_k", "m", 5).filter("_k").select("z", "x", "m")


@query("stn10_slope", f"WITH {R1} SELECT z, x, greatest(coalesce(abs(v - lag(v) OVER r), 0), coalesce(abs(v - lead(v) OVER r), 0), coalesce(abs(v - lag(v) OVER c), 0), coalesce(abs(v - lead(v) OVER c), 0)) AS slope FROM r1 WINDOW r AS (PARTITION BY z ORDER BY x), c AS (PARTITION BY x ORDER BY z)")
def stn10(spark, sf):
    return T.slope(r1(spark, sf), "v", "slope").select("z", "x", "slope")


def _hash_sql(x: str, z: str) -> str:
    m = 4294967296
    return f"""h0 AS (SELECT *, xor((({x})::HUGEINT * 2654435761 % {m})::BIGINT, (({z})::HUGEINT * 2246822519 % {m})::BIGINT) AS n FROM src),
 h1 AS (SELECT * REPLACE (((xor(n, n >> 16))::HUGEINT * 2146121005 % {m})::BIGINT AS n) FROM h0), h2 AS (SELECT * REPLACE (((xor(n, n >> 15))::HUGEINT * 2221713035 % {m})::BIGINT AS n) FROM h1), h AS (SELECT * REPLACE (xor(n, n >> 16) AS n) FROM h2)"""


@query("fun08_cell_hash", f"WITH {R1}, src AS (SELECT z, x FROM r1), {_hash_sql('x', 'z')} SELECT z, x, n FROM h")
def fun08(spark, sf):
    return r1(spark, sf).select("z", "x", S.cell_hash(F.col("x"), F.col("z")).alias("n"))


@query("stn11_feather", f"WITH {R3}, src AS (SELECT z, x, land, vegetation FROM r3), {_hash_sql('x', 'z')}, s AS (SELECT max(z) AS mz FROM r3), o AS (SELECT h.*, greatest(least(x + (n & 255) % 5 + ((n >> 8) & 255) % 5 - 4, 63), 0) AS sx, greatest(least(z + ((n >> 16) & 255) % 5 + (n >> 24) % 5 - 4, mz), 0) AS sz FROM h, s) SELECT o.z, o.x, CASE WHEN o.land <> 0 AND q.land <> 0 AND q.vegetation <> 0 THEN q.vegetation ELSE o.vegetation END AS vegetation FROM o JOIN r3 q ON q.z = sz AND q.x = sx")
def stn11(spark, sf):
    c = r3(spark, sf).select("z", "x", "land", "vegetation")
    return D.feather(c, "vegetation", "land", "out", None, 64).select("z", "x", F.col("out").alias("vegetation"))


@query("stn12_prefix_sum", f"WITH {R1} SELECT z, x, CAST(sum(v) OVER (PARTITION BY z ORDER BY x) AS BIGINT) AS s FROM r1")
def stn12(spark, sf):
    return T.running_sum(r1(spark, sf), "z", "x", "v", "s").select("z", "x", "s")


@query("stn13_downstream_min", f"WITH {R4} SELECT way, ord, min(level) OVER (PARTITION BY way ORDER BY ord) AS low FROM r4")
def stn13(spark, sf):
    return T.running_min(r4(spark, sf), "way", "ord", "level", "low").select("way", "ord", "low")


@query("stn14_drop_repeats", f"WITH {R1}, q AS (SELECT z, x, v // 20 AS k, lag(v // 20) OVER (PARTITION BY z ORDER BY x) AS p FROM r1) SELECT z, x, CAST(k AS BIGINT) AS k FROM q WHERE p IS NULL OR p <> k")
def stn14(spark, sf):
    c = r1(spark, sf).select("z", "x", F.floor(F.col("v") / 20).alias("k"))
    return T.drop_repeats(c, "z", "x", "k").select("z", "x", "k")


@query("stn15_halo", f"WITH {R1}, t AS (SELECT z, x, v, unnest(list_distinct([(z - 2) // 16, z // 16, (z + 2) // 16])) AS tz FROM r1), u AS (SELECT *, unnest(list_distinct([(x - 2) // 16, x // 16, (x + 2) // 16])) AS tx FROM t) SELECT CAST(tz AS BIGINT) AS tz, CAST(tx AS BIGINT) AS tx, count(*) AS n, count(*) FILTER (WHERE z // 16 = tz AND x // 16 = tx) AS core FROM u WHERE tz >= 0 AND tx >= 0 GROUP BY 1, 2")
def stn15(spark, sf):
    return T.halo(r1(spark, sf), 16, 2).filter("tz >= 0 AND tx >= 0").groupBy("tz", "tx").agg(F.count(F.lit(1)).alias("n"), F.count_if("core").alias("core"))


def _dist_sql(metric: str, cap: int) -> str:
    return f"WITH {R3}, k AS MATERIALIZED (SELECT a, b, {metric} AS m FROM (SELECT unnest(range(-{cap}, {cap} + 1)) AS a), (SELECT unnest(range(-{cap}, {cap} + 1)) AS b) WHERE {metric} <= {cap}), w AS MATERIALIZED (SELECT z, x FROM r3 WHERE lake), n AS MATERIALIZED (SELECT z + a AS z, x + b AS x, min(m) AS d FROM w, k GROUP BY 1, 2) SELECT r3.z, r3.x, CAST(d AS INT) AS d FROM r3 LEFT JOIN n ON n.z = r3.z AND n.x = r3.x"


@query("dst01_chessboard", _dist_sql("greatest(abs(a), abs(b))", 12))
def dst01(spark, sf):
    return T.capped_distance(r3(spark, sf), "lake", 12, "d").select("z", "x", F.col("d").cast("int").alias("d"))


@query("dst02_taxicab", _dist_sql("abs(a) + abs(b)", 6))
def dst02(spark, sf):
    return T.capped_distance(r3(spark, sf), "lake", 6, "d", taxicab=True).select("z", "x", F.col("d").cast("int").alias("d"))


@query("dst03_fill", f"""WITH {R2}, g AS MATERIALIZED (SELECT CAST(a AS INT) AS z, CAST(b AS INT) AS x FROM (SELECT unnest(range(0, 100)) AS a), (SELECT unnest(range(0, 250)) AS b)), h AS (SELECT z, x FROM g ANTI JOIN r2 USING (z, x)),
 j AS (SELECT h.z, h.x, arg_min(r.v, ((h.z - r.z) * (h.z - r.z) + (h.x - r.x) * (h.x - r.x))::BIGINT * 1000000 + r.z * 1000 + r.x) AS v FROM h, r2 r GROUP BY 1, 2) SELECT z, x, v FROM r2 UNION ALL SELECT z, x, v FROM j""")
def dst03(spark, sf):
    return D.fill_nearest(_dense_r2(spark, sf), "v", "out").select("z", "x", F.col("out").alias("v"))


@query("dst04_anisotropic", f"WITH {R3}, k AS (SELECT z, x FROM r3 WHERE river AND (z * 64 + x) % 7 = 0), j AS (SELECT c.z, c.x, k.z AS nz, k.x AS nx, (2.0 * (k.z - c.z)) ** 2 + (k.x - c.x) ** 2 AS d2, row_number() OVER (PARTITION BY c.z, c.x ORDER BY (2.0 * (k.z - c.z)) ** 2 + (k.x - c.x) ** 2, k.z, k.x) AS n FROM r3 c JOIN k ON abs(k.z - c.z) <= 3 AND abs(k.x - c.x) <= 3) SELECT z, x, nz, nx, d2::DOUBLE AS d2 FROM j WHERE n = 1")
def dst04(spark, sf):
    c = r3(spark, sf)
    return D.nearest_within(c, c.filter("river AND (z * 64 + x) % 7 = 0"), 3, sz=2.0).filter("nz IS NOT NULL")


# ---- resampling, rasterization ---------------------------------------------------------------


@query("rsm03_nearest", f"WITH {R1}, s AS (SELECT CAST(max(z) + 1 AS INT) AS h FROM r1), t AS (SELECT CAST(a AS INT) AS z, least(CAST(floor((a + 0.5) * (h / 300.0::DOUBLE)) AS INT), h - 1) AS sz FROM s, (SELECT unnest(range(0, 300)) AS a)), u AS (SELECT CAST(b AS INT) AS x, least(CAST(floor((b + 0.5) * (64 / 100.0::DOUBLE)) AS INT), 63) AS sx FROM (SELECT unnest(range(0, 100)) AS b)) SELECT t.z, u.x, r1.v FROM t, u, r1 WHERE r1.z = sz AND r1.x = sx")
def rsm03(spark, sf):
    c = r1(spark, sf)
    return R.resize_nearest(c, "v", (None, 64), (300, 100))


def _weights_sql(name: str, src: str, dst: int) -> str:
    return f"""{name}c AS (SELECT CAST(i AS INT) AS i, (i + 0.5) * (n / {dst}.0::DOUBLE) AS c, greatest(1.0::DOUBLE, n / {dst}.0::DOUBLE) AS s, n FROM {src}, (SELECT unnest(range(0, {dst})) AS i)),
 {name}e AS (SELECT i, c, s, unnest(range(greatest(0, CAST(floor(c - s + 0.5) AS INT)), least(n, CAST(floor(c + s + 0.5) AS INT)))) AS k FROM {name}c),
 {name}w AS (SELECT i, k, greatest(0.0, 1.0 - abs((k - c + 0.5) / s)) AS w FROM {name}e),
 {name} AS (SELECT i, k, CAST(floor(w / sum(w) OVER (PARTITION BY i) * 4194304 + 0.5) AS BIGINT) AS q FROM {name}w)"""


@query("rsm04_bilinear", f"WITH {R1}, hn AS (SELECT 64 AS n), vn AS (SELECT CAST(max(z) + 1 AS INT) AS n FROM r1), {_weights_sql('hw', 'hn', 90)}, {_weights_sql('vw', 'vn', 230)}, m AS (SELECT r1.z, hw.i AS x, greatest(0, least(255, (sum(q * v)::BIGINT + 2097152) >> 22)) AS v FROM r1 JOIN hw ON hw.k = r1.x GROUP BY 1, 2) SELECT vw.i AS z, m.x, CAST(greatest(0, least(255, (sum(q * v)::BIGINT + 2097152) >> 22)) AS INT) AS v FROM m JOIN vw ON vw.k = m.z GROUP BY 1, 2")
def rsm04(spark, sf):
    c = r1(spark, sf)
    return R.resize_bilinear(c, "v", (None, 64), (230, 90))


@query("ras01_polygon_fill", f"WITH {R7_CELLS} SELECT id, z, x FROM r7c WHERE x < 64")
def ras01(spark, sf):
    return _box_cells(spark, sf)


@query("vec05_line_length", f"WITH {R4} SELECT way, round(sum(CASE WHEN p IS NULL THEN 0.0 ELSE sqrt((level - p) ** 2 + 1) END), 6) AS len FROM (SELECT way, ord, level, lag(level) OVER (PARTITION BY way ORDER BY ord) AS p FROM r4) GROUP BY way")
def vec05(spark, sf):
    w = r4(spark, sf).groupBy("way").agg(F.sort_array(F.collect_list(F.struct("ord", "level"))).alias("_l"))
    pts = F.transform("_l", lambda p: F.struct(p["ord"].cast("double").alias("x"), p["level"].cast("double").alias("y")))
    return w.select("way", pts.alias("pts")).select("way", F.round(V.length(F.col("pts")), 6).alias("len"))


@query("vec07_pixel_window", f"WITH {R7} SELECT id, greatest(x0 - 14, 0) AS wx0, greatest(z0 - 14, 0) AS wz0, least(x0 + 19, 64) AS wx1, least(z0 + 19, 500) AS wz1 FROM r7")
def vec07(spark, sf):
    b = r7(spark, sf).withColumn("pts", V.box_ring(F.col("x0"), F.col("z0"), F.col("x0") + 5, F.col("z0") + 5))
    return b.select("id", *(v.alias(k) for k, v in V.pixel_window(F.col("pts"), 14, 64, 500).items()))


@query("vec10_bank_height", "WITH q AS (SELECT p_partkey AS part, p_size * 4 AS n, 100 AS v, CAST(1 + p_partkey % 6 AS INT) AS d FROM part) SELECT part, CASE WHEN d = 1 THEN v WHEN d = 6 THEN n WHEN n < v THEN CAST(greatest(least(round_even(v + (n - v) * (d - 1) / 5.0::DOUBLE, 0), 255), 1) AS INT) ELSE greatest(least(least(n, v + d), 255), 1) END AS h FROM q")
def vec10(spark, sf):
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), (F.col("p_size") * 4).alias("n"), (1 + F.col("p_partkey") % 6).cast("int").alias("d"))
    return q.select("part", V.bank_height(F.col("n"), F.lit(100), F.col("d")).alias("h"))


# ---- scalar functions ------------------------------------------------------------------------


@query("fun02_03_rounding", "SELECT p_partkey AS part, CAST(round_even(p_size / 2.0::DOUBLE, 0) AS INT) AS r, CAST(trunc((p_size - 25) / 2.0::DOUBLE) AS INT) AS t FROM part")
def fun02(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("part"), S.rint(F.col("p_size") / 2).cast("int").alias("r"), S.truncate((F.col("p_size") - 25) / 2).alias("t"))


@query("fun06_smoothstep", f"WITH {R6} SELECT part, round({SS('0.07', '0.55', 'wet')}, 6) AS s, CAST(greatest(least(round_even(200 * wet, 0), 255), 0) AS INT) AS b FROM r6")
def fun06(spark, sf):
    return r6(spark, sf).select("part", F.round(S.smoothstep(0.07, 0.55, F.col("wet")), 6).alias("s"), S.scale_byte(F.lit(200), F.col("wet")).alias("b"))


@query("fun10_tile_key", f"WITH {R1} SELECT z, x, (CAST(x - 30 AS BIGINT) * 4294967296 + CAST(z AS BIGINT)) AS k, x - 30 AS kx, z AS kz FROM r1")
def fun10(spark, sf):
    k = r1(spark, sf).select("z", "x", S.tile_key(F.col("x") - 30, F.col("z")).alias("k"))
    return k.select("z", "x", "k", S.tile_x(F.col("k")).alias("kx"), S.tile_z(F.col("k")).alias("kz"))


@query("fun11_flat_index", f"WITH {R1} SELECT z * 64 + x AS pixel, z AS r, x AS c FROM r1")
def fun11(spark, sf):
    p = r1(spark, sf).select((F.col("z") * 64 + F.col("x")).alias("pixel"))
    return p.select("pixel", S.flat_row(F.col("pixel"), 64).alias("r"), S.flat_col(F.col("pixel"), 64).alias("c"))


@query("fun12_month_position", f"WITH {R6} SELECT part, round(((wet * 12 - 0.5) % 12 + 12) % 12, 6)::DOUBLE AS p FROM r6")
def fun12(spark, sf):
    return r6(spark, sf).select("part", F.round(S.month_position(F.col("wet")), 6).alias("p"))


@query("fun13_wetness", "SELECT p_partkey AS part, round(least(p_size * 30.0 / (p_size * 30 + greatest(p_retailprice, 1.0)), least(1.0, p_size * 30 / 200.0)), 6) AS w FROM part")
def fun13(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.round(S.wetness(F.col("p_size") * 30.0, F.col("p_retailprice")), 6).alias("w"))


_U = SS("0.015", "0.25", "wet")
_G = f"least({SS('5.0', '12.0', 'warmest')}, {SS('-18.0', '-2.0', 'annual')}, 1.0 - {SS('32.0', '42.0', 'annual')})"
_BYTE = lambda b, f: f"CAST(round_even({b} * greatest(least({f}, 1.0), 0.0), 0) AS INT)"


@query("fun16_profile", f"""WITH {R6}, {_PROFILE}, q AS (SELECT part, r6.biome, warmest, annual, wet, forest0, shrub0, grass0, fertility0, soil0, bare0, forest0 IS NULL AS none FROM r6 LEFT JOIN bp ON bp.biome = r6.biome)
 SELECT part, CASE WHEN none OR warmest < 10 THEN 0 ELSE {_BYTE('forest0', f"{_G} * {SS('0.07', '0.55', 'wet')}")} END AS forest, CASE WHEN none THEN 0 ELSE {_BYTE('shrub0', f'{_G} * (0.35 + 0.65 * {_U})')} END AS shrub,
 round(CASE WHEN none THEN 0.0 ELSE grass0 * {_G} * {_U} END, 6)::DOUBLE AS grass, (CASE WHEN none THEN 0.0 WHEN warmest < 5 OR wet < 0.08 THEN 0.10 WHEN fertility0 > 0.35 AND wet < 0.20 THEN 0.35 ELSE fertility0 END)::DOUBLE AS fertility,
 CASE WHEN none THEN 0 WHEN warmest < 5 OR wet < 0.04 THEN least(soil0, 1) ELSE soil0 END AS soil, coalesce(bare0, false) AS bare, NOT none AND warmest < 5 AS snow FROM q""")
def fun16(spark, sf):
    p = M.vegetation_profile(r6(spark, sf))
    return p.select("part", "forest", "shrub", F.round("grass", 6).alias("grass"), "fertility", "soil", "bare", "snow")


@query("fun18_ground_cover", """WITH q AS (SELECT p_partkey AS part, (p_partkey % 11) / 10.0::DOUBLE AS fert, (p_partkey % 7) / 7.0::DOUBLE AS cover, (p_partkey % 13) / 13.0::DOUBLE AS grass, p_size * 5 AS forest, CAST(p_size % 33 AS INT) AS biome, CAST(p_partkey % 40 - 20 AS DOUBLE) AS t, p_partkey % 3 = 0 AS near, (p_partkey % 17) / 17.0::DOUBLE AS roll FROM part),
 a AS (SELECT *, greatest(CASE WHEN fert >= 0.7 THEN 3 WHEN fert >= 0.3 THEN 2 WHEN fert >= 0.15 THEN 1 ELSE 0 END, CASE WHEN near THEN 2 ELSE 0 END) AS fc, CASE WHEN near AND t >= -10 THEN greatest(grass, least(0.2, 0.08 + 0.6 * grass)) ELSE grass END AS g, CASE WHEN cover >= 0.65 THEN 3 WHEN cover >= 0.3 THEN 2 WHEN cover >= 0.1 THEN 1 ELSE 0 END AS c FROM q)
 SELECT part, fc AS fertility_class, round(g, 6)::DOUBLE AS grass_used, CASE WHEN t < -10 THEN 0 WHEN fc < 2 AND roll > g THEN 0 WHEN near AND c = 0 AND g > 0 THEN 1 WHEN fc >= 2 AND c = 0 THEN 1 ELSE c END AS cover_class,
 CASE WHEN forest >= 96 AND biome IN (1, 2, 3, 4, 7, 8, 9, 13, 14, 15, 17) AND t >= -10 THEN greatest(least((forest - 64) // 32, 7), 1) ELSE -1 END AS forest_stage FROM a""")
def fun18(spark, sf):
    k = F.col("p_partkey")
    c = M.ground_cover(k % 11 / 10.0, k % 7 / 7.0, k % 13 / 13.0, F.col("p_size") * 5, F.col("p_size") % 33, (k % 40 - 20).cast("double"), k % 3 == 0, k % 17 / 17.0)
    c["grass_used"] = F.round(c["grass_used"], 6)
    return table(spark, sf, "part").select(k.alias("part"), *(v.alias(n) for n, v in c.items()))


@query("fun19_surface", """WITH q AS (SELECT p_partkey AS part, p_partkey % 5 = 0 AS bare, CAST(p_partkey % 5 AS INT) AS soil, CAST(p_partkey % 4 AS INT) AS slope, p_partkey % 3 = 0 AS near, CAST(p_size % 33 AS INT) AS biome, (p_partkey % 101) / 100.0::DOUBLE AS wet, (p_partkey % 19) / 19.0::DOUBLE AS r1, (p_partkey % 23) / 23.0::DOUBLE AS r2 FROM part),
 a AS (SELECT *, r1 < greatest(least(CASE WHEN bare THEN 0.45 ELSE 0.03 END + 0.14 * slope - CASE WHEN near THEN 0.22 ELSE 0.0 END, 0.95), 0.0) OR soil = 0 AS rock FROM q)
 SELECT part, CASE WHEN rock THEN 'rock' WHEN biome = 27 AND wet < 0.2 AND slope < 1 AND r2 < 0.5 THEN 'sand' ELSE 'soil' END AS kind, CASE WHEN rock THEN 0 ELSE greatest(least(soil - slope + CASE WHEN near THEN 1 ELSE 0 END, 4), 1) END AS depth FROM a""")
def fun19(spark, sf):
    k = F.col("p_partkey")
    s = M.surface_kind(k % 5 == 0, (k % 5).cast("int"), (k % 4).cast("int"), k % 3 == 0, F.col("p_size") % 33, k % 101 / 100.0, k % 19 / 19.0, k % 23 / 23.0)
    return table(spark, sf, "part").select(k.alias("part"), *(v.alias(n) for n, v in s.items()))


@query("fun20_21_snow", "SELECT p_partkey AS part, round(CASE WHEN t > 1.5 OR (r < 0.05 AND t > 0) THEN -t / 15.0 ELSE r / 3.0 END, 6)::DOUBLE AS rate, t <= 0 AND p_size % 2 = 0 AS layer FROM (SELECT p_partkey, p_size, (p_partkey % 80) / 10.0::DOUBLE - 4 AS t, (p_partkey % 10) / 10.0::DOUBLE AS r FROM part)")
def fun20(spark, sf):
    k = F.col("p_partkey")
    t, r = k % 80 / 10.0 - 4, k % 10 / 10.0
    return table(spark, sf, "part").select(k.alias("part"), F.round(S.snow_rate(t, r), 6).alias("rate"), M.snow_layer(t, F.col("p_size") % 2 == 0, F.lit(False)).alias("layer"))


# ---- sort, sets, graph -----------------------------------------------------------------------


@query("srt04_nearest_tiles", f"WITH {R8}, t AS (SELECT DISTINCT player, tile FROM r8) SELECT player, tile FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY abs(tile - player % 40), tile) AS n FROM t) WHERE n <= 16")
def srt04(spark, sf):
    w = W.partitionBy("player").orderBy(F.abs(F.col("tile") - F.col("player") % 40), "tile")
    return r8(spark, sf).select("player", "tile").distinct().withColumn("_n", F.row_number().over(w)).filter("_n <= 16").select("player", "tile")


@query("set01_held_and_desired", f"WITH {R8}, h AS (SELECT DISTINCT player, tile FROM r8 WHERE NOT release), d AS (SELECT DISTINCT player, (tile + 1) % 40 AS tile FROM r8) SELECT *, 'request' AS act FROM (SELECT player, CAST(tile AS INT) AS tile FROM d EXCEPT SELECT player, tile FROM h) UNION ALL SELECT *, 'release' AS act FROM (SELECT player, tile FROM h EXCEPT SELECT player, CAST(tile AS INT) FROM d)")
def set01(spark, sf):
    q = r8(spark, sf)
    held = q.filter("NOT release").select("player", "tile").distinct()
    want = q.select("player", ((F.col("tile") + 1) % 40).alias("tile")).distinct()
    return want.subtract(held).withColumn("act", F.lit("request")).unionAll(held.subtract(want).withColumn("act", F.lit("release")))


_EDGES = f"WITH RECURSIVE {R3}, c AS (SELECT z * 64 + x AS id, z, x FROM r3 WHERE river), e AS (SELECT a.id AS src, b.id AS dst FROM c a JOIN c b ON b.z BETWEEN a.z - 1 AND a.z + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND a.id <> b.id)"


@query("gra01_components", f"{_EDGES}, r AS (SELECT id, id AS m FROM c UNION SELECT dst, m FROM r JOIN e ON r.id = e.src WHERE m < dst) SELECT id, min(m) AS component FROM r GROUP BY id")
def gra01(spark, sf):
    c = _river_cells(spark, sf)
    return G.components(spark, G.neighbour_edges(c), c)


@query("gra09_level_surface", f"{_EDGES}, lv AS (SELECT z * 64 + x AS id, height AS level FROM r3 WHERE river), r AS (SELECT id, level FROM lv UNION SELECT dst, r.level + 1 FROM r JOIN e ON r.id = e.src JOIN lv ON lv.id = dst WHERE r.level + 1 < lv.level) SELECT id, min(level) AS level FROM r GROUP BY id")
def gra09(spark, sf):
    return G.level_surface(spark, _river_cells(spark, sf), width=64)


_ARCS = f"WITH RECURSIVE {R4}, lv AS MATERIALIZED (SELECT cell AS id, max(level) AS level FROM r4 GROUP BY 1), e AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT cell AS src, lead(cell) OVER (PARTITION BY way ORDER BY ord) AS dst FROM r4) WHERE dst IS NOT NULL AND dst <> src)"


@query("gra06_step_limit", f"{_ARCS}, r AS (SELECT id, level FROM lv UNION SELECT src, r.level + 1 FROM r JOIN e ON r.id = e.dst JOIN lv ON lv.id = src WHERE r.level + 1 < lv.level) SELECT id, min(level) AS level FROM r GROUP BY id")
def gra06(spark, sf):
    w = r4(spark, sf)
    cells = w.groupBy(F.col("cell").alias("id")).agg(F.max("level").alias("level"))
    nxt = w.withColumn("dst", F.lead("cell").over(W.partitionBy("way").orderBy("ord"))).filter("dst IS NOT NULL").select(F.col("cell").alias("src"), "dst")
    return G.step_limit(spark, cells, nxt)


@query("gra10_downstream", f"{_ARCS}, r AS (SELECT id, level FROM lv UNION SELECT dst, r.level FROM r JOIN e ON r.id = e.src JOIN lv ON lv.id = dst WHERE r.level < lv.level) SELECT id, min(level) AS level FROM r GROUP BY id")
def gra10(spark, sf):
    w = r4(spark, sf)
    cells = w.groupBy(F.col("cell").alias("id")).agg(F.max("level").alias("level"))
    return G.lowered(spark, cells, w)


_MEDIAN = "s AS (SELECT max(z) AS mz FROM r3), w AS (SELECT r3.z, r3.x, greatest(least(r3.z + dz, mz), 0) AS nz, greatest(least(r3.x + dx, 63), 0) AS nx FROM r3, s, " + _N8 + ")"
_BOUNDS = f"""WITH {R3}, p AS MATERIALIZED (SELECT *, CASE WHEN NOT river AND NOT lake THEN height ELSE 255 END AS dry, CASE WHEN lake THEN height ELSE 255 END AS lk FROM r3),
 ce AS ({_win('min', 1, 1, 'p', 'dry', 'ceiling')}), ft AS MATERIALIZED (SELECT z, x, CASE WHEN river THEN least(height, ceiling) ELSE height END AS fit FROM p JOIN ce USING (z, x)),
 fl AS MATERIALIZED ({_win('min', 2, 2, 'ft', 'fit', 'floor')}), {_MEDIAN}, md AS (SELECT w.z, w.x, list_sort(list(n.floor))[5] AS med FROM w JOIN fl n ON n.z = nz AND n.x = nx GROUP BY 1, 2),
 tc AS (SELECT DISTINCT z + a AS z, x + b AS x FROM r3, (SELECT unnest([0, 0, 1, -1]) AS a, unnest([1, -1, 0, 0]) AS b) WHERE lake), lm AS ({_win('min', 1, 1, 'p', 'lk', 'lmin')})
 SELECT p.z, p.x, ceiling, fit, fl.floor, CASE WHEN tc.z IS NOT NULL THEN lmin ELSE least(fl.floor, med) END AS surface0
 FROM p JOIN ce USING (z, x) JOIN ft USING (z, x) JOIN fl USING (z, x) JOIN md USING (z, x) JOIN lm USING (z, x) LEFT JOIN tc ON tc.z = p.z AND tc.x = p.x WHERE river"""


@query("river_bounds", _BOUNDS)
def river_bounds(spark, sf):
    return M.river_bounds(r3(spark, sf).select("z", "x", "height", "river", "lake")).filter("river").select("z", "x", "ceiling", "fit", "floor", "surface0")


_BANK = "CASE WHEN d = 1 THEN level WHEN d = 6 THEN height WHEN height < level THEN CAST(greatest(least(round_even(level + (height - level) * (d - 1) / 5.0::DOUBLE, 0), 255), 1) AS INT) ELSE greatest(least(least(height, level + d), 255), 1) END"
_LAKES = f"""WITH {R3}, {R7_CELLS}, c AS MATERIALIZED (SELECT z, x, height, land FROM r3),
 l AS MATERIALIZED (SELECT z, x, min(id) AS lake, bool_or(id % 7 = 0) AS saline FROM r7c WHERE x < 64 AND z < 500 GROUP BY 1, 2),
 lv AS (SELECT lake, CAST(quantile_disc(height, 0.5) AS INT) AS level FROM l JOIN c USING (z, x) GROUP BY lake), sl AS (SELECT lake, bool_or(saline) AS saline FROM l GROUP BY lake),
 dry AS (SELECT z, x FROM c ANTI JOIN l USING (z, x)), o AS (SELECT unnest(range(-12, 13)) AS a), o2 AS MATERIALIZED (SELECT p.a AS a, q.a AS b FROM o p, o q),
 lo AS MATERIALIZED (SELECT z, x, lake, a, b, z + a AS nz, x + b AS nx FROM l, o2), dd AS (SELECT lo.z, lo.x, min(greatest(abs(a), abs(b))) AS d FROM lo JOIN dry ON dry.z = nz AND dry.x = nx GROUP BY 1, 2),
 ring AS (SELECT nz AS z, nx AS x, lake, abs(a) + abs(b) AS d FROM lo WHERE abs(a) + abs(b) BETWEEN 1 AND 6), bk AS (SELECT z, x, arg_min(lake, d * 1000000 + lake) AS lake, min(d) AS d FROM ring ANTI JOIN l USING (z, x) GROUP BY 1, 2)
 SELECT c.z, c.x, CAST(CASE WHEN l.z IS NOT NULL THEN w.level WHEN bk.z IS NOT NULL THEN (SELECT {_BANK} FROM (SELECT v.level AS level, c.height AS height, bk.d AS d)) ELSE c.height END AS INT) AS height, CASE WHEN l.z IS NOT NULL THEN 255 ELSE land END AS land,
 CASE WHEN l.z IS NOT NULL THEN CAST(coalesce(least(greatest(dd.d, 1), 12), 12) AS INT) ELSE 0 END AS lake_depth, CASE WHEN l.z IS NULL THEN 0 WHEN sl.saline THEN 128 ELSE 255 END AS lake_mask
 FROM c LEFT JOIN l ON l.z = c.z AND l.x = c.x LEFT JOIN lv w ON w.lake = l.lake LEFT JOIN sl ON sl.lake = l.lake LEFT JOIN dd ON dd.z = c.z AND dd.x = c.x LEFT JOIN bk ON bk.z = c.z AND bk.x = c.x LEFT JOIN lv v ON v.lake = bk.lake"""


@query("lake_maps", _LAKES)
def lake_maps(spark, sf):
    lakes = _box_cells(spark, sf).select("z", "x", F.col("id").alias("lake"), (F.col("id") % 7 == 0).alias("saline"))
    return M.lake_maps(r3(spark, sf).select("z", "x", "height", "land"), lakes)




# ---- streams, replayed as batches ------------------------------------------------------------


@query("str01_admission", f"WITH {R8}, q AS (SELECT *, lag(release) OVER (PARTITION BY player, tile ORDER BY event) AS p FROM r8) SELECT player, tile, event FROM q WHERE NOT release AND coalesce(p, true)")
def str01(spark, sf):
    from terraspark.streaming.tile_sync import admit_batch

    return admit_batch(r8(spark, sf))


@query("str02_drain", f"WITH {R8}, q AS (SELECT *, lag(release) OVER (PARTITION BY player, tile ORDER BY event) AS p FROM r8), a AS (SELECT player, tile, event FROM q WHERE NOT release AND coalesce(p, true)) SELECT player, tile, event, CAST((row_number() OVER (PARTITION BY player ORDER BY event) - 1) // 2 AS BIGINT) AS tick FROM a")
def str02(spark, sf):
    from terraspark.streaming.tile_sync import admit_batch, drain

    return drain(admit_batch(r8(spark, sf)))


@query("str07_reconcile", "WITH l AS (SELECT DISTINCT user_id AS player, CAST(event_id % 7 AS INT) AS rx, CAST(event_id % 5 AS INT) AS rz FROM events), w AS (SELECT DISTINCT player, rx + a AS rx, rz + b AS rz FROM l, (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS b)), n AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY (rx - 3) ** 2 + (rz - 2) ** 2, rx, rz) AS k FROM w), d AS (SELECT player, CAST(rx AS INT) AS rx, CAST(rz AS INT) AS rz FROM n WHERE k <= 40) SELECT *, 'request' AS act FROM (SELECT * FROM d EXCEPT SELECT * FROM l) UNION ALL SELECT *, 'release' AS act FROM (SELECT * FROM l EXCEPT SELECT * FROM d)")
def str07(spark, sf):
    from terraspark.streaming.tile_sync import desired, reconcile

    held = table(spark, sf, "events").select(F.col("user_id").alias("player"), (F.col("event_id") % 7).cast("int").alias("rx"), (F.col("event_id") % 5).cast("int").alias("rz")).distinct()
    return reconcile(desired(held.withColumn("px", F.lit(3)).withColumn("pz", F.lit(2)), 40), held)


@query("str03_04_chunks", f"WITH {R1} SELECT CAST(z // 100 AS INT) AS tile, CAST(count(*) AS INT) AS n, sha256(unhex(string_agg(printf('%02X', v), '' ORDER BY z, x))) AS digest FROM r1 GROUP BY 1")
def str03(spark, sf):
    from terraspark.streaming.tile_sync import chunk, reassemble

    rows = r1(spark, sf).groupBy(F.floor(F.col("z") / 100).cast("int").alias("tile")).agg(F.to_binary(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("z", "x", "v"))), lambda p: F.lpad(F.hex(p["v"]), 2, "0")), ""), F.lit("hex")).alias("payload"))
    return reassemble(chunk(rows, 1024), 1024).select("tile", F.octet_length("payload").alias("n"), F.sha2("payload", 256).alias("digest"))


# ---- more sinks, vectors and graphs ----------------------------------------------------------


@query("snk08_write_values", f"WITH {R3} SELECT z, x, CASE WHEN river THEN river_surface ELSE height END AS height FROM r3")
def snk08(spark, sf):
    c = r3(spark, sf)
    new = c.filter("river").select("z", "x", F.col("river_surface").alias("height"))
    return M.write_values(c.select("z", "x", "height"), new, "height")


@query("snk11_report", f"WITH {R3} SELECT z, x, printf('%d, %d: height %d, %s', x, z, height, CASE WHEN lake THEN 'lake' WHEN land = 0 THEN 'ocean' ELSE 'land' END) AS report FROM r3")
def snk11(spark, sf):
    kind = F.when(F.col("lake"), "lake").when(F.col("land") == 0, "ocean").otherwise("land")
    return r3(spark, sf).select("z", "x", F.format_string("%d, %d: height %d, %s", "x", "z", "height", kind).alias("report"))


@query("src16_bounds", f"WITH {R1} SELECT z, x, v FROM r1 WHERE z >= 10 AND z < 50 AND x >= 5 AND x < 25")
def src16(spark, sf):
    return r1(spark, sf).filter("z >= 10 AND z < 50 AND x >= 5 AND x < 25").select("z", "x", "v")


@query("src19_windows", "SELECT CAST(a AS INT) AS rz, CAST(b AS INT) AS rx, CAST(a * 512 AS INT) AS z0, CAST(b * 512 AS INT) AS x0, CAST(least(a * 512 + 512, 2300) AS INT) AS z1, CAST(least(b * 512 + 512, 1700) AS INT) AS x1 FROM (SELECT unnest(range(0, 5)) AS a), (SELECT unnest(range(0, 4)) AS b)")
def src19(spark, sf):
    from terraspark.sources.tiles import windows

    return windows(spark, 1700, 2300)


@query("snk02_tile_round_trip", f"WITH {R1} SELECT z, x, v FROM r1")
def snk02(spark, sf):
    from terraspark.sources.tiles import to_cells, to_tiles

    c = r1(spark, sf)
    return to_cells(to_tiles(c, ["v"], 64), ["v"], 64).join(c.select("z", "x"), ["z", "x"], "left_semi")


@query("prj14_natural_lakes", "WITH f AS (SELECT p_partkey AS fid, CASE p_size % 3 WHEN 0 THEN 'Lake' WHEN 1 THEN 'Alkaline Lake' ELSE 'Reservoir' END AS featurecla, CASE WHEN p_partkey % 4 > 0 THEN 'n' || p_partkey % 9 END AS name, CASE WHEN p_partkey % 5 > 0 THEN 'q' || p_partkey % 11 END AS wikidataid FROM part) SELECT fid, featurecla = 'Alkaline Lake' OR coalesce(name = 'n2', false) AS saline FROM f WHERE featurecla <> 'Reservoir' AND coalesce(wikidataid NOT IN ('q3', 'q7'), true) AND coalesce(name <> 'n5', true)")
def prj14(spark, sf):
    k = F.col("p_partkey")
    f = table(spark, sf, "part").select(
        k.alias("fid"), F.when(F.col("p_size") % 3 == 0, "Lake").when(F.col("p_size") % 3 == 1, "Alkaline Lake").otherwise("Reservoir").alias("featurecla"),
        F.when(k % 4 > 0, F.concat(F.lit("n"), k % 9)).alias("name"), F.when(k % 5 > 0, F.concat(F.lit("q"), k % 11)).alias("wikidataid"),
    )
    ids = spark.createDataFrame([("q3",), ("q7",)], "wikidataid string")
    n = M.natural_lakes(f, ids, spark.createDataFrame([("n5",)], "name string"))
    return n.select("fid", ((F.col("featurecla") == "Alkaline Lake") | F.coalesce(F.col("name") == "n2", F.lit(False))).alias("saline"))


def _lines(spark, sf):
    pt = lambda x, y: F.struct((F.col("x0") + x).cast("double").alias("x"), (F.col("z0") + y).cast("double").alias("y"))
    return r7(spark, sf).select("id", F.array(pt(0.5, 0.5), pt(8.5, 4.5)).alias("pts"))


@query("ras03_buffered_line", f"WITH {R7}, c AS (SELECT id, x0, z0, CAST(z0 + a AS INT) AS z, CAST(x0 + b AS INT) AS x FROM r7, (SELECT unnest(range(-3, 10)) AS a), (SELECT unnest(range(-3, 14)) AS b)), d AS (SELECT *, greatest(least(((x - x0) * 8.0::DOUBLE + (z - z0) * 4.0::DOUBLE) / 80.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) AS t FROM c) SELECT id, z, x FROM d WHERE (x - x0 - t * 8) ** 2 + (z - z0 - t * 4) ** 2 <= 2.1 AND z BETWEEN 0 AND 499 AND x BETWEEN 0 AND 63")
def ras03(spark, sf):
    half = 2.1**0.5
    return V.buffer_lines(_lines(spark, sf).withColumn("half", F.lit(half)), "half", 500, 64)


@query("vec09_trace", f"WITH {R7}, c AS (SELECT id, k, CAST(trunc(z0 + 0.5 + 0.5 * k) AS INT) AS z, CAST(trunc(x0 + 0.5 + k) AS INT) AS x FROM r7, (SELECT unnest(range(0, 9)) AS k)) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INT) AS ord, z, x FROM c WHERE z BETWEEN 0 AND 499 AND x BETWEEN 0 AND 63")
def vec09(spark, sf):
    return V.trace(_lines(spark, sf), 500, 64)


@query("ras04_all_touched", f"WITH {R7}, t AS (SELECT unnest([0.0, 1.0]) AS t UNION ALL SELECT (unnest(range(1, 9)) - 0.5) / 8 UNION ALL SELECT (unnest(range(1, 5)) - 0.5) / 4), m AS (SELECT (t + lead(t) OVER (ORDER BY t)) / 2 AS m FROM t) SELECT DISTINCT id, CAST(floor(z0 + 0.5 + 4 * m) AS INT) AS z, CAST(floor(x0 + 0.5 + 8 * m) AS INT) AS x FROM r7, m WHERE m IS NOT NULL AND z0 + 0.5 + 4 * m < 500 AND x0 + 0.5 + 8 * m < 64")
def ras04(spark, sf):
    return V.touch_lines(_lines(spark, sf), 500, 64)


@query("gra03_fit_paths")
def gra03(spark, sf):
    c = G.cut_lineage(spark, _river_cells(spark, sf))  # read by many steps, as are the edges
    e = G.cut_lineage(spark, G.neighbour_edges(c))
    parts = G.components(spark, e, c)
    n = G.cut_lineage(spark, c.join(parts.hint("merge"), "id").withColumn("sample", F.col("level").cast("double")))
    marks = n.withColumn("lake", F.lit(False)).withColumn("coast", F.lit(False)).withColumn("edge", F.col("x").isin(16, 40))
    out = G.fit_paths(spark, n, e, G.choose_outlets(marks)).select("id", "parent", "level")
    G.forget(spark, c, e, parts, n)
    return out


@query("gra07_strong_components")
def gra07(spark, sf):
    w = r4(spark, sf)
    e = w.withColumn("dst", F.lead("cell").over(W.partitionBy("way").orderBy("ord"))).filter("dst IS NOT NULL AND dst <> cell").select(F.col("cell").alias("src"), "dst").distinct()
    nodes = w.select(F.col("cell").alias("id")).distinct()
    return nodes.join(G.scc(spark, e), "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))  # a cell without a link is one by itself
