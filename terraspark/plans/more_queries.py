"""Further queries over the driver tables, with DuckDB SQL of the same result."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraspark.functions import scalars as S
from terraspark.grid import Grid, project
from terraspark.operators import distance as D
from terraspark.operators import graph as G
from terraspark.operators import maps as M
from terraspark.operators import overlay as O
from terraspark.operators import stencil as T
from terraspark.operators import vector as V
from terraspark.plans import build as B
from terraspark.plans.catalog import query
from terraspark.plans.fixtures import R1, R2, R3, R4, R6, R7, R7_CELLS, R8, r1, r3, r4, r6, r7, r8, table
from terraspark.plans.queries import _ARCS, _EDGES, _box_cells, _hash_sql, _river_cells
from terraspark.streaming import tile_sync as Y

# ---- streams ---------------------------------------------------------------------------------

_REQ = "q AS (SELECT user_id AS player, event_id AS event, event_type = 'error' AS release, CAST(event_id % 9 AS INT) AS rx, CAST(event_id % 7 AS INT) AS rz, CAST((event_id * 7) % 140 - 3 AS INT) AS wx, CAST((event_id * 11) % 110 AS INT) AS wz, CAST(event_id % 9 AS INT) AS wy, event_id % 13 <> 0 AS loaded FROM events)"


def _requests(spark, sf):
    e = F.col("event_id")
    i = lambda c, n: c.cast("int").alias(n)
    return table(spark, sf, "events").select(F.col("user_id").alias("player"), e.alias("event"), (F.col("event_type") == "error").alias("release"), i(e % 9, "rx"), i(e % 7, "rz"), i(e * 7 % 140 - 3, "wx"), i(e * 11 % 110, "wz"), i(e % 9, "wy"), (e % 13 != 0).alias("loaded"))


@query("str01_witness", f"WITH {_REQ} SELECT player, event FROM q WHERE release OR (rx < 8 AND rz < 6 AND wx >= 0 AND wx * 32 < 4096 AND wz * 32 < 3072 AND wy < 8 AND abs(rx - floor(wx / 16.0)) <= 1 AND abs(rz - wz // 16) <= 1 AND loaded)")
def str01_witness(spark, sf):
    return Y.witnessed(_requests(spark, sf), 4096, 3072, 8).select("player", "event")


_KIND = "CASE WHEN event % 97 = 0 THEN 'close' WHEN release THEN 'release' WHEN event % 11 = 0 THEN 'failed' ELSE 'request' END"


@query("str09_sessions", f"WITH {R8}, k AS (SELECT player, tile, event, {_KIND} AS kind FROM r8), s AS (SELECT *, count(*) FILTER (WHERE kind = 'close') OVER (PARTITION BY player ORDER BY event) AS n FROM k), l AS (SELECT *, lag(kind) OVER (PARTITION BY player, tile, n ORDER BY event) AS p FROM s WHERE kind <> 'close') SELECT player, tile, event FROM l WHERE kind = 'request' AND coalesce(p, 'release') <> 'request'")
def str09(spark, sf):
    e = F.col("event")
    kind = F.when(e % 97 == 0, "close").when(F.col("release"), "release").when(e % 11 == 0, "failed").otherwise("request")
    return Y.admit_batch(r8(spark, sf).withColumn("kind", kind))


@query("str02_still_held", f"WITH {R8}, a AS (SELECT player, tile, event FROM r8 WHERE NOT release), s AS (SELECT DISTINCT player, tile FROM r8 WHERE event % 3 = 0) SELECT player, tile, event, CAST((row_number() OVER (PARTITION BY player ORDER BY event) - 1) // 2 AS BIGINT) AS tick FROM a WHERE EXISTS (SELECT 1 FROM s WHERE s.player = a.player AND s.tile = a.tile)")
def str02_still(spark, sf):
    q = r8(spark, sf)
    return Y.drain(q.filter("NOT release").select("player", "tile", "event"), still=q.filter("event % 3 = 0"))


_PACKET = "p AS (SELECT p_partkey AS part, CAST(p_size * 5 AS INT) AS cl, CAST(p_partkey % 4 AS INT) AS idx, CAST(ceil(p_size * 5 / 64.0) AS INT) + CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END AS cnt, CASE WHEN p_partkey % 31 = 0 THEN 0 ELSE 500 END AS rl FROM part), d AS (SELECT *, greatest(0, least(64, cl - idx * 64)) + CASE WHEN part % 7 = 0 THEN 1 ELSE 0 END AS n FROM p)"


@query("str05_packet_ok", f"WITH {_PACKET} SELECT part, cl > 0 AND rl > 0 AND cnt = CAST(ceil(cl / 64.0) AS INT) AND idx < cnt AND n = least(64, cl - idx * 64) AS ok FROM d")
def str05(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("part"), (F.col("p_size") * 5).cast("int").alias("compressed_length"), (k % 4).cast("int").alias("idx"), F.when(k % 31 == 0, 0).otherwise(500).alias("raw_length"))
    p = p.withColumn("cnt", F.ceil(F.col("compressed_length") / 64).cast("int") + F.when(F.col("part") % 9 == 0, 1).otherwise(0))
    n = F.greatest(F.lit(0), F.least(F.lit(64), F.col("compressed_length") - F.col("idx") * 64)) + F.when(F.col("part") % 7 == 0, 1).otherwise(0)
    return p.withColumn("data", F.repeat(F.lit("x"), n).cast("binary")).select("part", Y.packet_ok(64).alias("ok"))


@query("str08_in_flight")
def str08(spark, sf):
    q = r8(spark, sf)
    tick = F.row_number().over(W.partitionBy("player").orderBy("event")) - 1
    asks = q.filter("NOT release").select("player", "tile", tick.cast("long").alias("tick"), F.lit("ask").alias("kind"), F.col("event").alias("n"))
    done = asks.select("player", "tile", (F.col("tick") + 9 + F.col("tile") % 5).alias("tick"), F.lit("done").alias("kind"), "n")
    return Y.request_ticks(asks.unionByName(done))


@query("str10_solicited", f"WITH {R8}, a AS (SELECT DISTINCT tile FROM r8 WHERE release) SELECT event, tile FROM r8 WHERE tile IN (SELECT tile FROM a WHERE tile % 3 > 0)")
def str10(spark, sf):
    q = r8(spark, sf)
    return Y.solicited(q.select("event", "tile"), q.filter("release AND tile % 3 > 0"))


@query("str11_recent", f"WITH {R8}, l AS (SELECT player, tile, max(event) AS e FROM r8 GROUP BY 1, 2) SELECT player, tile FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY e DESC, tile) AS n FROM l) WHERE n <= 8")
def str11(spark, sf):
    return Y.recent(r8(spark, sf), "player", ["tile"], "event", 8)


_LOADED = "e AS (SELECT user_id AS player, event_id AS event, CASE WHEN event_id % 301 = 0 THEN 'leave' WHEN event_id % 5 = 0 THEN 'unload' ELSE 'chunk' END AS kind, event_id AS k FROM events), f AS (SELECT *, max(event) FILTER (WHERE kind = 'leave') OVER (PARTITION BY player) AS gone FROM e)"


def _chunk_events(spark, sf):
    e = F.col("event_id")
    kind = F.when(e % 301 == 0, "leave").when(e % 5 == 0, "unload").otherwise("chunk")
    q = table(spark, sf, "events").select(F.col("user_id").alias("player"), e.alias("event"), kind.alias("kind"))
    pick = lambda a, b: F.when(F.col("kind") == "unload", a).otherwise(b).cast("int")
    e = F.col("event")
    return q.select("*", pick(e % 8, e * 7 % 140 - 3).alias("cx"), pick(F.lit(0), e % 9).alias("cy"), pick(e % 6, e * 11 % 110).alias("cz"))


@query("str12_loaded_regions", f"""WITH {_LOADED}, u AS (SELECT player, event, CAST((k * 7 % 140 - 3) // 16 AS INT) AS rx, CAST((k * 11 % 110) // 16 AS INT) AS rz, CAST(k * 7 % 140 - 3 AS INT) AS wx, CAST(k % 9 AS INT) AS wy, CAST(k * 11 % 110 AS INT) AS wz FROM f WHERE event > coalesce(gone, -1) AND kind = 'chunk' AND k * 7 % 140 - 3 >= 0 AND (k * 7 % 140 - 3) * 32 < 4096 AND (k * 11 % 110) * 32 < 3072 AND k % 9 < 8
 UNION ALL SELECT player, event, CAST(k % 8 AS INT), CAST(k % 6 AS INT), NULL, NULL, NULL FROM f WHERE event > coalesce(gone, -1) AND kind = 'unload'), n AS (SELECT *, row_number() OVER (PARTITION BY player, rx, rz ORDER BY event DESC) AS r FROM u) SELECT player, rx, rz, wx, wy, wz FROM n WHERE r = 1 AND wx IS NOT NULL""")
def str12(spark, sf):
    return Y.loaded_regions(_chunk_events(spark, sf), 4096, 3072, 8)


@query("str13_stale_chunks", f"WITH {_REQ}, c AS (SELECT DISTINCT player, wx AS cx, wy AS cy, wz AS cz FROM q WHERE wx >= 0), a AS (SELECT DISTINCT player, rx, rz FROM q WHERE release) SELECT c.player, cx, cy, cz FROM c JOIN a ON a.player = c.player AND a.rx = cx // 16 AND a.rz = cz // 16")
def str13(spark, sf):
    q = _requests(spark, sf)
    loaded = q.filter("wx >= 0").select("player", F.col("wx").alias("cx"), F.col("wy").alias("cy"), F.col("wz").alias("cz")).distinct()
    return Y.stale_chunks(q.filter("release"), loaded)


# ---- scalar functions and map algebra ---------------------------------------------------------


@query("fun05_lerp", f"WITH {R6} SELECT part, round(annual + (warmest - annual) * wet, 6)::DOUBLE AS v FROM r6")
def fun05(spark, sf):
    return r6(spark, sf).select("part", F.round(S.lerp(F.col("annual"), F.col("warmest"), F.col("wet")), 6).alias("v"))


@query("fun09_roll", f"WITH {R1}, src AS (SELECT z, x FROM r1), {_hash_sql('x + 5 * 8191', 'z')} SELECT z, x, n / 4294967296.0::DOUBLE AS r FROM h")
def fun09(spark, sf):
    return r1(spark, sf).select("z", "x", S.roll(F.col("x"), F.col("z"), 5).alias("r"))


@query("fun14_climate_at", f"""WITH {R1}, p AS (SELECT p_partkey AS pid, CAST(p_partkey % 3800 AS INT) AS z, CAST(p_partkey % 490 AS INT) AS x FROM part), f AS (SELECT *, z / 8.0::DOUBLE AS fz, x / 8.0::DOUBLE AS fx FROM p),
 c AS (SELECT pid, CAST(floor(fz) AS INT) + a AS sz, CAST(floor(fx) AS INT) + b AS sx, (CASE a WHEN 0 THEN 1 - (fz - floor(fz)) ELSE fz - floor(fz) END) * (CASE b WHEN 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) AS w FROM f, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
 s AS (SELECT pid, sum(w * v * 0.1) / sum(w) AS t, sum(w * (v % 7)) / sum(w) AS k FROM c JOIN r1 ON r1.z = sz AND r1.x = sx GROUP BY pid) SELECT pid, round(t, 8)::DOUBLE AS annual, round(k, 8)::DOUBLE AS warmest FROM s""")
def fun14(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("pid"), (k % 3800).cast("int").alias("z"), (k % 490).cast("int").alias("x"))
    s = r1(spark, sf).select(F.col("z").alias("sz"), F.col("x").alias("sx"), (F.col("v") * 0.1).alias("annual"), (F.col("v") % 7).cast("double").alias("warmest"))
    got = M.climate_at(p, s, ["annual", "warmest"], 8, 500, 64)
    return got.select("pid", F.round("annual", 8).alias("annual"), F.round("warmest", 8).alias("warmest"))


@query("fun15_finite", "SELECT p_partkey AS part, p_partkey % 4 = 0 AS ok FROM part")
def fun15(spark, sf):
    k = F.col("p_partkey")
    v = F.when(k % 4 == 0, k.cast("double")).when(k % 4 == 1, F.lit(float("nan"))).when(k % 4 == 2, F.lit(float("-inf")))
    return table(spark, sf, "part").select(k.alias("part"), S.finite(v).alias("ok"))


_DENSE = "forest AS density FROM {prof}"


@query("fun17_density", f"WITH {R6}, bp(biome, shrub0) AS (VALUES {', '.join(f'({b}, {s})' for b, _, s, *_ in M.PROFILES)}), g AS (SELECT *, least(least(greatest(least((warmest - 5.0) / 7.0, 1.0), 0.0), 1.0), 1.0) AS t1 FROM r6) SELECT part, CASE WHEN part % 5 = 0 OR part % 7 = 0 OR part % 11 = 0 OR part % 3 = 0 OR shrub0 IS NULL THEN 0 ELSE CAST(round_even(shrub0 * greatest(least(least(w1, w2, 1.0 - w3) * (0.35 + 0.65 * w4), 1.0), 0.0), 0) AS INT) END AS shrub FROM (SELECT part, shrub0, {{ss}} FROM r6 LEFT JOIN bp USING (biome))".replace("g AS (SELECT *, least(least(greatest(least((warmest - 5.0) / 7.0, 1.0), 0.0), 1.0), 1.0) AS t1 FROM r6) ", "").replace(", SELECT", " SELECT").format(ss=", ".join(f"(t{i} * t{i} * (3.0 - 2.0 * t{i})) AS w{i}" for i in range(1, 5))).replace("FROM r6 LEFT JOIN bp USING (biome))", "FROM (SELECT part, shrub0, greatest(least((warmest - 5.0::DOUBLE) / 7.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) AS t1, greatest(least((annual + 18.0::DOUBLE) / 16.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) AS t2, greatest(least((annual - 32.0::DOUBLE) / 10.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) AS t3, greatest(least((wet - 0.015::DOUBLE) / (0.25::DOUBLE - 0.015::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE) AS t4 FROM r6 LEFT JOIN bp USING (biome)))"))
def fun17(spark, sf):
    k = F.col("part")
    c = r6(spark, sf).select("*", (k % 5 != 0).alias("inside"), (k % 7).alias("land"), F.when(k % 11 == 0, 128).otherwise(0).alias("lake_mask"), F.when(k % 3 == 0, 1).otherwise(0).alias("river"))
    return M.vegetation_density(c, "shrub").select("part", "shrub")


@query("fun22_trees", "SELECT p_partkey AS part, p_size % 4 = 0 OR p_size >= 10 AS grow FROM part")
def fun22(spark, sf):
    warm = F.when(F.col("p_size") % 4 != 0, F.col("p_size").cast("double"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("part"), M.trees_grow(warm).alias("grow"))


_VERSION_SQL = "p_size || '.' || (p_partkey % 10) || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '-rc.1' WHEN 2 THEN '-' ELSE '.x' END"


@query("fun24_version", f"SELECT p_partkey AS part, regexp_full_match({_VERSION_SQL}, '[0-9]+(\\.[0-9]+){{1,3}}(-[0-9A-Za-z]+([.-][0-9A-Za-z]+)*)?') AS ok FROM part")
def fun24(spark, sf):
    from terraspark.sources.ingest import is_version

    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, "").when(k % 4 == 1, "-rc.1").when(k % 4 == 2, "-").otherwise(".x")
    return table(spark, sf, "part").select(k.alias("part"), is_version(F.concat(F.col("p_size").cast("string"), F.lit("."), (k % 10).cast("string"), tail)).alias("ok"))


@query("prj15_saline", "SELECT p_partkey AS fid, p_size % 3 = 1 OR coalesce(CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 9 IN (2, 5) END, false) AS saline FROM part")
def prj15(spark, sf):
    k = F.col("p_partkey")
    klass = F.when(F.col("p_size") % 3 == 1, "Alkaline Lake").otherwise("Lake")
    return table(spark, sf, "part").select(k.alias("fid"), S.saline(klass, F.when(k % 4 > 0, F.concat(F.lit("n"), k % 9)), ["n2", "n5"]).alias("saline"))


@query("prj17_reaches", "SELECT l_orderkey AS reach, l_linenumber AS line FROM lineitem WHERE l_extendedprice >= 20000 * (25600 / 12800.0) AND l_quantity >= 10 AND l_quantity % 5 <> 0")
def prj17(spark, sf):
    q = F.col("l_quantity")
    flow = F.when(q % 10 == 0, F.lit(float("inf"))).when(q % 5 == 0, F.lit(float("nan"))).otherwise(q)
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("reach"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("upland_skm"), flow.alias("dis_av_cms"))
    return B.river_reaches(f, 20000, 10, (12800, 30000)).select("reach", "line")


@query("srt03_odd_keys", "SELECT l_partkey AS key, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1 HAVING count(*) > 1 OR l_partkey >= 1500")
def srt03(spark, sf):
    return M.odd_keys(table(spark, sf, "lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("key")), "key", 1500)


@query("srt05_first_suitable", "SELECT p_partkey AS part, CASE WHEN p_size < 10 AND p_partkey % 3 > 0 THEN 'gravel' WHEN p_size < 30 THEN 'sand' ELSE 'rock' END AS block FROM part")
def srt05(spark, sf):
    k = F.col("p_partkey")
    options = [(F.col("p_size") < 10, F.when(k % 3 > 0, "gravel")), (F.col("p_size") < 30, F.lit("sand"))]
    return table(spark, sf, "part").select(k.alias("part"), S.first_suitable(options, F.lit("rock")).alias("block"))


@query("cmp14_materials", "SELECT p_partkey AS part, CASE WHEN p_size % 5 < 3 THEN 'gravel-r' || (p_size % 5) ELSE 'rock-r' || (p_size % 5) END AS gravel, CASE WHEN p_size % 5 = 1 THEN 'sand-r1' ELSE 'rock-r' || (p_size % 5) END AS sand FROM part")
def cmp14(spark, sf):
    m = M.surface_materials(spark, [f"r{i}" for i in range(5)], ["gravel-r0", "gravel-r1", "gravel-r2", "sand-r1"])
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.concat(F.lit("r"), F.col("p_size") % 5).alias("rock"))
    return p.join(F.broadcast(m), "rock").select("part", "gravel", "sand")


@query("cmp17_rain_override", "SELECT p_partkey AS part, round(CASE WHEN p_partkey % 3 > 0 THEN p_size * 40 / (p_size * 40 + 800.0::DOUBLE) ELSE 0.25 END, 6)::DOUBLE AS seen, 0.25::DOUBLE AS after, CAST(p_size % 9 * 512 + 256 AS INT) AS x FROM part")
def cmp17(spark, sf):
    k = F.col("p_partkey")
    seen, after = S.rain_override(F.lit(0.25), F.col("p_size") * 40.0, k % 3 > 0)
    return table(spark, sf, "part").select(k.alias("part"), F.round(seen, 6).alias("seen"), after.alias("after"), S.region_centre(F.col("p_size") % 9).cast("int").alias("x"))


@query("cmp19_snow_balance", "WITH h AS (SELECT CAST(user_id AS INT) AS z, 0 AS x, CAST(event_id % 500 AS INT) AS hour, (event_id % 90) / 10.0::DOUBLE - 5 AS t, (event_id % 10) / 10.0::DOUBLE AS r FROM events) SELECT z, x, round(sum(CASE WHEN t > 1.5 OR (r < 0.05 AND t > 0) THEN -t / 15.0 ELSE r / 3.0 END), 6)::DOUBLE AS snow FROM h WHERE hour > 100 GROUP BY 1, 2")
def cmp19(spark, sf):
    e = F.col("event_id")
    h = table(spark, sf, "events").select(F.col("user_id").cast("int").alias("z"), F.lit(0).alias("x"), (e % 500).cast("int").alias("hour"), (e % 90 / 10.0 - 5).alias("temperature"), (e % 10 / 10.0).alias("rain"))
    return M.snow_balance(h, F.lit(100)).select("z", "x", F.round("snow", 6).alias("snow"))


@query("snk11_climate_report", """WITH c AS (SELECT p_partkey AS part, p_size / 7.0::DOUBLE AS annual, p_size / 3.0::DOUBLE AS warm, p_size * 37 + 0.317::DOUBLE AS p, p_partkey % 900 + 0.2::DOUBLE AS pet, (p_partkey % 101) / 101.0::DOUBLE AS wet FROM part)
 SELECT part, printf('annual %.1f, warmest %.1f, snowpack %s', annual, warm, CASE WHEN warm < 5 THEN 'true' ELSE 'false' END) || chr(10) || printf('P %.0f, PET %.0f, ratio %.3f, cap %.3f', p, pet, p / (p + greatest(pet, 1.0)), least(1.0::DOUBLE, p / 200)) || chr(10) || printf('wetness %.3f, of the soil %.3f, rain factor %.3f', wet, CASE WHEN warm < 5 THEN 0.0::DOUBLE ELSE wet END, p / (p + 800)) || chr(10) || printf('01: %.1f 02: %.1f', annual, warm) AS report FROM c""")
def snk11_climate(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    c = table(spark, sf, "part").select(k.alias("part"), (n / 7.0).alias("annual"), (n / 3.0).alias("warmest"), (n * 37 + 0.317).alias("p"), (k % 900 + 0.2).alias("pet"), (k % 101 / 101.0).alias("wet"))
    return c.withColumn("months", F.array("annual", "warmest")).select("part", M.climate_report(c).alias("report"))


@query("jon14_block_region", f"WITH {R1}, g AS (SELECT CAST(rz AS BIGINT) AS rz, CAST(rx AS BIGINT) AS rx, rz * 10 + rx AS name FROM (SELECT DISTINCT z // 32 AS rz FROM r1), (SELECT unnest([0, 1]) AS rx)) SELECT z, x, CAST(name AS BIGINT) AS name FROM r1 JOIN g ON g.rz = z // 32 AND g.rx = x // 32")
def jon14(spark, sf):
    c = r1(spark, sf).select("z", "x", F.floor(F.col("z") / 32).alias("rz"), F.floor(F.col("x") / 32).alias("rx"))
    regions = c.select("rz", "rx").distinct().withColumn("name", F.col("rz") * 10 + F.col("rx"))
    return c.join(regions, ["rz", "rx"]).select("z", "x", "name")


# ---- stencils, rasters, vectors ----------------------------------------------------------------


def _rings_sql() -> str:
    out = f"WITH {R3}, g0 AS (SELECT z, x, height AS h, CASE WHEN lake THEN height END AS t, lake AS done FROM r3)"
    for k in (1, 2, 3):
        pick = "greatest" if k == 1 else "least"
        near = ", ".join(f"{f}(t) OVER {w}" for w in ("r", "c") for f in ("lag", "lead"))
        out += f", n{k} AS (SELECT *, {pick}({near}) AS n FROM g{k - 1} WINDOW r AS (PARTITION BY z ORDER BY x), c AS (PARTITION BY x ORDER BY z)), g{k} AS (SELECT z, x, CASE WHEN NOT done AND n IS NOT NULL THEN least(h, n + {k}) ELSE h END AS h, CASE WHEN NOT done AND n IS NOT NULL THEN n END AS t, done OR n IS NOT NULL AS done FROM n{k})"
    return out + " SELECT z, x, h FROM g3"


@query("stn05_grade_banks", _rings_sql())
def stn05(spark, sf):
    return T.grade_banks(r3(spark, sf).select("z", "x", "height", "lake"), "height", "lake", "height", "h").select("z", "x", "h")


@query("ras02_buffered_polygon", f"WITH {R7}, c AS (SELECT id, x0, z0, CAST(z0 + a AS INT) AS z, CAST(x0 + b AS INT) AS x FROM r7, (SELECT unnest(range(-3, 9)) AS a), (SELECT unnest(range(-3, 9)) AS b)), d AS (SELECT *, greatest(x0 - (x + 0.5), x + 0.5 - (x0 + 5), 0.0) AS dx, greatest(z0 - (z + 0.5), z + 0.5 - (z0 + 5), 0.0) AS dz FROM c) SELECT id, z, x FROM d WHERE dx * dx + dz * dz <= 1.69 AND z BETWEEN 0 AND 499 AND x BETWEEN 0 AND 63")
def ras02(spark, sf):
    b = r7(spark, sf).select("id", F.array(V.box_ring(F.col("x0"), F.col("z0"), F.col("x0") + 5, F.col("z0") + 5)).alias("rings"))
    return V.buffer_polygons(b, 1.3, 500, 64)


def _slanted(spark, sf):
    pt = lambda x, y: F.struct((F.col("x0") + x).cast("double").alias("x"), (F.col("z0") + y).cast("double").alias("y"))
    return r7(spark, sf).select("id", F.array(pt(0.5, 0.5), pt(8.5, 4.5)).alias("pts"))


@query("vec01_clip_lines", f"WITH {R7}, t AS (SELECT id, x0 + 0.5 AS x1, z0 + 0.5 AS y1, greatest(0.0, (10 - (x0 + 0.5)) / 8, (20 - (z0 + 0.5)) / 4) AS a, least(1.0, (40 - (x0 + 0.5)) / 8, (300 - (z0 + 0.5)) / 4) AS b FROM r7) SELECT id, round(x1 + 8 * a, 6)::DOUBLE AS xa, round(y1 + 4 * a, 6)::DOUBLE AS ya, round(x1 + 8 * b, 6)::DOUBLE AS xb, round(y1 + 4 * b, 6)::DOUBLE AS yb FROM t WHERE a < b")
def vec01(spark, sf):
    p = V.clip_lines(_slanted(spark, sf), 10.0, 20.0, 40.0, 300.0)
    a, b = F.col("pts")[0], F.element_at("pts", -1)
    return p.select("id", *(F.round(v, 6).alias(n) for v, n in ((a["x"], "xa"), (a["y"], "ya"), (b["x"], "xb"), (b["y"], "yb"))))


@query("vec01_clip_polygons", f"WITH {R7}, c AS (SELECT id, greatest(x0, 12.5) AS a, least(x0 + 5, 40.25) AS b, greatest(z0, 33.5) AS c, least(z0 + 5, 300.75) AS d FROM r7) SELECT id, round((b - a) * (d - c), 6)::DOUBLE AS area FROM c WHERE a < b AND c < d")
def vec01p(spark, sf):
    b = r7(spark, sf).select("id", F.array(V.box_ring(F.col("x0"), F.col("z0"), F.col("x0") + 5, F.col("z0") + 5)).alias("rings"))
    ring = F.col("rings")[0]
    step = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: ring[i - 1]["x"] * ring[i]["y"] - ring[i]["x"] * ring[i - 1]["y"])
    return V.clip_polygons(b, 12.5, 33.5, 40.25, 300.75).select("id", F.round(F.abs(F.aggregate(step, F.lit(0.0), lambda a, v: a + v)) / 2, 6).alias("area"))


@query("vec03_line_parts", "SELECT s_suppkey AS id, CAST(k AS INT) AS part, (s_suppkey % 50 + k)::DOUBLE AS x FROM supplier, (SELECT unnest(range(0, 4)) AS k) WHERE (s_suppkey + k) % 3 > 0")
def vec03(spark, sf):
    k = F.col("s_suppkey")
    part = lambda i: F.struct(F.when((k + i) % 3 > 0, "line").otherwise("point").alias("kind"), F.array(F.struct((k % 50 + i).cast("double").alias("x"), F.lit(0.0).alias("y"))).alias("pts"))
    f = table(spark, sf, "supplier").select(k.alias("id"), F.array(*(part(i) for i in range(4))).alias("geometry"))
    return V.line_parts(f).select("id", "part", F.col("pts")[0]["x"].alias("x"))


@query("vec04_simplify", f"WITH {R7} SELECT id, CASE WHEN (id % 5) * 0.5 > 1.0 THEN 3 ELSE 2 END AS n FROM r7")
def vec04(spark, sf):
    pt = lambda x, y: F.struct((F.col("x0") + x).cast("double").alias("x"), (F.col("z0") + y).cast("double").alias("y"))
    line = r7(spark, sf).select("id", F.array(pt(0, F.lit(0.0)), pt(4, F.col("id") % 5 * 0.5), pt(8, F.lit(0.0))).alias("pts"))
    return V.simplify(line, 1.0).select("id", F.size("pts").alias("n"))


@query("vec06_outlets", f"WITH {R7} SELECT id FROM r7 WHERE id % 3 = 0 AND x0 + 8.5 BETWEEN 10 AND 50 AND z0 + 4.5 BETWEEN 20 AND 300 AND id % 4 < 2")
def vec06(spark, sf):
    l = _slanted(spark, sf)  # noqa: E741
    full = l.withColumn("full", F.col("pts")).withColumn("next_down", F.col("id") % 3)
    # every other pair of lines was shortened by more than a pixel
    full = full.withColumn("pts", F.when(F.col("id") % 4 < 2, F.col("pts")).otherwise(F.slice("pts", 1, 1)))
    return V.outlets(full, "next_down", 10.0, 20.0, 50.0, 300.0).select("id")


@query("vec08_connectors", f"""WITH {R3}, c AS MATERIALIZED (SELECT z, x, height - 70 AS height, land, lake FROM r3), o AS (SELECT z * 64 + x AS id, z, x FROM c WHERE (z * 64 + x) % 5 = 0 AND land > 0 AND NOT lake AND height <= 60),
 d AS (SELECT unnest(range(-6, 7)) AS a), r AS (SELECT p.a AS dz, q.a AS dx FROM d p, d q WHERE p.a * p.a + q.a * q.a <= 36), n AS (SELECT id, o.z, o.x, o.z + dz AS nz, o.x + dx AS nx, dz * dz + dx * dx AS d2 FROM o, r), m AS (SELECT n.*, row_number() OVER (PARTITION BY id ORDER BY d2, nz, nx) AS k FROM n JOIN c ON c.z = nz AND c.x = nx WHERE c.land = 0), b AS (SELECT * FROM m WHERE k = 1 AND d2 >= 4),
 t AS (SELECT *, greatest(abs(nz - z), abs(nx - x)) AS s FROM b), w AS (SELECT id, CAST(round_even(z + (nz - z) * i / s::DOUBLE, 0) AS INT) AS pz, CAST(round_even(x + (nx - x) * i / s::DOUBLE, 0) AS INT) AS px FROM (SELECT *, unnest(range(1, s)) AS i FROM t)), bad AS (SELECT DISTINCT id FROM w JOIN c ON c.z = pz AND c.x = px WHERE height > 60 OR lake OR land = 0)
 SELECT id, (nx + 0.5)::DOUBLE AS ex, (nz + 0.5)::DOUBLE AS ez FROM b ANTI JOIN bad USING (id)""")
def vec08(spark, sf):
    c = r3(spark, sf).select("z", "x", (F.col("height") - 70).alias("height"), "land", "lake")
    o = c.select((F.col("z") * 64 + F.col("x")).alias("id"), "z", "x").filter("id % 5 = 0")
    end = F.element_at("pts", -1)
    return B.coastal_connectors(c, o, 6).select("id", end["x"].alias("ex"), end["y"].alias("ez"))


@query("agg09_dissolve", f"WITH RECURSIVE {R7}, e AS MATERIALIZED (SELECT a.id AS src, b.id AS dst FROM r7 a JOIN r7 b ON (abs(a.x0 - b.x0) < 5 AND abs(a.z0 - b.z0) <= 5) OR (abs(a.x0 - b.x0) <= 5 AND abs(a.z0 - b.z0) < 5)), r AS (SELECT id, id AS m FROM r7 UNION SELECT dst, m FROM r JOIN e ON r.id = e.src WHERE m < dst) SELECT id, min(m) AS whole FROM r GROUP BY id")
def agg09(spark, sf):
    return M.dissolve(spark, _box_cells(spark, sf), 500, 64)


#: Boxes of 5 columns and 5 to 8 rows: some lie apart, some share a border, some overlap.
_B7 = f"{R7}, b7 AS MATERIALIZED (SELECT id, x0, z0, CAST(x0 + 5 AS INT) AS x1, CAST(z0 + 5 + id % 4 AS INT) AS z1 FROM r7)"


def _boxes(spark, sf):
    return r7(spark, sf).select("id", F.array(V.box_ring(F.col("x0"), F.col("z0"), F.col("x0") + 5, F.col("z0") + 5 + F.col("id") % 4)).alias("rings"))


@query(
    "agg09_union",
    f"""WITH RECURSIVE {_B7}, e AS MATERIALIZED (SELECT a.id AS src, b.id AS dst FROM b7 a JOIN b7 b ON (a.x0 < b.x1 AND b.x0 < a.x1 AND a.z0 <= b.z1 AND b.z0 <= a.z1) OR (a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.z0 < b.z1 AND b.z0 < a.z1)),
 r AS (SELECT id, id AS m FROM b7 UNION SELECT dst, m FROM r JOIN e ON r.id = e.src WHERE m < dst), l AS MATERIALIZED (SELECT id, min(m) AS whole FROM r GROUP BY id),
 w AS (SELECT id, x0, x1, unnest(range(z0, z1)) AS z FROM b7), c AS MATERIALIZED (SELECT DISTINCT whole, z, x FROM (SELECT id, z, unnest(range(x0, x1)) AS x FROM w) JOIN l USING (id)),
 k AS MATERIALIZED (SELECT unnest([0, 0, 1, -1]) AS a, unnest([1, -1, 0, 0]) AS b), n AS MATERIALIZED (SELECT whole, z + a AS z, x + b AS x FROM c, k), o AS (SELECT n.whole, count(*) AS p FROM n ANTI JOIN c ON c.whole = n.whole AND c.z = n.z AND c.x = n.x GROUP BY 1), s AS (SELECT whole, count(*) AS area FROM c GROUP BY 1)
 SELECT s.whole, CAST(area AS DOUBLE) AS area, CAST(p AS DOUBLE) AS perimeter FROM s JOIN o USING (whole)""",
)
def agg09_union(spark, sf):
    found = O.union_polygons(spark, _boxes(spark, sf))
    return found.select("whole", "area", O.perimeter(F.col("rings")).alias("perimeter"))


_STROKES = "l AS MATERIALIZED (SELECT id, x0 + 0.5::DOUBLE AS x, z0 + 0.5::DOUBLE AS z, 2.0::DOUBLE ** (id % 3) AS dx, 2.0::DOUBLE ** (id // 3 % 3) AS dz FROM r7)"


def _strokes(spark, sf):
    """Lines from the middle of a box's first cell, one to four cells each way."""
    x, z = F.col("x0") + 0.5, F.col("z0") + 0.5
    end = F.struct((x + F.pow(F.lit(2.0), F.col("id") % 3)).alias("x"), (z + F.pow(F.lit(2.0), F.floor(F.col("id") / 3) % 3)).alias("y"))
    return r7(spark, sf).select("id", F.array(F.struct(x.alias("x"), z.alias("y")), end).alias("pts"))


@query("jon08_intersects", f"WITH {_B7}, {_STROKES} SELECT b7.id AS polygon, l.id AS line FROM b7, l WHERE greatest(0, (x0 - l.x) / dx, (z0 - l.z) / dz) <= least(1, (x1 - l.x) / dx, (z1 - l.z) / dz)")
def jon08_intersects(spark, sf):
    return O.intersecting(_boxes(spark, sf), _strokes(spark, sf), "rings", "pts").select(F.col("a_id").alias("polygon"), F.col("b_id").alias("line"))


@query("jon08_covers", f"WITH {_B7}, {_STROKES} SELECT b7.id AS polygon, l.id AS line FROM b7, l WHERE l.x BETWEEN x0 AND x1 AND l.x + dx BETWEEN x0 AND x1 AND l.z BETWEEN z0 AND z1 AND l.z + dz BETWEEN z0 AND z1")
def jon08_covers(spark, sf):
    return O.covering(_boxes(spark, sf), _strokes(spark, sf))


# ---- graph -------------------------------------------------------------------------------------


@query("gra02_outlets", f"{_EDGES}, cp AS (SELECT id, id AS m FROM c UNION SELECT dst, m FROM cp JOIN e ON cp.id = e.src WHERE m < dst), cc AS (SELECT id, min(m) AS component FROM cp GROUP BY id), n AS (SELECT cc.*, height AS s, CASE WHEN height = 139 THEN 0 WHEN height % 7 = 0 THEN 1 WHEN x IN (16, 40) THEN 2 ELSE 3 END AS k FROM cc JOIN r3 ON r3.z * 64 + r3.x = cc.id), b AS (SELECT *, min(k) OVER (PARTITION BY component) AS bk FROM n), f AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY s, id) AS o FROM b WHERE k = bk) SELECT id, component FROM f WHERE bk = 0 OR o = 1")
def gra02(spark, sf):
    c = _river_cells(spark, sf)
    n = c.join(G.components(spark, G.neighbour_edges(c), c), "id")
    return G.choose_outlets(n.withColumn("sample", F.col("level").cast("double")).withColumn("lake", F.col("level") == 139).withColumn("coast", F.col("level") % 7 == 0).withColumn("edge", F.col("x").isin(16, 40)))


@query("gra08_propagate", f"{_ARCS}, r AS (SELECT id, level FROM lv UNION SELECT dst, r.level FROM r JOIN e ON r.id = e.src JOIN lv ON lv.id = dst WHERE r.level < lv.level AND (src + dst) % 3 > 0) SELECT id, min(level) AS level FROM r GROUP BY id")
def gra08(spark, sf):
    w = r4(spark, sf)
    cells = w.groupBy(F.col("cell").alias("id")).agg(F.max("level").alias("level"))
    nxt = w.select(F.col("cell").alias("src"), F.lead("cell").over(W.partitionBy("way").orderBy("ord")).alias("dst")).filter("dst IS NOT NULL AND (src + dst) % 3 > 0")
    return G.propagate_down(spark, cells, nxt)


@query("gra11_settle")
def gra11(spark, sf):
    """River cells, sections of 4 x 4 cells with their least cell as centre, ways down each column."""
    c = _river_cells(spark, sf)
    block = (F.floor(F.col("z") / 4), F.floor(F.col("x") / 4))
    center = c.groupBy(block[0].alias("_z"), block[1].alias("_x")).agg(F.min("id").alias("center"))
    sections = c.select("id", block[0].alias("_z"), block[1].alias("_x")).join(center, ["_z", "_x"]).select("id", "center")
    ways = c.select(F.col("x").alias("way"), F.col("z").alias("ord"), F.col("id").alias("cell"))
    return G.settle(spark, c, sections, ways, width=64).select("id", "level")


# ---- warps ---------------------------------------------------------------------------------------


_N = "(SELECT max(z) + 1 FROM r1)"


def _holed(spark, sf):
    """The raster with holes, and its number of rows."""
    c = r1(spark, sf)
    return c.select("z", "x", F.when(F.col("v") % 9 > 0, F.col("v")).alias("v")), c.agg(F.max("z")).first()[0] + 1


def _grids(dst: float, n: int, cols: int) -> tuple[Grid, Grid]:
    return Grid(1.0, 0.0, 0.0, 0.0, -1.0, float(n), 64, n, "EPSG:3857"), Grid(dst, 0.0, 0.0, 0.0, -dst, float(n), cols, math.ceil(n / dst), "EPSG:3857")


_SOURCE = f"{R1}, s AS MATERIALIZED (SELECT z, x, v FROM r1 WHERE v % 9 > 0)"


def _warp_sql(dst: float, cols: int, kernel: str, radius: int) -> str:
    sc = max(1.0, dst)
    axis = lambda n, a, f: f"{a} AS (SELECT CAST(i AS INT) AS {a}i, (i + 0.5) * {dst}::DOUBLE - 0.5 AS f FROM (SELECT unnest(range(0, {n})) AS i)), {a}w AS (SELECT {a}i, k, {kernel.format(d=f'((k - f) / {sc}::DOUBLE)')} AS w FROM (SELECT {a}i, f, unnest(range(CAST(ceil(f - {radius * sc}) AS INT), CAST(floor(f + {radius * sc}) AS INT) + 1)) AS k FROM {a}))"
    return f"WITH {_SOURCE}, {axis(f'CAST(ceil({_N} / {dst}::DOUBLE) AS INT)', 'zz', 'f')}, {axis(cols, 'xx', 'f')} SELECT zzi AS z, xxi AS x, round(sum(zzw.w * xxw.w * v) / sum(zzw.w * xxw.w), 6)::DOUBLE AS v FROM s JOIN zzw ON zzw.k = s.z JOIN xxw ON xxw.k = s.x WHERE zzw.w > 0 AND xxw.w > 0 GROUP BY 1, 2"


_TRIANGLE = "greatest(0.0::DOUBLE, 1 - abs({d}))"
_SPLINE = "(CASE WHEN abs({d}) < 1 THEN (4 - 6 * abs({d}) ** 2 + 3 * abs({d}) ** 3) / 6 WHEN abs({d}) < 2 THEN (2 - abs({d})) ** 3 / 6 ELSE 0.0 END)"


@query("rsm01_warp_cubic", _warp_sql(1.6, 40, _SPLINE, 2))
def rsm01(spark, sf):
    c, n = _holed(spark, sf)
    return B.warp(c, *_grids(1.6, n, 40), method="cubic").filter("v IS NOT NULL").select("z", "x", F.round("v", 6).alias("v"))


@query("rsm02_warp_bilinear", _warp_sql(0.8, 80, _TRIANGLE, 1))
def rsm02(spark, sf):
    c, n = _holed(spark, sf)
    return B.warp(c, *_grids(0.8, n, 80)).filter("v IS NOT NULL").select("z", "x", F.round("v", 6).alias("v"))


@query("rsm05_windowed_shrink", _warp_sql(4.0, 16, _TRIANGLE, 1).replace("GROUP BY 1, 2", "AND zzi BETWEEN 10 AND 39 AND xxi BETWEEN 3 AND 11 GROUP BY 1, 2"))
def rsm05(spark, sf):
    c, n = _holed(spark, sf)
    return B.warp(c, *_grids(4.0, n, 16), window=(10, 3, 40, 12)).filter("v IS NOT NULL").select("z", "x", F.round("v", 6).alias("v"))


@query("rsm06_align_nearest", f"WITH {_SOURCE}, t AS (SELECT CAST(i AS INT) AS z, CAST(j AS INT) AS x, CAST(floor((i + 0.5) * 2.5::DOUBLE) AS INT) AS sz, CAST(floor((j + 0.5) * 2.5::DOUBLE) AS INT) AS sx FROM (SELECT unnest(range(0, CAST(ceil({_N} / 2.5::DOUBLE) AS INT))) AS i), (SELECT unnest(range(0, 25)) AS j)) SELECT t.z, t.x, v FROM t JOIN s ON s.z = sz AND s.x = sx")
def rsm06(spark, sf):
    c, n = _holed(spark, sf)
    return B.warp(c, *_grids(2.5, n, 25), method="nearest").filter("v IS NOT NULL").select("z", "x", "v")


# the raster as degrees: 64 columns of 3/32 of a degree from 12 E on, its rows from 60 N to 40 S


def _degrees(n: int) -> Grid:
    return Grid(0.09375, 0.0, 12.0, 0.0, -100.0 / n, 60.0, 64, n, "EPSG:4326")


def _mercator_target(n: int) -> Grid:
    """Web Mercator over the same box, 48 columns and three quarters of the rows."""
    (x0, y0), (x1, y1) = project(12.0, 60.0, "EPSG:3857", np), project(18.0, -40.0, "EPSG:3857", np)
    rows = n * 3 // 4
    return Grid(float(x1 - x0) / 48, 0.0, float(x0), 0.0, float(y1 - y0) / rows, float(y0), 48, rows, "EPSG:3857")


def _mercator_sql() -> str:
    y = lambda lat: f"ln(tan(pi() / 4 + radians({lat}::DOUBLE) / 2))"
    n, rows = "(SELECT n FROM e)", "(SELECT n * 3 // 4 FROM e)"
    lat = f"degrees(2 * atan(exp({y(60)} + (i + 0.5) * ({y(-40)} - {y(60)}) / {rows})) - pi() / 2)"
    line = lambda a, count, f, sc: f"{a} AS (SELECT i, {f} AS f, {sc} AS sc FROM (SELECT unnest(range(0, {count})) AS i)), {a}w AS (SELECT i, k, {_SPLINE.format(d='((k - f) / sc)')} AS w FROM (SELECT i, f, sc, unnest(range(CAST(ceil(f - 2 * sc) AS INT), CAST(floor(f + 2 * sc) AS INT) + 1)) AS k FROM {a}))"
    return (
        f"WITH {_SOURCE}, e AS MATERIALIZED (SELECT CAST(max(z) + 1 AS BIGINT) AS n FROM r1), {line('zz', rows, f'(60 - {lat}) * {n} / 100.0::DOUBLE - 0.5', f'greatest(1.0::DOUBLE, {n}::DOUBLE / {rows})')}, {line('xx', 48, '(i + 0.5) * 64 / 48.0::DOUBLE - 0.5', '(64 / 48.0::DOUBLE)')} "
        "SELECT CAST(zzw.i AS INT) AS z, CAST(xxw.i AS INT) AS x, round(sum(zzw.w * xxw.w * v) / sum(zzw.w * xxw.w), 3)::DOUBLE AS v FROM s JOIN zzw ON zzw.k = s.z JOIN xxw ON xxw.k = s.x WHERE zzw.w > 0 AND xxw.w > 0 GROUP BY 1, 2"
    )


@query("rsm01_degrees_to_mercator", _mercator_sql())
def rsm01_degrees_to_mercator(spark, sf):
    c, n = _holed(spark, sf)
    return B.warp(c, _degrees(n), _mercator_target(n), method="cubic").filter("v IS NOT NULL").select("z", "x", F.round("v", 3).alias("v"))


def _utm_target(n: int) -> Grid:
    """Zone 33 N, 167 to 833 km east and 6,600 km north to 4,400 km south of the equator, finer than the source."""
    rows = n * 5 // 4
    return Grid(666000.0 / 144, 0.0, 167000.0, 0.0, -11000000.0 / rows, 6600000.0, 144, rows, "EPSG:32633")


def _utm_sql() -> str:
    """The inverse series of the transverse Mercator projection to the third power of the third flattening."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    big = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    d = lambda v: f"{v!r}::DOUBLE"
    u = "xi" + "".join(f" - {d(b)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(beta, 1))
    v = "eta" + "".join(f" - {d(b)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(beta, 1))
    phi = "chi" + "".join(f" + {d(b)} * sin({2 * j} * chi)" for j, b in enumerate(delta, 1))
    return f"""WITH {_SOURCE}, e AS MATERIALIZED (SELECT CAST(max(z) + 1 AS BIGINT) AS n, CAST((max(z) + 1) * 5 // 4 AS BIGINT) AS rows FROM r1),
 t AS (SELECT i, j, n, (6600000 - (i + 0.5) * 11000000.0::DOUBLE / rows) / {d(big)} AS xi, (167000 + (j + 0.5) * 666000.0::DOUBLE / 144 - 500000) / {d(big)} AS eta FROM (SELECT n, rows, unnest(range(0, rows)) AS i FROM e), (SELECT unnest(range(0, 144)) AS j)),
 w AS (SELECT i, j, n, {u} AS u, {v} AS v FROM t), g AS (SELECT i, j, n, asin(sin(u) / cosh(v)) AS chi, 15 + degrees(atan2(sinh(v), cos(u))) AS lon FROM w),
 p AS MATERIALIZED (SELECT i, j, (60 - degrees({phi})) * n / 100.0::DOUBLE - 0.5 AS fz, (lon - 12) / 0.09375::DOUBLE - 0.5 AS fx FROM g),
 c AS (SELECT i, j, CAST(floor(fz) AS INT) + a AS z, CAST(floor(fx) AS INT) + b AS x, (CASE WHEN a = 0 THEN 1 - (fz - floor(fz)) ELSE fz - floor(fz) END) * (CASE WHEN b = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) AS k FROM p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(a, b))
 SELECT CAST(i AS INT) AS z, CAST(j AS INT) AS x, round(sum(k * s.v) / sum(k), 3)::DOUBLE AS v FROM c JOIN s ON s.z = c.z AND s.x = c.x WHERE k > 0 GROUP BY 1, 2"""


@query("rsm02_degrees_to_utm", _utm_sql())
def rsm02_degrees_to_utm(spark, sf):
    c, n = _holed(spark, sf)
    return B.warp(c, _degrees(n), _utm_target(n)).filter("v IS NOT NULL").select("z", "x", F.round("v", 3).alias("v"))


def _fill_sql(reach: int) -> str:
    side = lambda n, on, d: f"{n} AS (SELECT h.z, h.x, arg_min(s.v, {d}) AS v, min({d}) AS d FROM h JOIN s ON {on} AND {d} BETWEEN 1 AND {reach} GROUP BY 1, 2)"
    parts = [side("l", "s.z = h.z", "h.x - s.x"), side("r", "s.z = h.z", "s.x - h.x"), side("u", "s.x = h.x", "h.z - s.z"), side("d", "s.x = h.x", "s.z - h.z")]
    return f"""WITH {R1}, s AS MATERIALIZED (SELECT z, x, v FROM r1 WHERE v % 9 > 6), h AS MATERIALIZED (SELECT z, x FROM r1 WHERE v % 9 <= 6), {', '.join(parts)},
 a AS (SELECT * FROM l UNION ALL SELECT * FROM r UNION ALL SELECT * FROM u UNION ALL SELECT * FROM d)
 SELECT z, x, round(sum(v / d::DOUBLE) / sum(1 / d::DOUBLE), 6)::DOUBLE AS v FROM a GROUP BY 1, 2 UNION ALL SELECT z, x, CAST(v AS DOUBLE) FROM s"""


@query("rsm07_fill_interpolated", _fill_sql(6))
def rsm07(spark, sf):
    c = r1(spark, sf).select("z", "x", F.when(F.col("v") % 9 > 6, F.col("v")).alias("v"))
    return D.fill_interpolated(c, "v", "out", 6).filter("out IS NOT NULL").select("z", "x", F.round("out", 6).alias("v"))


@query("rsm08_decode", "SELECT user_id AS sample, round(avg(CAST(event_id % 4000 AS DOUBLE) * 0.1 + 0.5 - 273.15), 6) AS t FROM events GROUP BY 1")
def rsm08(spark, sf):
    raw = table(spark, sf, "events").select(F.col("user_id").alias("sample"), (F.col("event_id") % 4000).alias("raw"))
    return raw.groupBy("sample").agg(F.round(F.avg(B.decoded(F.col("raw"), F.lit(0.1), F.lit(0.5)) - B.KELVIN), 6).alias("t"))
