"""Whole products: warped rasters, climate records, coastal connectors and the fitted river surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraspark.functions.scalars import finite
from terraspark.operators import aggregates as A
from terraspark.operators import distance as D
from terraspark.operators import graph as G
from terraspark.operators import stencil as T
from terraspark.operators import vector as V
from terraspark.operators.warp import warp  # noqa: F401  (part of the products)
from terraspark.sources.binary_maps import SPACING, samples
from terraspark.sources.tiles import filled


KELVIN = 273.15


def decoded(raw, scale, offset):
    """A stored number as what it stands for."""
    return raw * scale + offset


def climate_records(monthly: DataFrame, ground: DataFrame, width: int, height: int, window: int = 21) -> tuple[DataFrame, float]:
    """Records of the climate grid and its lapse.

    monthly(variable tas|pr|pet, month, sz, sx, raw, scale, offset), already on the sample
    grid; gaps take the nearest sample. ground(z, x, y): terrain height, sea level on ocean.
    """
    sw, sh = samples(width), samples(height)
    grid = filled(ground.sparkSession, sw, sh).select("z", "x")
    v = monthly.select("variable", "month", F.col("sz").alias("z"), F.col("sx").alias("x"), decoded(F.col("raw"), F.col("scale"), F.col("offset")).alias("v"))
    have = v.select("z", "x").distinct().withColumn("_k", F.lit(True))
    near = D.nearest_source(grid.join(have, ["z", "x"], "left").withColumn("_k", F.coalesce("_k", F.lit(False))), "_k").select("z", "x", "nz", "nx")
    full = near.join(v.withColumnsRenamed({"z": "nz", "x": "nx"}), ["nz", "nx"]).drop("nz", "nx")
    t = full.filter("variable = 'tas'").withColumn("v", F.col("v") - KELVIN)
    tenths = F.rint(F.least(F.greatest(F.col("v") * 10, F.lit(-32768.0)), F.lit(32767.0))).cast("int")
    months = t.groupBy("z", "x").agg(F.transform(F.sort_array(F.collect_list(F.struct("month", tenths.alias("t")))), lambda p: p["t"]).alias("temperature")).join(A.annual_mean(t, ["z", "x"], "v", "annual"), ["z", "x"])
    sums = [A.annual_sum(full.filter(F.col("variable") == k), ["z", "x"], "v", n) for k, n in (("pr", "precipitation"), ("pet", "pet"))]
    y = A.footprint_mean(ground, "y", "_y", SPACING, sh, sw).select(F.col("sz").alias("z"), F.col("sx").alias("x"), "_y")
    out = months.join(sums[0], ["z", "x"]).join(sums[1], ["z", "x"]).join(y, ["z", "x"])
    lapse = A.lapse_rate(out.select("z", "x", F.col("_y").alias("h"), F.col("annual").alias("t")), "h", "t", window).first()["lapse"]
    return out.select(F.col("z").alias("sz"), F.col("x").alias("sx"), "temperature", "precipitation", "pet", F.rint(F.col("_y") * 10).cast("int").alias("terrain_y")), lapse


def river_reaches(features: DataFrame, least_area: float, least_flow: float, shape: tuple[int, int] = (25600, 25600)) -> DataFrame:
    """Reaches worth drawing: upstream area above a threshold that grows on coarse grids, finite discharge above another; nulls go."""
    area = least_area * max(1.0, 25600 / min(shape))
    return features.filter((F.col("upland_skm") >= area) & (F.col("dis_av_cms") >= least_flow) & finite(F.col("dis_av_cms")))


def coastal_connectors(cells: DataFrame, outlets: DataFrame, limit: int, sea: int = 60) -> DataFrame:
    """(id, pts): straight lines from outlets on land to the nearest ocean cell, two cells to ``limit`` away.

    cells(z, x, height, land, lake boolean); outlets(id, z, x). An outlet counts on dry land at
    or below sea level; a path that meets a ridge above sea level, a lake, or ocean before
    its end is rejected.
    """
    o = outlets.join(cells, ["z", "x"]).filter((F.col("land") > 0) & ~F.col("lake") & (F.col("height") <= sea)).select("id", "z", "x")
    ring = D.ring(limit)
    near = D.around(o, ring).select("id", "z", "x", "nz", "nx", (F.col("dz") * F.col("dz") + F.col("dx") * F.col("dx")).alias("d2"))
    ocean = cells.filter("land = 0").select(F.col("z").alias("nz"), F.col("x").alias("nx"))
    best = near.join(ocean, ["nz", "nx"]).groupBy("id").agg(F.min(F.struct("d2", "nz", "nx", "z", "x")).alias("m")).filter(F.col("m.d2") >= 4).select("id", "m.*")
    n = F.greatest(F.abs(F.col("nz") - F.col("z")), F.abs(F.col("nx") - F.col("x")))
    path = best.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n") - 1)))
    at = lambda a, b: F.rint(F.col(a) + (F.col(b) - F.col(a)) * F.col("_k") / F.col("_n")).cast("int")
    on = path.select("id", at("z", "nz").alias("_z"), at("x", "nx").alias("_x")).join(cells.withColumnsRenamed({"z": "_z", "x": "_x"}), ["_z", "_x"])
    bad = on.groupBy("id").agg(F.bool_or((F.col("height") > sea) | F.col("lake") | (F.col("land") == 0)).alias("_bad")).filter("_bad")
    pt = lambda z, x: F.struct((F.col(x) + 0.5).alias("x"), (F.col(z) + 0.5).alias("y"))
    return best.join(bad, "id", "left_anti").select("id", F.array(pt("z", "x"), pt("nz", "nx")).alias("pts"))


@G.tidied
def fitted_surface(spark: SparkSession, cells: DataFrame, lines: DataFrame, cols: int, rows: int, reach: int = 6) -> DataFrame:
    """(z, x, level): the surface of all river cells.

    cells(z, x, sample, ceiling, lake_level, coast boolean, edge boolean) of river cells only,
    lines(id, pts) from source to outlet in cell units. Centre cells become an 8-neighbour
    graph; its components get outlets, shortest paths and isotonic profiles; levels are
    lowered along the lines' directions and limited to steps of one; each river cell takes
    its nearest centre's level, then ceilings, sections and downstream order are settled.
    """
    pixel = (F.col("z").cast("long") * cols + F.col("x")).alias("id")
    river = G.cut_lineage(spark, cells.select(pixel, "z", "x", "sample", "ceiling", "lake_level", "coast", "edge"))
    way = G.cut_lineage(spark, V.trace(lines, rows, cols).select(F.col("id").alias("way"), "ord", (F.col("z").cast("long") * cols + F.col("x")).alias("cell")).join(river.select(F.col("id").alias("cell")), "cell", "left_semi"))
    centers = river.join(way.select(F.col("cell").alias("id")).distinct(), "id", "left_semi")
    edges = G.cut_lineage(spark, G.neighbour_edges(centers))
    comp = G.components(spark, edges, centers)
    nodes = G.cut_lineage(spark, centers.join(comp, "id").withColumn("lake", F.col("lake_level") > 0).withColumn("sample", F.when(F.col("lake"), F.col("lake_level")).otherwise(F.col("sample")).cast("double")))
    fit = G.cut_lineage(spark, G.fit_paths(spark, nodes, edges, G.choose_outlets(nodes)).select("id", "level"))
    nxt = way.withColumn("dst", F.lead("cell").over(W.partitionBy("way").orderBy("ord"))).filter("dst IS NOT NULL").select(F.col("cell").alias("src"), "dst").distinct()
    strong = G.cut_lineage(spark, G.scc(spark, nxt))
    low = strong.join(fit, "id").groupBy("scc").agg(F.min("level").alias("m"))
    fit = fit.join(strong.join(low, "scc").select("id", "m"), "id", "left").select("id", F.least("level", F.coalesce("m", "level")).alias("level"))
    fit = G.propagate_down(spark, fit, nxt, width=cols)
    fit = G.step_limit(spark, fit, nxt, width=cols)
    fit = G.cut_lineage(spark, fit)
    fit = G.relax(spark, fit, edges.select("src", "dst", F.lit(1).alias("cost")), width=cols)
    fit = G.cut_lineage(spark, fit)
    near = G.nearest_center(river, centers, reach)
    spread = near.join(fit.select(F.col("id").alias("center"), F.col("level").alias("_l")), "center").select("id", "center", "_l")
    level = river.join(spread, "id", "left").join(fit, "id", "left")
    level = level.select("id", "z", "x", F.coalesce("center", "id").alias("center"), F.coalesce("level", "_l", F.col("sample").cast("int")).alias("_v"), "ceiling", "lake_level")
    touch = F.when(F.col("lake_level") > 0, F.col("lake_level")).otherwise(F.col("_v"))
    level = G.cut_lineage(spark, level.withColumn("level", F.least(touch, "ceiling").cast("int")).drop("_v"))
    sections = level.select("id", "center")
    settled = G.settle(spark, level.select("id", "z", "x", "level"), sections, way, width=cols)
    return settled.join(river.select("id", "z", "x"), "id").select("z", "x", "level")


def river_depth(cells: DataFrame, cap: int = 3) -> DataFrame:
    """(z, x, depth) of river cells: distance to the shore, one to ``cap``; a map without shore has depth one."""
    df = T.capped_distance(cells.withColumn("_dry", ~F.col("river")), "_dry", cap, "_dist")
    any_dry = cells.agg(F.bool_or(~F.col("river"))).first()[0]
    depth = T.depth_from_distance(F.col("_dist"), 1, cap) if any_dry else F.lit(1)
    return df.filter("river").select("z", "x", depth.alias("depth"))
