"""Overlays of vector shapes: where segments meet, what lies inside, intersects, covers, union.

polygons(id, rings array<array<struct<x, y>>>) hold what an odd number of their rings
holds; lines(id, pts). All pairs are found in buckets of a grid: a segment lies in the
buckets it runs through, a meeting place belongs to the one bucket it lies in, so no pair
comes twice. Whether a place is inside is decided by the crossings of a ray with the
polygon's own edges in its band of the grid. Copies of a shape are looked at once: the
shape of least id stands for them, and pairs are handed out to the copies at the end.

Coordinates are compared as they are: shapes that touch share exact points, as on a grid
or along a border that both were cut from. Sides of a segment are looked at a millionth
of its length away from it. Rows with null or empty shapes have no edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspark.operators import graph as G
from terraspark.operators.vector import POINTS, segments

#: Buckets of the grid for edges that one bucket of the grid for whole polygons spans.
COARSE = 16
ASIDE = 1e-6


def edges(shapes: DataFrame, column: str = "rings") -> DataFrame:
    """(id, part, ord, x1, y1, x2, y2): the segments of polygons (``rings``) or lines (``pts``), without those of no length."""
    if column == "pts":
        s = segments(shapes.withColumn("part", F.lit(0)), "pts", ("id", "part"))
    else:
        s = segments(shapes.select("id", F.posexplode(column).alias("part", "pts")), "pts", ("id", "part"))
    return s.filter("x1 <> x2 OR y1 <> y2")


def _shapes(shapes: DataFrame, column: str) -> DataFrame:
    """(id, column): distinct shapes, each with the least id that has it."""
    return shapes.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min("id").alias("id")).select("id", column)


def _copies(shapes: DataFrame, column: str, name: str) -> DataFrame:
    """(name, copy): each row's own id as ``copy`` beside the id that stands for its shape."""
    one = _shapes(shapes, column).withColumnRenamed("id", name)
    return shapes.select(column, F.col("id").alias("copy")).join(one, column).select(name, "copy")


def _to_copies(pairs: DataFrame, shapes: DataFrame, column: str, name: str) -> DataFrame:
    """``pairs`` with each id of ``name`` replaced by those of all copies of its shape."""
    others = [c for c in pairs.columns if c != name]
    return pairs.join(_copies(shapes, column, name), name).select(*others, F.col("copy").alias(name)).select(*pairs.columns)


def bucket_size(parts: DataFrame) -> float:
    """Some times the mean extent of the segments: so that few buckets hold a segment and few segments a bucket."""
    n = parts.agg(F.avg(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))))).first()[0]
    return float(n) * 4 if n else 1.0


def _in_buckets(parts: DataFrame, cell: float) -> DataFrame:
    """Each segment in the buckets (bx, by) that it runs through: columns of the grid, and in each the rows between its ends there."""
    pad = 1e-9 * cell
    lo, hi = F.least("x1", "x2"), F.greatest("x1", "x2")
    p = parts.withColumn("bx", F.explode(F.sequence(F.floor((lo - pad) / cell), F.floor((hi + pad) / cell))))
    at = lambda x: F.when(F.col("x1") == F.col("x2"), None).otherwise(F.col("y1") + (F.col("y2") - F.col("y1")) * (F.least(F.greatest(x, lo), hi) - F.col("x1")) / (F.col("x2") - F.col("x1")))
    a, b = F.coalesce(at(F.col("bx") * cell), "y1"), F.coalesce(at((F.col("bx") + 1) * cell), "y2")
    return p.withColumn("by", F.explode(F.sequence(F.floor((F.least(a, b) - pad) / cell), F.floor((F.greatest(a, b) + pad) / cell))))


_COORDINATES = ("x1", "y1", "x2", "y2")


def meetings(a: DataFrame, b: DataFrame, cell: float, same: bool = False) -> DataFrame:
    """(a_id, a_part, a_ord, b_id, b_part, b_ord, x, y): places where segments of ``a`` and ``b`` meet, both ends of what they share.

    same: ``a`` and ``b`` are one table; each pair of segments is met once.
    """
    side = lambda df, s: _in_buckets(df, cell).select("bx", "by", *(F.col(c).alias(f"{s}_{c}") for c in ("id", "part", "ord", *_COORDINATES)))
    j = side(a, "a").join(side(b, "b"), ["bx", "by"])
    if same:
        key = lambda s: F.struct(*(F.col(f"{s}_{c}") for c in ("id", "part", "ord")))
        j = j.filter(key("a") < key("b"))
    (p1x, p1y, p2x, p2y), (q1x, q1y, q2x, q2y) = ([F.col(f"{s}_{c}") for c in _COORDINATES] for s in "ab")
    rx, ry, sx, sy = p2x - p1x, p2y - p1y, q2x - q1x, q2y - q1y
    d = rx * sy - ry * sx
    t, u = ((q1x - p1x) * sy - (q1y - p1y) * sx) / d, ((q1x - p1x) * ry - (q1y - p1y) * rx) / d
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ends = {"p1": pt(p1x, p1y), "p2": pt(p2x, p2y), "q1": pt(q1x, q1y), "q2": pt(q2x, q2y)}
    cross = F.when(t == 0, ends["p1"]).when(t == 1, ends["p2"]).when(u == 0, ends["q1"]).when(u == 1, ends["q2"]).otherwise(pt(p1x + t * rx, p1y + t * ry))
    within = lambda p, c: (p["x"] >= F.least(c[0], c[2])) & (p["x"] <= F.greatest(c[0], c[2])) & (p["y"] >= F.least(c[1], c[3])) & (p["y"] <= F.greatest(c[1], c[3]))
    P, Q = (p1x, p1y, p2x, p2y), (q1x, q1y, q2x, q2y)
    along = F.array_compact(F.array(*(F.when(within(ends[k], c), ends[k]) for k, c in (("p1", Q), ("p2", Q), ("q1", P), ("q2", P)))))
    none = F.array().cast(POINTS)
    places = F.when(d != 0, F.when(t.between(0, 1) & u.between(0, 1), F.array(cross)).otherwise(none)).when((q1x - p1x) * ry - (q1y - p1y) * rx == 0, F.array_distinct(along)).otherwise(none)
    near = (F.least(p1x, p2x) <= F.greatest(q1x, q2x)) & (F.least(q1x, q2x) <= F.greatest(p1x, p2x)) & (F.least(p1y, p2y) <= F.greatest(q1y, q2y)) & (F.least(q1y, q2y) <= F.greatest(p1y, p2y))
    names = [f"{s}_{c}" for s in "ab" for c in ("id", "part", "ord")]
    met = j.filter(near).select("bx", "by", *names, F.explode(places).alias("p"))
    return met.filter((F.floor(F.col("p.x") / cell) == F.col("bx")) & (F.floor(F.col("p.y") / cell) == F.col("by"))).select(*names, "p.x", "p.y")


def split(parts: DataFrame, places: DataFrame) -> DataFrame:
    """(id, ax, ay, bx, by): segments cut at places(id, part, ord, x, y) on them, each piece from its lesser end to its greater."""
    key = ["id", "part", "ord"]
    every = places.join(parts, key).select(*key, *_COORDINATES, "x", "y")
    for x, y in (("x1", "y1"), ("x2", "y2")):
        every = every.unionByName(parts.select(*key, *_COORDINATES, F.col(x).alias("x"), F.col(y).alias("y")))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / (dx * dx + dy * dy)
    cut = every.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct(t.alias("t"), "x", "y"))).alias("p"))
    step = cut.select("id", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    a, b = (F.struct(p["x"].alias("x"), p["y"].alias("y")) for p in (F.col("p")[F.col("k") - 1], F.col("p")[F.col("k")]))
    s = step.select("id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b")
    return s.select("id", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def inside(points: DataFrame, polygons: DataFrame, cell: float, keep: list[str]) -> DataFrame:
    """(keep.., polygon): for points(keep.., x, y) the polygons that hold them: an odd number of edges crosses the ray to the left."""
    part = edges(polygons)
    wide = cell * COARSE
    box = part.groupBy(F.col("id").alias("polygon")).agg(F.min(F.least("x1", "x2")).alias("_x0"), F.max(F.greatest("x1", "x2")).alias("_x1"), F.min(F.least("y1", "y2")).alias("_y0"), F.max(F.greatest("y1", "y2")).alias("_y1"))
    for c, a, b in (("_cx", "_x0", "_x1"), ("_cy", "_y0", "_y1")):
        box = box.withColumn(c, F.explode(F.sequence(F.floor(F.col(a) / wide), F.floor(F.col(b) / wide))))
    p = points.select(*keep, "x", "y", F.floor(F.col("x") / wide).alias("_cx"), F.floor(F.col("y") / wide).alias("_cy"), F.floor(F.col("y") / cell).alias("_band"))
    may = p.join(box, ["_cx", "_cy"]).filter("x > _x0 AND x < _x1 AND y > _y0 AND y < _y1").select(*keep, "x", "y", "_band", "polygon")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    band = part.filter("y1 <> y2").select(F.col("id").alias("polygon"), *_COORDINATES, F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))).alias("_band"))
    j = may.join(band, ["polygon", "_band"])
    crossed = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") > F.col("x1") + (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")))
    return j.groupBy(*keep, "polygon").agg(F.count_if(crossed).alias("_n")).filter("_n % 2 = 1").drop("_n")


def _sides(pieces: DataFrame, keep: list[str]) -> DataFrame:
    """(keep.., side, x, y): a place left and a place right of the middle of each piece."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    s = pieces.select(*keep, *(c for c in ("ax", "ay", "bx", "by") if c not in keep), F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"))
    return s.select(*keep, "side", ((F.col("ax") + F.col("bx")) / 2 - F.col("side") * ASIDE * dy).alias("x"), ((F.col("ay") + F.col("by")) / 2 + F.col("side") * ASIDE * dx).alias("y"))


def intersecting(a: DataFrame, b: DataFrame, a_column: str = "rings", b_column: str = "rings", cell: float | None = None) -> DataFrame:
    """(a_id, b_id): shapes that have a place in common, borders included. Columns: ``rings`` of polygons or ``pts`` of lines."""
    every_a, every_b, a, b = a, b, _shapes(a, a_column), _shapes(b, b_column)
    sa, sb = edges(a, a_column), edges(b, b_column)
    cell = cell or bucket_size(sa.unionByName(sb))
    found = meetings(sa, sb, cell).select("a_id", "b_id")
    # without a meeting of borders one shape lies in the other as a whole, with all its points; a ring of its own may be the one that does
    first = lambda s: s.groupBy("id", "part").agg(F.min(F.struct("ord", "x1", "y1")).alias("m")).select("id", F.col("m.x1").alias("x"), F.col("m.y1").alias("y"))
    if b_column == "rings":
        found = found.unionByName(inside(first(sa), b, cell, ["id"]).select(F.col("id").alias("a_id"), F.col("polygon").alias("b_id")))
    if a_column == "rings":
        found = found.unionByName(inside(first(sb), a, cell, ["id"]).select(F.col("polygon").alias("a_id"), F.col("id").alias("b_id")))
    return _to_copies(_to_copies(found.distinct(), every_a, a_column, "a_id"), every_b, b_column, "b_id")


def covering(polygons: DataFrame, lines: DataFrame, cell: float | None = None) -> DataFrame:
    """(polygon, line): polygons that no part of a line leaves; a line may run along the border.

    Lines are cut where they meet borders; a piece is covered if one of its sides is.
    """
    every_polygon, every_line, polygons, lines = polygons, lines, _shapes(polygons, "rings"), _shapes(lines, "pts")
    sp, sl = edges(polygons), edges(lines, "pts")
    cell = cell or bucket_size(sp.unionByName(sl))
    at = meetings(sl, sp, cell).select(F.col("a_id").alias("id"), F.col("a_part").alias("part"), F.col("a_ord").alias("ord"), "x", "y")
    keep = ["id", "ax", "ay", "bx", "by"]
    pieces = split(sl, at).distinct()
    held = inside(_sides(pieces, keep), polygons, cell, [*keep, "side"]).select(*keep, "polygon").distinct()
    counts = held.groupBy("id", "polygon").agg(F.count(F.lit(1)).alias("_k"))
    every = pieces.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    found = counts.join(every, "id").filter("_k = _n").select("polygon", F.col("id").alias("line"))
    return _to_copies(_to_copies(found, every_polygon, "rings", "polygon"), every_line, "pts", "line")


def _stitched(t: pa.Table) -> pa.Table:
    """The edges of one ring, each with the next -> its points without those on straight stretches, and its area (below zero for holes)."""
    ids, after = t.column("eid").to_numpy(), t.column("next").to_numpy()
    order = np.argsort(ids)
    step = order[np.searchsorted(ids[order], after)].tolist()
    way, k = [], int(ids.argmin())
    for _ in range(len(ids)):
        way.append(k)
        k = step[k]
    x, y = (t.column(c).to_numpy()[way] for c in ("sx", "sy"))
    area = float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)
    turn = (x - np.roll(x, 1)) * (np.roll(y, -1) - y) - (y - np.roll(y, 1)) * (np.roll(x, -1) - x)
    x, y = x[turn != 0], y[turn != 0]
    points = [{"x": float(a), "y": float(b)} for a, b in zip(np.r_[x, x[:1]], np.r_[y, y[:1]])]
    return pa.table({"whole": t.column("whole")[:1], "pts": pa.array([points], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), "area": [area]})


@G.tidied
def union_polygons(spark: SparkSession, polygons: DataFrame, cell: float | None = None) -> DataFrame:
    """(whole, rings, area): polygons that overlap or share a stretch of border, merged; ``whole`` is the least of their ids (long).

    Edges are cut where they meet; a piece is border where one of its sides is covered and
    the other is not; border pieces are followed with the inside to the left, and rings come
    largest first: the outer one, then the holes. Polygons that touch in points only stay apart.
    """
    own = G.cut_lineage(spark, _shapes(polygons.select(F.col("id").cast("long").alias("id"), "rings"), "rings"))
    parts = G.cut_lineage(spark, edges(own))
    cell = cell or bucket_size(parts)
    met = G.cut_lineage(spark, meetings(parts, parts, cell, same=True))
    at = lambda s: met.select(F.col(f"{s}_id").alias("id"), F.col(f"{s}_part").alias("part"), F.col(f"{s}_ord").alias("ord"), "x", "y")
    pieces = G.cut_lineage(spark, split(parts, at("a").unionByName(at("b"))).distinct())
    keep = ["ax", "ay", "bx", "by"]
    held = G.cut_lineage(spark, inside(_sides(pieces.select(*keep).distinct(), keep), own, cell, [*keep, "side"]))
    # a polygon belongs to what covers a side of its edges
    links = pieces.join(held, keep).filter("id <> polygon").select(F.col("id").alias("src"), F.col("polygon").alias("dst")).distinct()
    whole = G.components(spark, links, parts.select("id").distinct())
    side = held.groupBy(*keep).agg(F.max("side").alias("_a"), F.min("side").alias("_b"), F.min("polygon").alias("id")).filter("_a = _b")
    ends = lambda a, b: F.when(F.col("_a") == 1, F.col(a)).otherwise(F.col(b))
    border = side.join(whole, "id").select(F.col("component").alias("whole"), ends("ax", "bx").alias("sx"), ends("ay", "by").alias("sy"), ends("bx", "ax").alias("tx"), ends("by", "ay").alias("ty"))
    border = G.cut_lineage(spark, border.withColumn("eid", F.monotonically_increasing_id()))
    on = border.select("whole", F.col("sx").alias("tx"), F.col("sy").alias("ty"), F.col("tx").alias("ux"), F.col("ty").alias("uy"), F.col("eid").alias("next"))
    turn = F.pmod(F.atan2(F.col("sy") - F.col("ty"), F.col("sx") - F.col("tx")) - F.atan2(F.col("uy") - F.col("ty"), F.col("ux") - F.col("tx")), F.lit(2 * np.pi))
    follow = border.join(on, ["whole", "tx", "ty"]).groupBy("eid").agg(F.min_by("next", turn).alias("next"))
    follow = G.cut_lineage(spark, follow)
    ring = G.components(spark, follow.select(F.col("eid").alias("src"), F.col("next").alias("dst")), border.select(F.col("eid").alias("id")))
    rows = border.join(follow, "eid").join(ring.select(F.col("id").alias("eid"), F.col("component").alias("ring")), "eid")
    rings = rows.select("whole", "ring", "eid", "next", "sx", "sy").groupBy("whole", "ring").applyInArrow(_stitched, f"whole long, pts {POINTS}, area double")
    largest = F.sort_array(F.collect_list(F.struct((-F.col("area")).alias("a"), "pts")))
    return rings.groupBy("whole").agg(F.transform(largest, lambda r: r["pts"]).alias("rings"), F.sum("area").alias("area"))


def perimeter(rings: Column) -> Column:
    """Length of all rings together."""
    side = lambda r: F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda n, i: n + F.hypot(r[i]["x"] - r[i - 1]["x"], r[i]["y"] - r[i - 1]["y"]))
    return F.aggregate(F.transform(rings, side), F.lit(0.0), lambda a, v: a + v)
