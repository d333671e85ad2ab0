"""Vector features as arrays of points, and their rasters.

lines(id, pts array<struct<x, y>>), polygons(id, rings array<array<struct<x, y>>>)
in pixel units unless said otherwise: cell (z, x) covers [x, x+1) by [z, z+1).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

POINTS = "array<struct<x:double,y:double>>"


def box_ring(x0: Column, z0: Column, x1: Column, z1: Column) -> Column:
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(pt(x0, z0), pt(x1, z0), pt(x1, z1), pt(x0, z1), pt(x0, z0))


def segments(lines: DataFrame, pts: str = "pts", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(.., ord, x1, y1, x2, y2): consecutive points of each line."""
    i = F.explode(F.sequence(F.lit(1), F.size(pts) - 1))
    s = lines.filter(F.size(pts) > 1).select(*keep, pts, i.alias("ord"))
    a, b = F.col(pts)[F.col("ord") - 1], F.col(pts)[F.col("ord")]
    return s.select(*keep, "ord", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def length(pts: Column) -> Column:
    n = F.size(pts)
    step = lambda i: F.hypot(pts[i]["x"] - pts[i - 1]["x"], pts[i]["y"] - pts[i - 1]["y"])
    return F.when(n < 2, 0.0).otherwise(F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.coalesce(step(i), F.lit(0.0))), F.lit(0.0), lambda a, v: a + v))


def envelope(pts: Column) -> dict[str, Column]:
    x, y = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return {"x0": F.array_min(x), "y0": F.array_min(y), "x1": F.array_max(x), "y1": F.array_max(y)}


def pixel_window(pts: Column, margin: int, width: int, height: int) -> dict[str, Column]:
    """Half-open window of whole cells around a geometry, with a margin, inside the map."""
    e = envelope(pts)
    cut = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n)).cast("int")
    return {"wx0": cut(F.floor(e["x0"]) - margin, width), "wz0": cut(F.floor(e["y0"]) - margin, height), "wx1": cut(F.ceil(e["x1"]) + margin, width), "wz1": cut(F.ceil(e["y1"]) + margin, height)}


def by_tile(shapes: DataFrame, pts: str, size: int) -> DataFrame:
    """A row for each tile that a shape's envelope meets: the key of an equi-join in place of a range join."""
    e = envelope(F.col(pts))
    span = lambda a, b: F.explode(F.sequence(F.floor(a / size), F.floor(b / size)))
    return shapes.withColumn("tx", span(e["x0"], e["x1"])).withColumn("tz", span(e["y0"], e["y1"]))


def fill_polygons(polygons: DataFrame, height: int, width: int, rings: str = "rings") -> DataFrame:
    """(id, z, x): cells whose middle lies inside, by even-odd crossings of each row."""
    edge = segments(polygons.select("id", F.explode(rings).alias("pts")))
    e = edge.filter("y1 <> y2")
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    # rows whose middle z + 0.5 lies in [lo, hi)
    first, last = F.greatest(F.ceil(lo - 0.5), F.lit(0)), F.least(F.ceil(hi - 0.5) - 1, F.lit(height - 1))
    e = e.withColumn("_f", first.cast("int")).withColumn("_l", last.cast("int")).filter("_f <= _l").withColumn("z", F.explode(F.sequence("_f", "_l")))
    cross = e.select("id", "z", (F.col("x1") + (F.col("z") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("cx"))
    w = W.partitionBy("id", "z").orderBy("cx")
    pair = cross.withColumn("_n", F.row_number().over(w)).withColumn("_to", F.lead("cx").over(w)).filter("_n % 2 = 1 AND _to IS NOT NULL")
    a, b = F.greatest(F.ceil(F.col("cx") - 0.5), F.lit(0)).cast("int"), F.least(F.ceil(F.col("_to") - 0.5) - 1, F.lit(width - 1)).cast("int")
    return pair.withColumn("_a", a).withColumn("_b", b).filter("_a <= _b").select("id", "z", F.explode(F.sequence("_a", "_b")).alias("x")).distinct()


def _square_distance(x: Column, y: Column) -> Column:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.when(dx * dx + dy * dy == 0, 0.0).otherwise(F.least(F.greatest(((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0)))
    return (x - F.col("x1") - t * dx) ** 2 + (y - F.col("y1") - t * dy) ** 2


def buffer_lines(lines: DataFrame, half: str, height: int, width: int) -> DataFrame:
    """(id, z, x): cells whose middle lies within column ``half`` of the line."""
    s = segments(lines, keep=("id", half))
    h = F.col(half)
    rng = lambda a, b, n: F.sequence(F.greatest(F.floor(F.least(a, b) - h - 0.5), F.lit(0)).cast("int"), F.least(F.ceil(F.greatest(a, b) + h), F.lit(n - 1)).cast("int"))
    ok = (F.greatest("x1", "x2") + h >= 0) & (F.least("x1", "x2") - h < width) & (F.greatest("y1", "y2") + h >= 0) & (F.least("y1", "y2") - h < height)
    c = s.filter(ok).withColumn("z", F.explode(rng(F.col("y1"), F.col("y2"), height))).withColumn("x", F.explode(rng(F.col("x1"), F.col("x2"), width)))
    return c.filter(_square_distance(F.col("x") + 0.5, F.col("z") + 0.5) <= h * h).select("id", "z", "x").distinct()


def buffer_polygons(polygons: DataFrame, by: float, height: int, width: int) -> DataFrame:
    """(id, z, x): cells inside, or whose middle lies within ``by`` of the outline."""
    edge = polygons.select("id", F.explode("rings").alias("pts"), F.lit(float(by)).alias("half"))
    return fill_polygons(polygons, height, width).unionByName(buffer_lines(edge, "half", height, width)).distinct()


def touch_lines(lines: DataFrame, height: int, width: int) -> DataFrame:
    """(id, z, x): every cell that a line passes through, by its crossings with the grid's lines."""
    s = segments(lines)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    inner = lambda a, b: F.when(F.floor(F.greatest(a, b)) > F.floor(F.least(a, b)), F.sequence(F.floor(F.least(a, b)) + 1, F.floor(F.greatest(a, b)))).otherwise(F.array().cast("array<bigint>"))
    ts = F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.transform(inner(F.col("x1"), F.col("x2")), lambda v: (v - F.col("x1")) / dx), F.transform(inner(F.col("y1"), F.col("y2")), lambda v: (v - F.col("y1")) / dy))
    s = s.withColumn("_t", F.sort_array(ts)).withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_t") - 1)))
    mid = (F.col("_t")[F.col("_i") - 1] + F.col("_t")[F.col("_i")]) / 2
    c = s.select("id", F.floor(F.col("y1") + mid * dy).cast("int").alias("z"), F.floor(F.col("x1") + mid * dx).cast("int").alias("x"))
    return c.filter(F.col("z").between(0, height - 1) & F.col("x").between(0, width - 1)).distinct()


def trace(lines: DataFrame, height: int, width: int) -> DataFrame:
    """(id, ord, z, x): cells along each line, in order: steps of at most one cell, truncated toward zero; only consecutive repeats go, the last cell always stands."""
    s = segments(lines)
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))))).cast("int")
    s = s.withColumn("_n", steps).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = s.select("id", "ord", "_k", (F.col("y1") + (F.col("y2") - F.col("y1")) * F.col("_k") / F.col("_n")).cast("int").alias("z"), (F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("_k") / F.col("_n")).cast("int").alias("x"), F.lit(False).alias("_end"))
    end = lines.select("id", F.element_at("pts", -1).alias("_p"), F.size("pts").alias("ord")).select("id", "ord", F.lit(0).alias("_k"), F.col("_p.y").cast("int").alias("z"), F.col("_p.x").cast("int").alias("x"), F.lit(True).alias("_end"))
    every = at.unionByName(end).filter(F.col("z").between(0, height - 1) & F.col("x").between(0, width - 1))
    w = W.partitionBy("id").orderBy("ord", "_k")
    every = every.withColumn("_p", F.lag(F.struct("z", "x")).over(w)).filter(F.col("_end") | F.col("_p").isNull() | (F.col("_p") != F.struct("z", "x")))
    return every.select("id", (F.row_number().over(w) - 1).alias("ord"), "z", "x")


def clip_lines(lines: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """(id, part, pts): the pieces of each line inside a box, in order (Liang-Barsky per segment, joined natively)."""
    s = segments(lines)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def limits(p: Column, q: Column) -> tuple[Column, Column, Column]:
        r = q / F.when(p == 0, F.lit(1.0)).otherwise(p)
        return F.when(p < 0, r).otherwise(0.0), F.when(p > 0, r).otherwise(1.0), (p == 0) & (q < 0)

    sides = [limits(-dx, F.col("x1") - x0), limits(dx, x1 - F.col("x1")), limits(-dy, F.col("y1") - y0), limits(dy, y1 - F.col("y1"))]
    s = s.withColumn("_a", F.greatest(F.lit(0.0), *(a for a, _, _ in sides))).withColumn("_b", F.least(F.lit(1.0), *(b for _, b, _ in sides)))
    for *_, out in sides:
        s = s.filter(~out)
    s = s.filter("_a < _b")
    w = W.partitionBy("id").orderBy("ord")
    new = F.coalesce((F.lag("ord").over(w) != F.col("ord") - 1) | (F.lag("_b").over(w) < 1) | (F.col("_a") > 0), F.lit(True))
    s = s.withColumn("part", F.sum(new.cast("int")).over(w))
    pt = lambda t: F.struct((F.col("x1") + t * dx).alias("x"), (F.col("y1") + t * dy).alias("y"))
    g = s.groupBy("id", "part").agg(F.sort_array(F.collect_list(F.struct("ord", pt(F.col("_a")).alias("p"), pt(F.col("_b")).alias("q")))).alias("_s"))
    return g.select("id", "part", F.concat(F.array(F.col("_s")[0]["p"]), F.transform("_s", lambda r: r["q"])).alias("pts"))


def _clip_ring(p: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Sutherland-Hodgman against the four sides of a box: points (n, 2) of an open ring, all edges of a side at once."""
    x0, y0, x1, y1 = box
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        if not len(p):
            return p
        q = np.roll(p, -1, axis=0)
        a, b = sign * (p[:, axis] - limit) >= 0, sign * (q[:, axis] - limit) >= 0
        t = (limit - p[:, axis]) / np.where(a != b, q[:, axis] - p[:, axis], 1.0)
        cut = p + t[:, None] * (q - p)
        # a point that is inside, then where its edge crosses the side
        p = np.stack([p, cut], axis=1).reshape(-1, 2)[np.stack([a, a != b], axis=1).ravel()]
    return p


def _points(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and coordinates (n, 2) of lists of points."""
    flat = column.flatten()
    at = np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
    return at, np.stack([flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("x", "y")], axis=1) if len(flat) else np.zeros((0, 2))


def _listed(parts: list[np.ndarray], mask: np.ndarray | None = None) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.zeros((0, 2))
    points = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)), points, mask=None if mask is None else pa.array(mask))


def _over(df: DataFrame, column: str, kind: str, fn) -> DataFrame:
    """``df`` with a column made of itself by an Arrow kernel; the others pass through."""
    schema = StructType([StructField(f.name, next(iter(StructType.fromDDL(f"a {kind}"))).dataType) if f.name == column else f for f in df.schema])
    at = df.columns.index(column)

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = fn(columns[at])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, schema)


def clip_polygons(polygons: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Rings cut to a box; rings without area left are dropped, polygons without rings too."""

    def cut(column: pa.ListArray) -> pa.ListArray:
        rings = column.flatten()
        at, flat = _points(rings)
        made, kept = [], np.zeros(len(rings), bool)
        for i in range(len(rings)):
            p = flat[at[i] : at[i + 1]]
            if len(p) > 1 and (p[0] == p[-1]).all():
                p = p[:-1]
            p = _clip_ring(p, (x0, y0, x1, y1))
            q = np.roll(p, -1, axis=0)
            if len(p) > 2 and abs((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum()) > 1e-12:
                made.append(np.concatenate([p, p[:1]]))
                kept[i] = True
        many = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(column)), many)
        left = np.bincount(of[kept], minlength=len(column))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(left)].astype(np.int32)), _listed(made))

    return _over(polygons, "rings", f"array<{POINTS}>", cut).filter(F.size("rings") > 0)


def douglas_peucker(p: np.ndarray, tolerance: float) -> np.ndarray:
    """The places of the points (n, 2) that stay: those farthest from a chord, as long as they are farther than the tolerance."""
    keep, open_ = np.zeros(len(p), bool), [(0, len(p) - 1)]
    keep[[0, -1]] = True
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        d, v = p[b] - p[a], p[a + 1 : b] - p[a]
        n = d @ d
        t = np.clip(v @ d / n, 0.0, 1.0) if n else np.zeros(len(v))
        far = ((v - t[:, None] * d) ** 2).sum(1)
        k = int(far.argmax())
        if far[k] > tolerance * tolerance:
            keep[a + 1 + k] = True
            open_ += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.flatnonzero(keep)


def crosses_itself(p: np.ndarray) -> bool:
    """Whether two segments of a line that are not neighbours cross.

    Segments are cut into pieces of about the usual length and put into the buckets of a grid
    that a piece touches; only segments of one bucket are compared.
    """
    a, b = p[:-1], p[1:]
    size = np.abs(b - a).max(axis=1)
    cell = max(float(np.median(size)), float(size.mean()) / 4)
    if cell == 0:
        return False
    many = np.ceil(size / cell).astype(np.int64).clip(1)
    of = np.repeat(np.arange(len(a)), many)
    step = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) / many[of]
    first, last = (a[of] + t[:, None] * (b - a)[of] for t in (step, step + 1 / many[of]))
    # a hair wider, so that no rounding loses a bucket
    low, high = (np.floor((f(first, last) - p.min(axis=0) + e * cell) / cell).astype(np.int64) + 1 for f, e in ((np.minimum, -1e-6), (np.maximum, 1e-6)))
    width = int(high[:, 0].max()) + 2
    keys = np.concatenate([y * width + x for x in (low[:, 0], high[:, 0]) for y in (low[:, 1], high[:, 1])])
    # each segment once a bucket: bucket and segment in one number
    key, k = np.divmod(np.unique(np.unique(keys, return_inverse=True)[1] * len(a) + np.tile(of, 4)), len(a))
    ends = np.searchsorted(key, key, "right")
    side = lambda o, q, r: (q[:, 0] - o[:, 0]) * (r[:, 1] - o[:, 1]) - (q[:, 1] - o[:, 1]) * (r[:, 0] - o[:, 0])
    left, shift = np.arange(len(key)), 1
    while len(left := left[left + shift < ends[left]]):
        i, j = k[left], k[left + shift]
        if ((side(a[i], b[i], a[j]) * side(a[i], b[i], b[j]) < 0) & (side(a[j], b[j], a[i]) * side(a[j], b[j], b[i]) < 0)).any():
            return True
        shift += 1
    return False


def simplified(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Fewer points; a line that did not cross itself still does not, if need be by a finer tolerance."""
    if len(p) < 3:
        return p
    out = p[douglas_peucker(p, tolerance)]
    if len(out) > 3 and crosses_itself(out) and not crosses_itself(p):
        while crosses_itself(out):
            tolerance /= 2
            out = p[douglas_peucker(p, tolerance)]
    return out


def simplify(lines: DataFrame, tolerance: float) -> DataFrame:
    """Lines with the points that matter by more than a tolerance (Douglas-Peucker), without new crossings."""

    def run(column: pa.ListArray) -> pa.ListArray:
        at, flat = _points(column)
        return _listed([simplified(flat[at[i] : at[i + 1]], tolerance) for i in range(len(column))], column.is_null().to_numpy(zero_copy_only=False))

    return _over(lines, "pts", POINTS, run)


def _arcs_simplified(p: np.ndarray, at: np.ndarray, tolerance: float) -> np.ndarray:
    """A line or ring, each stretch between the places ``at`` by itself, and always from its lesser end to its greater."""
    if len(p) < 3:
        return p
    closed = (p[0] == p[-1]).all()
    if closed:
        p = p[:-1]
        # a ring begins where others meet it, or else at its least point
        start = int(at[0]) if len(at) else int(np.lexsort((p[:, 1], p[:, 0]))[0])
        p, at = np.roll(p, -start, axis=0), (at - start) % len(p)
        p = np.concatenate([p, p[:1]])
    cuts = np.unique(np.r_[0, at, len(p) - 1])
    out = []
    for i, j in zip(cuts[:-1], cuts[1:]):
        arc = p[i : j + 1]
        # the same way round for all shapes that share it: the order of its ends, or of the points next to them
        back = next((tuple(u) > tuple(v) for u, v in zip(arc, arc[::-1]) if tuple(u) != tuple(v)), False)
        arc = simplified(arc[::-1], tolerance)[::-1] if back else simplified(arc, tolerance)
        out.append(arc[:-1])
    return np.concatenate([*out, p[-1:]])


def simplify_shared(lines: DataFrame, tolerance: float) -> DataFrame:
    """``simplify`` for lines(id, pts) and rings that share stretches: what they share stays shared.

    Points where lines end or where more than two ways meet are kept; between them every
    stretch is simplified by itself, in the same direction for all lines that run along it.
    Rings are lines whose first point is their last.
    """
    pts = lines.filter(F.size("pts") > 1).select("id", "pts", (F.element_at("pts", 1) == F.element_at("pts", -1)).alias("_c"), F.size("pts").alias("_n"))
    v = pts.select("id", "_c", "_n", "pts", F.posexplode("pts").alias("k", "p")).filter(~F.col("_c") | (F.col("k") < F.col("_n") - 1))
    before = F.when(F.col("k") > 0, F.col("pts")[F.col("k") - 1]).when(F.col("_c"), F.col("pts")[F.col("_n") - 2])
    after = F.when(F.col("k") < F.col("_n") - 1, F.col("pts")[F.col("k") + 1])
    ways = v.select("p", F.explode(F.array(before, after)).alias("q")).distinct()
    # a line's end counts as three ways
    count = ways.groupBy("p").agg(F.count("q").alias("_w"), F.max(F.col("q").isNull()).alias("_e")).filter("_e OR _w <> 2").select("p")
    places = "_at"
    while places in lines.columns:
        places += "_"
    fixed = v.select("id", "k", "p").join(count, "p").groupBy("id").agg(F.sort_array(F.collect_set("k")).alias(places))
    both = lines.join(fixed, "id", "left")
    schema = StructType([StructField(f.name, f.dataType) for f in lines.schema])
    i, names = lines.columns.index("pts"), lines.columns

    def run(batches):
        for batch in batches:
            at, flat = _points(batch.column(i))
            marks = batch.column(len(names)).to_pylist()
            made = [_arcs_simplified(flat[at[j] : at[j + 1]], np.array(marks[j] or [], np.int64), tolerance) for j in range(batch.num_rows)]
            columns = list(batch.columns[: len(names)])
            columns[i] = _listed(made, batch.column(i).is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.select(*names, places).mapInArrow(run, schema)


def outlets(lines: DataFrame, next_down: str, x0: float, y0: float, x1: float, y1: float, simplified: str = "pts", pixel: float = 1.0) -> DataFrame:
    """Lines without a successor whose end lies in the box and within a pixel of the simplified end."""
    e, s = F.element_at("full", -1), F.element_at(simplified, -1)
    return lines.filter((F.col(next_down) == 0) & e["x"].between(x0, x1) & e["y"].between(y0, y1) & (F.hypot(e["x"] - s["x"], e["y"] - s["y"]) <= pixel))


def bank_height(natural: Column, level: Column, d: Column) -> Column:
    """Height of a lake's bank at taxicab distance d, 1 to 6: level at the water, natural at the end."""
    low = F.rint(level + (natural - level) * (d - 1) / 5.0)
    h = F.when(natural < level, low).otherwise(F.least(natural, level + d))
    h = F.least(F.greatest(h, F.lit(1)), F.lit(255))
    return F.when(d == 1, level).when(d == 6, natural).otherwise(h).cast("int")


def line_parts(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """(id, part, pts): the lines among the parts of ``geometry array<struct<kind, pts>>``; other parts are left out."""
    p = features.select("id", F.posexplode(geometry).alias("part", "_g"))
    return p.filter("_g.kind = 'line'").select("id", "part", F.col("_g.pts").alias("pts"))
