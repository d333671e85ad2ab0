"""Overlays on a grid of half cells against cells counted by hand, and on slanted shapes against plain geometry."""

import random

from pyspark.sql import functions as F

from terraspark.operators import overlay as O
from terraspark.operators.vector import POINTS


def box(x0, y0, x1, y1):
    return [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


def frame(spark, shapes, column="rings"):
    return spark.createDataFrame(shapes, f"id long, {column} {'array<' + POINTS + '>' if column == 'rings' else POINTS}")


def crossings(x, y, rings):
    return sum(((y1 > y) != (y2 > y)) and x > x1 + (x2 - x1) * (y - y1) / (y2 - y1) for r in rings for (x1, y1), (x2, y2) in zip(r, r[1:]))


def cells(rings, n=24):
    return {(x, y) for x in range(n) for y in range(n) if crossings(x + 0.5, y + 0.5, rings) % 2}


def test_union_of_boxes_and_rings(spark):
    rng = random.Random(7)
    shapes = [(i, [box(x, y, x + rng.randint(1, 6), y + rng.randint(1, 6))]) for i in range(25) for x, y in [(rng.randint(0, 17), rng.randint(0, 17))]]
    shapes += [(100, [box(1, 1, 9, 9), box(3, 3, 7, 7)]), (101, [box(4, 4, 6, 6)]), (102, shapes[0][1]), (103, None), (104, [])]
    of = {i: cells(r or []) for i, r in shapes}
    label = {i: i for i in of if of[i]}
    near = lambda a, b: any((x + p, y + q) in b for x, y in a for p, q in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)))
    for _ in label:
        for i in label:
            for j in label:
                if near(of[i], of[j]):
                    label[i] = label[j] = min(label[i], label[j])
    want = {}
    for i, m in label.items():
        want.setdefault(m, set()).update(of[i])
    for cell in (None, 2.5):
        got = {r["whole"]: r for r in O.union_polygons(spark, frame(spark, shapes), cell).withColumn("p", O.perimeter(F.col("rings"))).collect()}
        assert got.keys() == want.keys()
        for m, c in want.items():
            rings = [[(p["x"], p["y"]) for p in r] for r in got[m]["rings"]]
            assert cells(rings) == c and got[m]["area"] == len(c) and all(r[0] == r[-1] for r in rings)
            assert got[m]["p"] == sum((x + p, y + q) not in c for x, y in c for p, q in ((1, 0), (-1, 0), (0, 1), (0, -1)))


def test_union_of_slanted_shapes(spark):
    # two diamonds that overlap, one that touches the second along a side, one in a corner only
    diamond = lambda x, y, r=2.0: [(x + r, y), (x, y + r), (x - r, y), (x, y - r), (x + r, y)]
    shapes = [(1, [diamond(0.0, 0.0)]), (2, [diamond(2.0, 0.0)[::-1]]), (3, [diamond(4.0, 2.0)]), (4, [diamond(-4.0, 0.0)])]
    got = {r["whole"]: (r["area"], len(r["rings"]), len(r["rings"][0])) for r in O.union_polygons(spark, frame(spark, shapes)).collect()}
    assert got == {1: (22.0, 1, 11), 4: (8.0, 1, 5)} or got == {1: (22.0, 1, 9), 4: (8.0, 1, 5)}
    assert O.union_polygons(spark, frame(spark, shapes).limit(0)).collect() == []


def test_intersects_and_covers(spark):
    rng = random.Random(9)
    polys = [(i, [box(x, y, x + w, y + w)] + ([box(x + 1, y + 1, x + w - 1, y + w - 1)] if w > 4 else [])) for i in range(15) for x, y, w in [(rng.randint(0, 16), rng.randint(0, 16), rng.randint(1, 7))]]
    lines = [(100 + i, [(float(rng.randint(0, 20)), float(rng.randint(0, 20))) for _ in range(rng.randint(2, 4))]) for i in range(40)]
    lines += [(200 + i, [(r[0][0][0], r[0][0][1]), (r[0][1][0], r[0][1][1])]) for i, r in polys]  # along a side
    lines = [(i, [p for k, p in enumerate(pts) if k == 0 or p != pts[k - 1]]) for i, pts in lines]
    lines = [(i, pts) for i, pts in lines if len(pts) > 1]
    closed = lambda x, y, rings: crossings(x, y, rings) % 2 == 1 or any(min(a, c) <= x <= max(a, c) and min(b, d) <= y <= max(b, d) and abs((c - a) * (y - b) - (d - b) * (x - a)) < 1e-9 for r in rings for (a, b), (c, d) in zip(r, r[1:]))

    def places(pts, rings):
        for (x1, y1), (x2, y2) in zip(pts, pts[1:]):
            # borders are at whole numbers: where the line crosses them, and between
            t = sorted({0.0, 1.0} | {(v - x1) / (x2 - x1) for v in range(25) if x2 != x1 and 0 <= (v - x1) / (x2 - x1) <= 1} | {(v - y1) / (y2 - y1) for v in range(25) if y2 != y1 and 0 <= (v - y1) / (y2 - y1) <= 1})
            for a, b in zip(t, t[1:]):
                if b - a > 1e-12:
                    yield from ((x1 + k * (x2 - x1), y1 + k * (y2 - y1)) for k in (a, (a + b) / 2, b))

    meet, cover = set(), set()
    for i, rings in polys:
        for j, pts in lines:
            on = [closed(x, y, rings) for x, y in places(pts, rings)]
            if any(on):
                meet.add((i, j))
            if all(on):
                cover.add((i, j))
    p, ln = frame(spark, polys), frame(spark, lines, "pts")
    assert {tuple(r) for r in O.intersecting(p, ln, "rings", "pts").collect()} == meet and len(cover) > 10
    assert {tuple(r) for r in O.covering(p, ln).collect()} == cover
    both = {tuple(r) for r in O.intersecting(p, p, cell=3.0).collect()}
    assert both == {(b, a) for a, b in both} and all((i, i) in both for i, _ in polys)


def test_copies_of_a_shape_are_looked_at_once(spark, monkeypatch):
    seen, meetings = [], O.meetings

    def counted(a, b, cell, same=False):
        seen.append((a.count(), b.count()))
        return meetings(a, b, cell, same)

    monkeypatch.setattr(O, "meetings", counted)
    kinds = [box(0, 0, 4, 4), box(2, 2, 6, 6), box(20, 20, 22, 22)]
    polys = frame(spark, [(i, [kinds[i % 3]]) for i in range(5, 65)])
    lines = frame(spark, [(100 + i, [(1.0, 1.0), (3.0, 3.0)] if i % 2 else [(5.0, 5.0), (9.0, 5.0)]) for i in range(20)], "pts")
    assert {tuple(r) for r in O.intersecting(polys, lines, "rings", "pts").collect()} == {(i, 100 + k) for i in range(5, 65) for k in range(20) if (i % 3 < 2 if k % 2 else i % 3 == 1)}
    cover = O.covering(polys, lines).collect()
    assert sorted(tuple(r) for r in cover) == [(i, 100 + k) for i in range(5, 65) if i % 3 == 0 for k in range(20) if k % 2]
    union = O.union_polygons(spark, polys).collect()
    assert sorted((r["whole"], r["area"]) for r in union) == [(5, 4.0), (6, 28.0)]
    # three shapes of four edges, two of one: whatever the number of copies
    assert seen == [(12, 2), (2, 12), (12, 12)]
