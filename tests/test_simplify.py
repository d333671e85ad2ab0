"""Crossings found through a grid, and borders that stay shared."""

import random
import time

import numpy as np

from terraspark.operators import vector as V


def all_pairs(p):
    side = lambda o, q, r: (q[0] - o[0]) * (r[1] - o[1]) - (q[1] - o[1]) * (r[0] - o[0])
    s = list(zip(p, p[1:]))
    return any(side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0 for i, (a, b) in enumerate(s) for c, d in s[i + 1 :])


def test_crossings_by_all_pairs():
    rng = np.random.default_rng(1)
    found = 0
    for k in range(400):
        n = int(rng.integers(2, 25))
        step = rng.normal(size=(n, 2)) * rng.choice([0.01, 1, 30], (n, 1)) + [rng.choice([0.0, 1.0, 3.0]), 0]
        p = np.round(np.cumsum(step, axis=0), int(rng.integers(0, 4)))
        found += all_pairs(p.tolist())
        assert V.crosses_itself(p) == all_pairs(p.tolist())
    assert 50 < found < 350


def test_a_million_points_in_seconds():
    t = np.arange(1_000_000)
    rng = np.random.default_rng(2)
    p = np.stack([t * 0.5, np.cumsum(rng.normal(size=len(t)))], axis=1)
    began = time.time()
    out = V.simplified(p, 40.0)
    assert 2 < len(out) < len(p) / 10 and not V.crosses_itself(out) and not V.crosses_itself(p)
    assert time.time() - began < 60
    tail = np.concatenate([p, [[p[-1, 0] + 1, -1e6], [400_000.25, -1e6], [400_000.25, 1e6]]])
    assert V.crosses_itself(tail)


def edges(p):
    return {tuple(sorted((tuple(a), tuple(b)))) for a, b in zip(p, p[1:])}


def test_shared_borders_stay_shared(spark):
    rng = random.Random(3)
    n = 6
    corner = {(i, j): (i * 100.0, j * 100.0) for i in range(n + 1) for j in range(n + 1)}
    way = {}
    for (i, j), a in corner.items():
        for b in ((i + 1, j), (i, j + 1)):
            if b in corner:  # a jagged way between two corners
                c = corner[b]
                way[(i, j), b] = [a, *((a[0] + (c[0] - a[0]) * k / 20 + rng.uniform(-4, 4) * (c[0] == a[0]), a[1] + (c[1] - a[1]) * k / 20 + rng.uniform(-4, 4) * (c[1] == a[1])) for k in range(1, 20)), c]
    run = lambda a, b: way[a, b] if (a, b) in way else way[b, a][::-1]
    rings = []
    for i in range(n):
        for j in range(n):
            c = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1), (i, j)]
            c = c if rng.random() < 0.5 else c[::-1]
            ring = [p for a, b in zip(c, c[1:]) for p in run(a, b)[:-1]]
            k = rng.randrange(len(ring))  # rings begin anywhere
            ring = ring[k:] + ring[:k]
            rings.append((i * n + j, ring + ring[:1]))
    hole = [(float(5000 + 30 * np.cos(t)), float(30 * np.sin(t) + rng.uniform(-1, 1))) for t in np.linspace(0, 6.2, 60)]
    rings += [(100, hole + hole[:1]), (101, (hole[20:] + hole[:20] + hole[20:21])[::-1]), (102, None), (103, [(1.0, 1.0)])]
    df = spark.createDataFrame([(i, p, "k") for i, p in rings], f"id long, pts {V.POINTS}, _at string").repartition(3)
    got = {r["id"]: None if r["pts"] is None else [(p["x"], p["y"]) for p in r["pts"]] for r in V.simplify_shared(df, 3.0).drop("_at").collect()}
    given = dict(rings)
    assert got[102] is None and got[103] == given[103] and edges(got[100]) == edges(got[101]) and len(got[100]) < len(hole)
    seen = {}
    for i in range(n * n):
        assert got[i][0] == got[i][-1] and len(got[i]) < len(given[i]) / 1.5 and set(got[i]) <= set(given[i])
        for e in edges(got[i]):
            seen[e] = seen.get(e, 0) + 1
    # every edge inside the sheet belongs to two rings
    inner = [e for e in seen if not any(min(abs(v), abs(v - n * 100.0)) < 5 for p in e for v in p)]
    assert len(inner) > 100 and all(seen[e] == 2 for e in inner)
    assert sum(v == 2 for v in seen.values()) > sum(v == 1 for v in seen.values())
