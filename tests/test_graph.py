"""Block-wise fixpoints, contraction and path fitting against brute force, with blocks small enough to matter."""

import random

import numpy as np
import pytest

from terraspark.operators import graph as G


def brute_levels(level, arcs):
    level = dict(level)
    moved = True
    while moved:
        moved = False
        for a, b, c in arcs:
            if a in level and b in level and level[a] + c < level[b]:
                level[b], moved = level[a] + c, True
    return level


@pytest.mark.parametrize("span", [1 << 17, 7])
def test_relax_over_blocks(spark, span):
    rng = random.Random(span)
    ids = rng.sample(range(-15, 35), 24)
    level = {i: rng.randint(0, 60) for i in ids}
    arcs = [(rng.choice(ids), rng.choice([*ids, 5000]), rng.randint(0, 2)) for _ in range(60)]
    lv = spark.createDataFrame(list(level.items()), "id long, level int")
    ar = spark.createDataFrame(arcs, "src long, dst long, cost int")
    assert {r["id"]: r["level"] for r in G.relax(spark, lv, ar, span=span).collect()} == brute_levels(level, arcs)
    half = spark.createDataFrame([(a, b, c + 0.5) for a, b, c in arcs], "src long, dst long, cost double")
    assert {r["id"]: r["level"] for r in G.relax(spark, lv, half, span=span).collect()} == brute_levels(level, [(a, b, c + 0.5) for a, b, c in arcs])
    assert G.relax(spark, lv.limit(0), ar, span=span).count() == 0
    assert {r["id"]: r["level"] for r in G.relax(spark, lv, ar.limit(0), span=span).collect()} == level


@pytest.mark.parametrize("kind", ["costs", "nothing", "halves", "many ports"])
@pytest.mark.parametrize("width", [9, None])
def test_relax_over_tiles(spark, monkeypatch, kind, width):
    """Tiles of 3 x 3 cells, some steps of borders up; levels against brute force."""
    if kind == "many ports":
        monkeypatch.setattr(G, "PORTS", 2)
    rng = random.Random(f"{kind}{width}")
    c = [(z, x) for z in range(20) for x in range(9) if rng.random() < 0.75]
    level = {z * 9 + x: rng.randint(0, 99) for z, x in c}
    near = [(z * 9 + x, (z + a) * 9 + x + b) for z, x in c for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and 0 <= x + b < 9]
    cost = {"nothing": lambda: 0, "halves": lambda: rng.choice([0.5, 1.5])}.get(kind, lambda: rng.randint(0, 3))
    arcs = [(a, b, cost()) for a, b in near if kind != "nothing" or rng.random() < 0.3]
    got = G.relax(spark, spark.createDataFrame(list(level.items()), "id long, level int"), spark.createDataFrame(arcs, f"src long, dst long, cost {'double' if kind == 'halves' else 'int'}"), span=9, width=width)
    assert {r["id"]: r["level"] for r in got.collect()} == brute_levels(level, arcs)


def test_a_long_chain_over_many_blocks(spark):
    n = 400
    lv = spark.createDataFrame([(i, 1000 - (i == 0) * 1000) for i in range(n)], "id long, level int")
    ar = spark.createDataFrame([(i, i + 1, 1) for i in range(n - 1)], "src long, dst long, cost int")
    assert {r["id"]: r["level"] for r in G.relax(spark, lv, ar, span=64).collect()} == {i: i for i in range(n)}


@pytest.mark.parametrize("span", [1 << 17, 6])
def test_components_over_blocks(spark, span):
    rng = random.Random(11)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(300 + i, 301 + i) for i in range(90)]
    nodes = sorted({x for e in edges for x in e} | {999})
    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    e = spark.createDataFrame(edges, "src long, dst long")
    got = G.components(spark, e, spark.createDataFrame([(x,) for x in nodes], "id long"), span)
    assert {r["id"]: r["component"] for r in got.collect()} == label
    assert G.components(spark, e.limit(0), spark.createDataFrame([(4,)], "id long")).collect() == [(4, 4)]


def test_isotonic_by_least_squares():
    rng = np.random.default_rng(2)
    for _ in range(200):
        v, outlet = rng.integers(0, 9, rng.integers(1, 9)).astype(float), float(rng.integers(0, 9))
        up = np.r_[outlet, v[::-1]]
        # the min-max formula of isotonic regression
        mean = lambda a, b: up[a : b + 1].mean()
        fit = [max(min(mean(a, b) for b in range(k, len(up))) for a in range(k + 1)) for k in range(len(up))]
        assert np.allclose(G.isotonic(v, outlet), np.maximum(fit[:0:-1], outlet))


@pytest.mark.parametrize("span", [1 << 17, 40])
def test_fit_paths_by_walking(spark, span):
    """Paths taken one after the other, the farthest start first, each up to what is fitted already."""
    rng = np.random.default_rng(span)
    cells, edges, seeds, want = [], [], [], {}
    for tree in range(12):
        n = int(rng.integers(1, 30))
        parent = np.array([-1, *(int(rng.integers(0, i)) for i in range(1, n))])
        cost = rng.choice([1.0, 1.41421356], n)
        dist = np.zeros(n)
        for i in range(1, n):
            dist[i] = dist[parent[i]] + cost[i]
        ids, sample = 100 * tree + np.sort(rng.choice(100, n, replace=False)), rng.integers(1, 60, n).astype(float)
        lost = n > 3 and rng.random() < 0.5  # a cell that nothing reaches
        if lost:
            parent[n - 1], dist[n - 1] = -1, np.inf
        cells += [(int(i), float(v)) for i, v in zip(ids, sample)]
        edges += [(int(ids[a]), int(ids[b]), float(cost[i])) for i in range(1, n) if parent[i] >= 0 for a, b in ((i, parent[i]), (parent[i], i))]
        seeds.append((int(ids[0]),))
        level = np.full(n, np.nan)
        level[0] = sample[0]
        for u in sorted(range(n), key=lambda k: (-dist[k], -ids[k])):
            path = []
            while u >= 0 and np.isnan(level[u]):
                path.append(u)
                u = parent[u]
            if path and u >= 0:
                low = level[u]
                for k, f in list(zip(path, G.isotonic(sample[path], level[u])))[::-1]:
                    low = level[k] = min(f, low + 1)
        level = np.where(np.isnan(level), sample, level)
        want |= {int(i): (float(d), int(ids[p]) if p >= 0 else -1, int(np.clip(np.rint(v), 1, 255))) for i, d, p, v in zip(ids, dist, parent, level)}
    args = [spark.createDataFrame(x, t) for x, t in ((cells, "id long, sample double"), (edges, "src long, dst long, cost double"), (seeds, "id long"))]
    got = {r["id"]: (r["distance"], r["parent"], r["level"]) for r in G.fit_paths(spark, *args, span=span).collect()}
    assert got == want


def test_shortest_paths_on_a_grid(spark):
    rng = np.random.default_rng(6)
    mask = rng.random((8, 9)) > 0.3
    c = [(int(z * 9 + x), int(z), int(x)) for z, x in zip(*np.nonzero(mask))]
    nodes = spark.createDataFrame(c, "id long, z int, x int")
    edges = G.neighbour_edges(nodes)
    e = [tuple(r) for r in edges.collect()]
    seeds = [c[0][0], c[-1][0]]
    dist = {i: 0.0 if i in seeds else np.inf for i, *_ in c}
    for _ in c:
        for a, b, w in e:
            dist[b] = min(dist[b], dist[a] + w)
    got = {r["id"]: r for r in G.shortest_paths(spark, nodes, edges, spark.createDataFrame([(s,) for s in seeds], "id long"), 20).collect()}
    for i, d in dist.items():
        near = [(dist[a], a) for a, b, w in e if b == i and dist[a] + w == d]
        assert got[i]["distance"] == d and got[i]["parent"] == (min(near)[1] if near and 0 < d < np.inf else -1)


@pytest.mark.parametrize("span", [1 << 17, 5])
def test_strong_components_by_reach(spark, span):
    rng = random.Random(span)
    edges = [(rng.randrange(20), rng.randrange(20)) for _ in range(30)] + [(100 + i, 101 + i) for i in range(9)] + [(109, 104), (7, 7), (200, 200)]
    nodes = sorted({x for e in edges for x in e})
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            reach[a] |= reach[b]
    want = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    assert {r["id"]: r["scc"] for r in G.scc(spark, spark.createDataFrame(edges, "src long, dst long"), span).collect()} == want


def test_fixpoints_send_no_tables_through_the_driver(spark, monkeypatch):
    # joins of small tables would be broadcasts: in each round, and each by way of the driver
    plans, write = [], G.cut_lineage

    def seen(session, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(session, df)

    monkeypatch.setattr(G, "cut_lineage", seen)
    ring = [(i, (i * 7 + 1) % 16) for i in range(16)] + [(i, i // 2) for i in range(1, 16)]
    arcs = spark.createDataFrame(ring, "src long, dst long").coalesce(1)
    levels = spark.createDataFrame([(i, 50 - 3 * i) for i in range(16)], "id long, level int").coalesce(1)
    want = {i: 50 - 3 * i for i in range(16)}
    for _ in want:
        for a, b in ring:
            want[a] = min(want[a], want[b] + 1)
    monkeypatch.setattr(G, "PORTS", 0)  # by rounds
    assert {r["id"]: r["level"] for r in G.step_limit(spark, levels, arcs, span=8).collect()} == want
    sent = lambda: [p for p in plans if "BroadcastHashJoin" in p]
    assert len(plans) > 4 and not sent()
    G.scc(spark, arcs, span=1 << 17)
    assert len(plans) > 8 and not sent(), sent()[0][:3000]


def test_paths_are_fitted_by_batches_and_once(spark, monkeypatch):
    # a Python call per path takes far longer than its fit, and cells that are fitted need not be read in later rounds
    plans, left, write = [], [], G.cut_lineage

    def seen(session, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = write(session, df)
        if {"start", "end"} <= set(out.columns):
            left.append(out.count())
        return out

    monkeypatch.setattr(G, "cut_lineage", seen)
    rng = random.Random(4)
    parent, dist = {}, {}
    for tree in range(9):
        for i in range(tree * 100, tree * 100 + 25 + 9 * (tree == 0)):  # longer than a batch
            parent[i] = -1 if i % 100 == 0 else i - 1 if rng.random() < 0.7 else rng.randrange(tree * 100, i)
            dist[i] = 0.0 if i % 100 == 0 else dist[parent[i]] + 1
    sample = {i: float(rng.randint(1, 60)) for i in parent}
    want = {i: sample[i] for i, p in parent.items() if p == -1}
    for u in sorted(parent, key=lambda i: (-dist[i], -i)):
        path = []
        while u not in want:
            path.append(u)
            u = parent[u]
        low = want[u]
        for k, f in list(zip(path, G.isotonic([sample[k] for k in path], low)))[::-1]:
            low = want[k] = min(f, low + 1)
    nodes = spark.createDataFrame(list(sample.items()), "id long, sample double")
    edges = spark.createDataFrame([(a, b, 1.0) for i, p in parent.items() if p >= 0 for a, b in ((i, p), (p, i))], "src long, dst long, cost double")
    seeds = spark.createDataFrame([(i,) for i, p in parent.items() if p == -1], "id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r["id"]: (r["parent"], r["level"]) for r in G.fit_paths(spark, nodes, edges, seeds).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: (p, int(np.clip(np.rint(want[i]), 1, 255))) for i, p in parent.items()}
    assert not [p for p in plans if "FlatMapGroupsInArrow" in p]
    assert len(left) > 3 and left[-1] == 0 and all(a > b for a, b in zip(left, left[1:]))


def test_fits_of_long_and_short_paths_together():
    rng = np.random.default_rng(8)
    n = np.array([1, 300, 2, 64, 65, 1, 63, 0, 90])
    sample, below = rng.integers(1, 60, n.sum()).astype(float), rng.random(len(n)) * 40
    parts = [G.isotonic(v[::-1], o)[::-1] for v, o in zip(np.split(sample, np.cumsum(n)[:-1]), below)]
    assert np.array_equal(G._isotonic(sample, n, below), np.concatenate(parts))


def test_shortest_paths_over_many_blocks_have_parents(spark):
    """Costs summed block by block may differ in the last bit from those of a walk: no reached cell is without a parent for that."""
    rng = np.random.default_rng(3)
    mask = rng.random((120, 30)) > 0.4
    c = [(int(z * 30 + x), int(z), int(x)) for z, x in zip(*np.nonzero(mask))]
    at = {(z, x): i for i, z, x in c}
    near = {i: [(at[z + a, x + b], 1.41421356 if a and b else 1.0) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (z + a, x + b) in at] for i, z, x in c}
    dist, moved = {c[0][0]: 0.0}, [c[0][0]]
    while moved:
        u = moved.pop(0)
        for v, w in near[u]:
            if dist[u] + w < dist.get(v, np.inf):
                dist[v] = dist[u] + w
                moved.append(v)
    assert len(dist) == 2113
    edges = spark.createDataFrame([(i, j, w) for i, js in near.items() for j, w in js], "src long, dst long, cost double")
    got = {r["id"]: r for r in G.shortest_paths(spark, spark.createDataFrame(c, "id long, z int, x int"), edges, spark.createDataFrame(c[:1], "id long, z int, x int"), 240).collect()}
    for i, r in got.items():
        assert r["distance"] == pytest.approx(dist.get(i, np.inf), abs=1e-9)
        if i != c[0][0] and i in dist:
            assert r["parent"] >= 0 and dict(near[i])[r["parent"]] + dist[r["parent"]] == pytest.approx(dist[i], abs=1e-9)
