"""The settle loop and the tables that graph operators leave, against loops over cells."""

import os
import random

from terraspark.operators import graph as G


def by_hand(cells, section, ways):
    level = {i: v for i, (_, _, v) in cells.items()}
    place = {(z, x): i for i, (z, x, _) in cells.items()}

    def fix(arcs):
        moved, any_ = True, False
        while moved:
            moved = False
            for a, b, c in arcs:
                if level[a] + c < level[b]:
                    level[b], moved, any_ = level[a] + c, True, True
        return any_

    near = [(i, place[z + a, x + b], 1) for i, (z, x, _) in cells.items() for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (z + a, x + b) in place]
    down = [(a, b, 0) for w in ways for a, b in zip(w, w[1:])]
    while True:
        flat = False
        least = {}
        for i, c in section.items():
            least[c] = min(least.get(c, 999), level[i])
        for i, c in section.items():
            flat |= least[c] < level[i]
            level[i] = min(level[i], least[c])
        fix(near)
        if not fix(down) and not flat:
            return level


def test_settle_over_tiles(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        cells = {z * 11 + x: (z, x, rng.randint(50, 90)) for z in range(12) for x in range(11) if rng.random() < 0.7}
        ids = sorted(cells)
        section = {i: rng.choice(ids) for i in ids if rng.random() < 0.3}
        ways = [sorted(rng.sample(ids, 5)) for _ in range(6)]
        want = by_hand(cells, section, ways)
        frame = lambda rows, t: spark.createDataFrame(rows, t)
        c = frame([(i, *v) for i, v in cells.items()], "id long, z int, x int, level int")
        s = frame(list(section.items()), "id long, center long")
        w = frame([(k, o, i) for k, way in enumerate(ways) for o, i in enumerate(way)], "way long, ord int, cell long")
        for span, width in ((16, 11), (G.SPAN, None)):
            assert {r["id"]: r["level"] for r in G.settle(spark, c, s, w, span=span, width=width).collect()} == want


def test_only_the_result_stays(spark):
    e = spark.createDataFrame([(i, (i * 7 + 3) % 40) for i in range(40)], "src long, dst long")
    n = e.select("src").withColumnRenamed("src", "id")
    for work in (lambda: G.components(spark, e, n, 8), lambda: G.scc(spark, e, 8)):
        before = set(G._MADE)
        out = work()
        assert set(G._MADE) - before == {out.written_at} and os.path.isdir(out.written_at.removeprefix("file:"))
        assert all(os.path.isdir(p.removeprefix("file:")) for p in G._MADE)


def test_query_by_hand(spark):
    from terraspark.plans import more_queries, queries

    sf = "/root/testdata/sf0.001"
    cells = {r["id"]: (r["z"], r["x"], r["level"]) for r in queries._river_cells(spark, sf).collect()}
    first, ways = {}, {}
    for i, (z, x, _) in sorted(cells.items()):
        first[z // 4, x // 4] = min(first.get((z // 4, x // 4), i), i)
        ways.setdefault(x, []).append(i)
    want = by_hand(cells, {i: first[z // 4, x // 4] for i, (z, x, _) in cells.items()}, list(ways.values()))
    assert {r["id"]: r["level"] for r in more_queries.gra11(spark, sf).collect()} == want
