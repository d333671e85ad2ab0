"""Queries without SQL over whole tables, against brute force on small ones."""

import random

import pytest

import __spark_entry__ as entry
from terraspark.plans.fixtures import r4


@pytest.fixture(scope="module")
def ways(spark, tmp_path_factory):
    """A table of lines whose ways share cells; a few ways have one cell only."""
    rng = random.Random(5)
    rows = [(way, n + 1, rng.randrange(60), 1, float(rng.randint(1, 50)), 1.0) for way in range(1, 41) for n in range(rng.randint(1, 4))]
    rows += [(100, 1, 900, 1, 7.0, 1.0)]
    at = str(tmp_path_factory.mktemp("ways"))
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{at}/lineitem.parquet")
    lines: dict = {}
    for r in r4(spark, at).orderBy("way", "ord").collect():
        lines.setdefault(r["way"], []).append((r["cell"], r["level"]))
    return at, lines


def test_step_limit_takes_all_ways(spark, ways):
    at, lines = ways
    level: dict = {}
    for line in lines.values():
        for cell, h in line:
            level[cell] = max(level.get(cell, 0), h)
    arcs = {(a[0], b[0]) for line in lines.values() for a, b in zip(line, line[1:])}
    moved = True
    while moved:
        moved = False
        for a, b in arcs:
            if level[a] > level[b] + 1:
                level[a], moved = level[b] + 1, True
    assert {r["id"]: r["level"] for r in entry.queries()["gra06_step_limit"](spark, at).collect()} == level


def test_strong_components_take_all_ways(spark, ways):
    at, lines = ways
    cells = sorted({c for line in lines.values() for c, _ in line})
    reach = {c: {c} for c in cells}
    arcs = [(a[0], b[0]) for line in lines.values() for a, b in zip(line, line[1:])]
    for _ in cells:
        for a, b in arcs:
            reach[a] |= reach[b]
    want = {c: min(x for x in reach[c] if c in reach[x]) for c in cells}
    assert {r["id"]: r["scc"] for r in entry.queries()["gra07_strong_components"](spark, at).collect()} == want


def test_fit_paths_take_the_whole_raster(spark):
    from terraspark.plans.queries import _river_cells

    sf = "/root/testdata/sf0.001"
    cells = {r["id"]: (r["z"], r["x"]) for r in _river_cells(spark, sf).collect()}
    at = {p: i for i, p in cells.items()}
    label, parts = {}, 0
    for start in cells:
        if start not in label:
            parts += 1
            label[start], work = parts, [start]
            while work:
                z, x = cells[work.pop()]
                for p in ((z + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                    if p in at and at[p] not in label:
                        label[at[p]] = parts
                        work.append(at[p])
    out = {r["id"]: r["parent"] for r in entry.queries()["gra03_fit_paths"](spark, sf).collect()}
    assert set(out) == set(cells) and max(z for z, _ in cells.values()) >= 120
    outlets = [label[i] for i, p in out.items() if p == -1]
    assert sorted(outlets) == list(range(1, parts + 1))
    assert all(p == -1 or max(abs(cells[i][0] - cells[p][0]), abs(cells[i][1] - cells[p][1])) == 1 for i, p in out.items())
