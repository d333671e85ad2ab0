"""River-network operators: components, outlets, shortest paths, profiles and min-plus fixpoints.

Fixpoints (step limit, relaxation, downstream lowering) have one greatest solution.
They are solved block by block: a block holds the nodes of a square tile of a raster, or
of a range of ids, and a kernel settles it as a whole and reduces it to the costs of the
ways between its border nodes. The graph of the borders, a small part of the nodes, is
solved in the same way with larger blocks, and its levels go back into the blocks that
they lower: each node is settled twice at most, however long the rivers are.
Components are contracted in the same way; shortest paths and strong components are made
of such fixpoints, and profiles are fitted path by path, a generation of tributaries at
a time. Each step is written to the session's checkpoint folder.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraspark.operators.distance import around, ring

NEIGHBOURS = [o for o in ring(1, False) if o != (0, 0)]


def cut_lineage(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder that spark.checkpoint.dir names; a local session without it gets its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="terraspark-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/terraspark/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


#: Folders of ``cut_lineage`` that are not removed yet.
_MADE: list[str] = []


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm = getattr(spark, "_jvm", None)
    for path in paths if jvm is not None else ():
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _MADE.remove(path)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables of ``cut_lineage`` that nothing to come is read from."""
    _remove(spark, [t.written_at for t in tables if t.written_at in _MADE])


def tidied(work):
    """An operator whose result is written, and whose own tables are removed then."""

    @functools.wraps(work)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        mark = len(_MADE)
        out = cut_lineage(spark, work(spark, *args, **kwargs))
        _remove(spark, [p for p in _MADE[mark:] if p != out.written_at])
        return out

    return run


def neighbour_edges(cells: DataFrame) -> DataFrame:
    """(src, dst, cost) between 8-neighbours among ``cells(id, z, x)``; diagonals cost 1.41421356."""
    near = around(cells.select("id", "z", "x"), NEIGHBOURS).select(F.col("id").alias("src"), F.col("nz").alias("z"), F.col("nx").alias("x"), F.when((F.col("dz") != 0) & (F.col("dx") != 0), 1.41421356).otherwise(1.0).alias("cost"))
    return near.join(cells.select(F.col("id").alias("dst"), "z", "x"), ["z", "x"]).select("src", "dst", "cost")


#: Ids of a block: with distinct whole numbers as ids no block holds more nodes.
SPAN = 1 << 17


def _block(column: str, span: int):
    return F.floor(F.col(column) / span)


def _least_members(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 the least node that undirected edges reach."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    return label


def _moved(df: DataFrame) -> DataFrame:
    """One side of a join that both sides are dealt out for: a broadcast sends a table through the driver, round after round."""
    return df.hint("merge")


def _contract(spark: SparkSession, links: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """Solves each block's own links(src, dst, src < dst): (id, root) of their nodes, and the links left between roots."""

    def solve(t: pa.Table) -> pa.Table:
        a, b = t.column("src").to_numpy(), t.column("dst").to_numpy()
        ids = np.unique(np.concatenate([a, b]))
        root = _least_members(len(ids), np.searchsorted(ids, a), np.searchsorted(ids, b))
        return pa.table({"id": ids, "root": ids[root]})

    inner = links.filter(_block("src", span) == _block("dst", span)).withColumn("block", _block("src", span))
    local = cut_lineage(spark, inner.groupBy("block").applyInArrow(solve, "id long, root long"))
    left = links.filter(_block("src", span) != _block("dst", span))
    for c in ("src", "dst"):
        left = left.join(_moved(local.select(F.col("id").alias(c), F.col("root").alias("_r"))), c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
    left = left.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return local, cut_lineage(spark, left)


def _hook(spark: SparkSession, links: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, root) by hooking to the least neighbour and pointer jumping: for links that no blocks hold together."""
    both = cut_lineage(spark, links.select("src", "dst").unionAll(links.select("dst", "src")))
    label = before = cut_lineage(spark, both.select(F.col("src").alias("id")).distinct().withColumn("root", F.col("id")))
    for _ in range(rounds):
        seen = both.join(_moved(label), F.col("dst") == F.col("id")).groupBy("src").agg(F.min("root").alias("m"))
        hooked = label.join(_moved(seen), F.col("id") == F.col("src")).select("id", F.least("root", "m").alias("c"), F.col("root").alias("old"))
        up = hooked.select(F.col("id").alias("_i"), F.col("c").alias("_c"))
        new = cut_lineage(spark, hooked.join(_moved(up), F.col("c") == F.col("_i")).select("id", F.col("_c").alias("root"), (F.col("_c") != F.col("old")).alias("moved")))
        forget(spark, before)
        before, label = new, new.select("id", "root")
        if new.filter("moved").isEmpty():
            forget(spark, both)
            return label
    raise RuntimeError("components: no fixpoint")


@tidied
def components(spark: SparkSession, edges: DataFrame, nodes: DataFrame, span: int = SPAN) -> DataFrame:
    """(id, component): the least id that undirected edges reach; a node without edges is its own.

    Blocks of ids are contracted to their roots, then wider blocks of what is left. Where
    that stops shrinking the links (ids that say nothing about place), the rest is hooked.
    """
    links = cut_lineage(spark, edges.filter("src <> dst").select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).distinct())
    steps, n = [], links.count()
    while n:
        local, left = _contract(spark, links, span)
        steps.append(local)
        forget(spark, links)
        before, n = n, left.count()
        links, span = left, span * 16
        if n * 2 > before:
            steps.append(_hook(spark, links))
            break
    out = nodes.select("id", F.col("id").cast("long").alias("component"))
    for step in steps:
        out = out.join(_moved(step.select(F.col("id").alias("component"), F.col("root").alias("_r"))), "component", "left").select("id", F.coalesce("_r", "component").alias("component"))
    return out.select("id", F.col("component").cast(nodes.schema["id"].dataType).alias("component"))


def _settle_levels(level: np.ndarray, src: np.ndarray, dst: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The greatest levels not above those given with level[dst] <= level[src] + cost on every arc; only nodes that went down are looked at again."""
    order = np.argsort(src, kind="stable")
    src, dst, cost = src[order], dst[order], cost[order]
    first = np.searchsorted(src, np.arange(len(level) + 1))
    level, front = level.copy(), np.arange(len(level))
    while len(front):
        n = first[front + 1] - first[front]
        arc = np.repeat(first[front] - np.cumsum(n) + n, n) + np.arange(n.sum())
        to, offer = dst[arc], np.repeat(level[front], n) + cost[arc]
        lower = offer < level[to]
        np.minimum.at(level, to[lower], offer[lower])
        front = np.unique(to[lower])
    return level


def _solve_block(nodes: pa.Table, arcs: pa.Table) -> pa.Table:
    """(block, id, level, moved) of a block's nodes under its own arcs; ``was`` is the level that other blocks know."""
    new = _settled(nodes, arcs)
    was = nodes.take(pa.array(np.argsort(nodes.column("id").to_numpy()))).column("was").to_numpy(zero_copy_only=False)
    return new.append_column("moved", pa.array(new.column("level").to_numpy() < was))


#: Border nodes of a block up to which it is reduced to the costs between them.
PORTS = 2048


def _settled(nodes: pa.Table, arcs: pa.Table) -> pa.Table:
    """(block, id, level) of a block's nodes under its own arcs; arcs from or to no node say nothing."""
    order = np.argsort(nodes.column("id").to_numpy())
    nodes = nodes.take(pa.array(order))
    ids, level = nodes.column("id").to_numpy(), nodes.column("level").to_numpy()
    if len(ids):
        level = _settle_levels(level, *_own_arcs(ids, arcs, level.dtype))
    return pa.table({"block": nodes.column("block"), "id": nodes.column("id"), "level": pa.array(level)})


def _own_arcs(ids: np.ndarray, arcs: pa.Table, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arcs between the sorted ids as places among them, and their costs."""
    ends = [arcs.column(c).to_numpy() for c in ("src", "dst")]
    at = [np.minimum(np.searchsorted(ids, e), len(ids) - 1) for e in ends]
    known = (ids[at[0]] == ends[0]) & (ids[at[1]] == ends[1])
    return at[0][known], at[1][known], arcs.column("cost").to_numpy()[known].astype(kind)


def _reducer(low):
    """A kernel that settles a block and gives the costs of the ways through it.

    ``low``: the least level of all nodes. A way is followed only as long as even that level
    could lower a node along it: beyond, it changes nothing.
    """

    def run(nodes: pa.Table, arcs: pa.Table) -> pa.Table:
        order = np.argsort(nodes.column("id").to_numpy())
        nodes = nodes.take(pa.array(order))
        ids, level = nodes.column("id").to_numpy(), nodes.column("level").to_numpy()
        enter, leave = (nodes.column(c).to_numpy(zero_copy_only=False) for c in ("enter", "leave"))
        found: list[tuple[np.ndarray, ...]] = []
        if len(ids):
            src, dst, cost = _own_arcs(ids, arcs, level.dtype)
            level = _settle_levels(level, src, dst, cost)
            order = np.argsort(src, kind="stable")
            src, dst, cost = src[order], dst[order], cost[order]
            first = np.searchsorted(src, np.arange(len(ids) + 1))
            far = np.array(np.inf if level.dtype.kind == "f" else np.iinfo(level.dtype).max // 2, level.dtype)
            best = np.full(len(ids), far)
            for e in np.flatnonzero(enter & (level > low)):
                best[e] = 0
                front, seen = np.array([e]), [np.array([e])]
                while len(front):
                    n = first[front + 1] - first[front]
                    arc = np.repeat(first[front] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    to, way = dst[arc], np.repeat(best[front], n) + cost[arc]
                    on = (way < best[to]) & (way + low < level[to])
                    np.minimum.at(best, to[on], way[on])
                    front = np.unique(to[on])
                    seen.append(front)
                met = np.unique(np.concatenate(seen))
                out = met[leave[met] & (met != e)]
                found.append((np.full(len(out), ids[e]), ids[out], best[out]))
                best[met] = far
        a, b, c = (np.concatenate(x) for x in zip(*found)) if found else (ids[:0], ids[:0], level[:0])
        block = np.full(len(a), nodes.column("block")[0].as_py() if len(ids) else 0)
        none = np.zeros(len(ids), level.dtype)
        return pa.table({
            "block": np.concatenate([nodes.column("block").to_numpy(), block]), "id": np.concatenate([ids, a]), "level": np.concatenate([level, c]),
            "port": np.concatenate([enter | leave, np.zeros(len(a), bool)]), "dst": pa.array(np.concatenate([none.astype(ids.dtype), b]), mask=np.concatenate([np.ones(len(ids), bool), np.zeros(len(a), bool)])),
        })

    return run


def relax(spark: SparkSession, levels: DataFrame, arcs: DataFrame, rounds: int = 5000, span: int = SPAN, width: int | None = None) -> DataFrame:
    """(id, level) lowered until level[dst] <= level[src] + cost on every arc of ``arcs(src, dst, cost)`` between given nodes.

    Costs must not be negative. Blocks are ranges of ``span`` ids, or with ``width`` (ids are
    z * width + x) square tiles of as many cells. Every block is settled and reduced to the costs
    of the ways between its border nodes; the graph of the borders is solved in the same way with
    blocks 16 times as large, and one pass puts its levels back into the blocks that they lower.
    Where blocks have very many border nodes (ids that say nothing about place), levels that
    went down cross the borders round by round instead.
    """
    kind = levels.schema["level"].dataType.simpleString()
    if arcs.schema["cost"].dataType.simpleString() in ("float", "double") or kind.startswith("decimal"):
        kind = "double"
    nodes = levels.select("id", F.col("level").cast(kind).alias("level"))
    every = arcs.filter("src <> dst").groupBy("src", "dst").agg(F.min("cost").alias("cost"))
    return _relax(spark, nodes, every, kind, _keys(span, width), 0, rounds, span)


def _keys(span: int, width: int | None):
    """The block of an id, as a column; blocks of the next step up are 16 times as large."""
    if width is None:
        return lambda c, up: F.floor(F.col(c) / (span * 16**up))
    side = max(int(span**0.5), 1)
    z = lambda c: F.floor(F.col(c) / width)
    return lambda c, up: F.floor(z(c) / (side * 4**up)) * (1 << 31) + F.floor((F.col(c) - z(c) * width) / (side * 4**up))


def _relax(spark: SparkSession, levels: DataFrame, arcs: DataFrame, kind: str, key, up: int, rounds: int, span: int) -> DataFrame:
    nodes = levels.select(key("id", up).alias("block"), "id", "level")
    found = nodes.agg(F.min("block"), F.max("block"), F.min("level"), F.count(F.lit(1))).first()
    if found[3] == 0:
        return levels
    id_kind = levels.schema["id"].dataType.simpleString()
    shape = f"block long, id {id_kind}, level {kind}"
    solve = lambda n, a: n.groupBy("block").cogroup(a.groupBy("block")).applyInArrow(_settled, shape)
    placed = arcs.select(key("dst", up).alias("block"), key("src", up).alias("_from"), "src", "dst", "cost")
    if found[0] == found[1] or found[3] <= span:
        zero = F.lit(0).cast("long")
        return solve(nodes.withColumn("block", zero), placed.withColumn("block", zero)).select("id", "level")
    placed = cut_lineage(spark, placed)
    inner, cross = placed.filter("block = _from").drop("_from"), placed.filter("block <> _from")
    ports = cross.select("block", F.col("dst").alias("id"), F.lit(True).alias("enter"), F.lit(False).alias("leave"))
    ports = ports.unionAll(cross.select("_from", "src", F.lit(False), F.lit(True))).groupBy("block", "id").agg(F.max("enter").alias("enter"), F.max("leave").alias("leave"))
    ports = cut_lineage(spark, ports)
    most, blocks = ports.groupBy("block").count().agg(F.max("count"), F.count(F.lit(1))).first()
    if most is None:
        forget(spark, ports)
        return solve(nodes, inner).select("id", "level")
    if most > PORTS:
        forget(spark, ports)
        return _by_rounds(spark, nodes, placed, kind, rounds)
    flagged = nodes.join(_moved(ports), ["block", "id"], "left").select("block", "id", "level", F.coalesce("enter", F.lit(False)).alias("enter"), F.coalesce("leave", F.lit(False)).alias("leave"))
    local = cut_lineage(spark, flagged.groupBy("block").cogroup(inner.groupBy("block")).applyInArrow(_reducer(found[2]), f"{shape}, port boolean, dst {id_kind}"))
    settled = local.filter("dst IS NULL").select("block", "id", "level", "port")
    border = settled.filter("port").select("id", "level")
    through = local.filter("dst IS NOT NULL").select(F.col("id").alias("src"), "dst", F.col("level").alias("cost"))
    graph = through.unionByName(cross.select("src", "dst", F.col("cost").cast(kind).alias("cost")))
    wide, larger = border.groupBy(key("id", up + 1).alias("b")).count().agg(F.max("count"), F.count(F.lit(1))).first()
    if (wide or 0) <= span and larger < blocks:
        final = _relax(spark, border, graph, kind, key, up + 1, rounds, span)
    else:
        again = graph.select(key("dst", up).alias("block"), key("src", up).alias("_from"), "src", "dst", "cost")
        final = _by_rounds(spark, border.select(key("id", up).alias("block"), "id", "level"), cut_lineage(spark, again), kind, rounds)
    # what the border learned goes back into the blocks that it lowers
    lower = settled.filter("port").join(_moved(final.withColumnRenamed("level", "_l")), "id").filter("_l < level").select("block", "id", "_l")
    lower = cut_lineage(spark, lower)
    touched = lower.select("block").distinct()
    back = settled.join(_moved(touched), "block", "left_semi").join(_moved(lower), ["block", "id"], "left").select("block", "id", F.least("level", "_l").alias("level"))
    new = cut_lineage(spark, solve(back, inner.join(_moved(touched), "block", "left_semi")))
    rest = settled.join(_moved(touched), "block", "left_anti")
    forget(spark, ports)
    return rest.select("id", "level").unionByName(new.select("id", "level"))


def _by_rounds(spark: SparkSession, start: DataFrame, every: DataFrame, kind: str, rounds: int) -> DataFrame:
    """(id, level) of start(block, id, level) under every(block, _from, src, dst, cost); rounds end when no level that went down offers a lower one to another block."""
    inner = every.filter("block = _from").select("block", "src", "dst", "cost")
    cross = every.filter("block <> _from").select("block", "src", "dst", "cost")
    shape = f"block long, id {start.schema['id'].dataType.simpleString()}, level {kind}, moved boolean"
    solved = lambda nodes, own: cut_lineage(spark, nodes.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_solve_block, shape))
    now = moved = solved(start.withColumn("was", F.col("level") + F.lit(1).cast(kind)), inner)
    for _ in range(rounds):
        offer = cross.join(_moved(moved.filter("moved").select(F.col("id").alias("src"), "level")), "src").groupBy("block", F.col("dst").alias("id")).agg(F.min(F.col("level") + F.col("cost")).cast(kind).alias("_o"))
        offer = cut_lineage(spark, offer.join(_moved(now.select("block", "id", "level")), ["block", "id"]).filter("_o < level").select("block", "id", "_o"))
        if offer.isEmpty():
            forget(spark, every, offer, *([moved] if moved is not now else []))
            return now.select("id", "level")
        reached = offer.select("block").distinct()
        nodes = now.join(_moved(reached), "block", "left_semi").join(_moved(offer), ["block", "id"], "left")
        fresh = solved(nodes.select("block", "id", F.least("level", "_o").alias("level"), F.col("level").alias("was")), inner.join(_moved(reached), "block", "left_semi"))
        later = cut_lineage(spark, now.join(_moved(reached), "block", "left_anti").unionByName(fresh))
        forget(spark, offer, now, *([moved] if moved is not now else []))
        now, moved = later, fresh
    raise RuntimeError("relax: no fixpoint")


def step_limit(spark: SparkSession, levels: DataFrame, arcs: DataFrame, span: int = SPAN, width: int | None = None) -> DataFrame:
    """level[src] <= level[dst] + 1 on every arc: a river steps down by at most one."""
    return relax(spark, levels, arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("cost")), span=span, width=width)


def propagate_down(spark: SparkSession, levels: DataFrame, arcs: DataFrame, span: int = SPAN, width: int | None = None) -> DataFrame:
    """level[dst] <= level[src]: a cell is never above what flows into it."""
    return relax(spark, levels, arcs.select("src", "dst", F.lit(0).alias("cost")), span=span, width=width)


def level_surface(spark: SparkSession, cells: DataFrame, span: int = SPAN, width: int | None = None) -> DataFrame:
    """(id, level) with steps of at most one between 8-neighbours among ``cells(id, z, x, level)``."""
    return relax(spark, cells, neighbour_edges(cells).select("src", "dst", F.lit(1).alias("cost")), span=span, width=width)


def lowered(spark: SparkSession, levels: DataFrame, ways: DataFrame, span: int = SPAN, width: int | None = None) -> DataFrame:
    """(id, level): along each of ``ways(way, ord, cell)`` the running least, taken over all ways to a fixpoint. A running least is an arc of cost 0 from each cell to the next."""
    nxt = ways.select(F.col("cell").alias("src"), F.lead("cell").over(W.partitionBy("way").orderBy("ord")).alias("dst")).filter("dst IS NOT NULL")
    return propagate_down(spark, levels.select("id", "level"), nxt, span, width)


def lower_downstream(spark: SparkSession, levels: DataFrame, ways: DataFrame, span: int = SPAN, width: int | None = None) -> tuple[DataFrame, bool]:
    """``lowered``, and whether anything moved."""
    low = cut_lineage(spark, lowered(spark, levels, ways, span, width))
    before = levels.select("id", F.col("level").alias("_was"))
    return low, not low.join(_moved(before), "id").filter("level < _was").isEmpty()


def flatten_sections(spark: SparkSession, levels: DataFrame, sections: DataFrame) -> tuple[DataFrame, bool]:
    """All cells of one of ``sections(id, center)`` take its least level."""
    s = sections.join(_moved(levels), "id")
    low = s.groupBy("center").agg(F.min("level").alias("m"))
    new = cut_lineage(spark, levels.join(_moved(sections), "id", "left").join(_moved(low), "center", "left").select("id", F.least("level", F.coalesce("m", "level")).alias("level"), (F.col("m") < F.col("level")).alias("moved")))
    return new.select("id", "level"), not new.filter("moved").isEmpty()


@tidied
def settle(spark: SparkSession, cells: DataFrame, sections: DataFrame, ways: DataFrame, rounds: int = 200, span: int = SPAN, width: int | None = None) -> DataFrame:
    """Flatten, relax, lower downstream, in this order, until neither flattening nor lowering moved anything.

    The order and the test are part of the result: the last relaxation may leave a section uneven.
    """
    place = cells.select("id", "z", "x")
    now = cells.select("id", "level")
    for _ in range(rounds):
        now, flat = flatten_sections(spark, now, sections)
        now = cut_lineage(spark, level_surface(spark, place.join(_moved(now), "id"), span, width))
        now, down = lower_downstream(spark, now, ways, span, width)
        if not flat and not down:
            return now
    raise RuntimeError("settle: no fixpoint")


def choose_outlets(nodes: DataFrame) -> DataFrame:
    """Outlets of ``nodes(id, component, sample, lake, coast, edge)``: all lake cells of a component, else the lowest coast cell, else edge cell, else cell."""
    kind = F.when(F.col("lake"), 0).when(F.col("coast"), 1).when(F.col("edge"), 2).otherwise(3)
    n = nodes.withColumn("_k", kind)
    best = n.groupBy("component").agg(F.min("_k").alias("_b"))
    n = n.join(_moved(best), "component").filter("_k = _b")
    lakes = n.filter("_b = 0").select("id", "component")
    one = n.filter("_b > 0").groupBy("component").agg(F.min(F.struct("sample", "id")).alias("_m")).select("_m.id", "component")
    return lakes.unionByName(one)


def _along(op: np.ufunc, x: np.ndarray, first: np.ndarray, n: np.ndarray) -> None:
    """``op.accumulate`` in place over each stretch ``first[k] .. first[k] + n[k]``: place by place along all of them, the rest of long ones by itself."""
    order, short = np.argsort(-n, kind="stable"), 64
    for i in range(1, min(n.max(initial=0), short)):
        at = first[order[: np.count_nonzero(n > i)]] + i
        x[at] = op(x[at - 1], x[at])
    for k in np.flatnonzero(n > short):
        rest = slice(first[k] + short - 1, first[k] + n[k])
        x[rest] = op.accumulate(x[rest])


def _isotonic(sample: np.ndarray, n: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Least-squares fits that never fall upstream, of paths laid end to end: ``n`` samples each, from its end up, and ``below``, the level of the cell that it ends at.

    Counted from the outlet up, the fit is the slope of the greatest convex curve below the
    running sums. Its corners are found by splitting chords where the sums lie farthest below,
    for the chords of all paths at once.
    """
    path = np.repeat(np.arange(len(n)), n)
    a = np.cumsum(n) - n + 2 * np.arange(len(n))  # running sums of a path: 0, below, below and its first sample, ...
    own = np.arange(len(sample)) + 2 * path + 1  # the sum before each sample
    total = np.zeros(len(sample) + 2 * len(n))
    total[a + 1], total[own + 1] = below, sample
    _along(np.add, total, a, n + 2)
    corner = np.zeros(len(total), bool)
    b = a + n + 1
    corner[a] = corner[b] = True
    while len(a):
        a, b = a[b - a > 1], b[b - a > 1]
        m = b - a - 1
        chord = np.repeat(np.arange(len(a)), m)
        at = np.arange(len(chord)) - (np.cumsum(m) - m)[chord] + a[chord] + 1
        low = ((total[b] - total[a]) / (b - a))[chord] * (at - a[chord]) + total[a][chord] - total[at]
        most = np.maximum.reduceat(low, np.cumsum(m) - m) if len(a) else low
        split = most > 1e-9
        hit = np.flatnonzero(split[chord] & (low == most[chord]))
        k = at[hit[np.unique(chord[hit], return_index=True)[1]]]
        corner[k] = True
        a, b = np.concatenate([a[split], k]), np.concatenate([k, b[split]])
    ends = np.flatnonzero(corner)
    return np.maximum(np.repeat(np.diff(total[ends]) / np.diff(ends), np.diff(ends))[own], below[path])


def isotonic(values: np.ndarray, outlet: float) -> np.ndarray:
    """Least-squares fit that never rises downstream and ends at the outlet: ``values`` from source to outlet."""
    up = np.asarray(values, dtype=float)[::-1]
    return _isotonic(up, np.array([len(up)]), np.array([float(outlet)]))[::-1]


@tidied
def scc(spark: SparkSession, edges: DataFrame, span: int = SPAN, rounds: int = 1000) -> DataFrame:
    """(id, scc): for every node of the directed ``edges(src, dst)`` the least node of its strong component.

    Nodes without an arc in or out among those left are components by themselves and go
    first. Then every node learns the least node that reaches it; of the nodes of one such
    root those that reach it too are its component. What is left goes on, until no arc is.
    """
    arcs = cut_lineage(spark, edges.filter("src <> dst").select("src", "dst").distinct())
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    done: list[DataFrame] = []

    def drop(arcs: DataFrame, gone: DataFrame) -> DataFrame:
        g = gone.select("id")
        return arcs.join(_moved(g.withColumnRenamed("id", "src")), "src", "left_anti").join(_moved(g.withColumnRenamed("id", "dst")), "dst", "left_anti").select("src", "dst")

    n = arcs.count()
    for _ in range(rounds):
        if not n:
            break
        # arcs between nodes that something enters and something leaves
        ends = arcs.select("src").distinct().join(_moved(arcs.select(F.col("dst").alias("src")).distinct()), "src", "left_semi")
        inner = arcs.join(_moved(ends), "src", "left_semi").join(_moved(ends.withColumnRenamed("src", "dst")), "dst", "left_semi").select("src", "dst")
        inner = cut_lineage(spark, inner)
        m = inner.count()
        if m < n:
            arcs, n = inner, m
            continue
        zero = lambda a, x, y: a.select(F.col(x).alias("src"), F.col(y).alias("dst"), F.lit(0).alias("cost"))
        ids = arcs.select(F.col("src").cast("long").alias("id")).distinct()
        root = cut_lineage(spark, relax(spark, ids.withColumn("level", F.col("id")), zero(arcs, "src", "dst"), span=span)).withColumnRenamed("level", "root")
        of = lambda c: root.select(F.col("id").alias(c), F.col("root").alias(f"_{c}"))
        within = arcs.join(_moved(of("src")), "src").join(_moved(of("dst")), "dst").filter("_src = _dst")
        back = relax(spark, root.select("id", (F.col("id") != F.col("root")).cast("int").alias("level")), zero(within, "dst", "src"), span=span)
        found = cut_lineage(spark, back.filter("level = 0").join(_moved(root), "id").select("id", F.col("root").alias("scc")))
        done.append(found)
        arcs = cut_lineage(spark, drop(arcs, found))
        n = arcs.count()
    else:
        raise RuntimeError("scc: arcs are left")
    kind = edges.schema["src"].dataType
    out = nodes.withColumn("scc", F.col("id"))
    for found in done:
        out = out.join(_moved(found.select("id", F.col("scc").cast(kind).alias("_s"))), "id", "left").select("id", F.coalesce("_s", "scc").alias("scc"))
    return out


@tidied
def shortest_paths(spark: SparkSession, nodes: DataFrame, edges: DataFrame, seeds: DataFrame, span: int = SPAN) -> DataFrame:
    """(id, distance, parent) from the nearest of ``seeds(id)`` along ``edges(src, dst, cost)``; infinity where none is reached.

    Distances are a fixpoint, settled block by block. Of neighbours that give a node its
    distance, its parent is the one nearest to a seed, the least on ties. Where blocks meet,
    costs are summed in another order, and no neighbour may give the distance to the last
    bit: then the parent is the one of the least way.
    """
    start = nodes.select(F.col("id").cast("long").alias("id")).join(_moved(seeds.select(F.col("id").cast("long").alias("id"), F.lit(0.0).alias("level")).distinct()), "id", "left")
    start = cut_lineage(spark, start.select("id", F.coalesce("level", F.lit(float("inf"))).alias("level")))
    arcs = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("cost").cast("double").alias("cost"))
    dist = cut_lineage(spark, relax(spark, start, arcs, span=span))
    a, b = (dist.select(F.col("id").alias(c), F.col("level").alias(f"_{c}")) for c in ("src", "dst"))
    offer = F.col("_src") + F.col("cost")
    exact = offer == F.col("_dst")
    via = arcs.join(_moved(a), "src").join(_moved(b), "dst").filter((exact | (F.col("_src") < F.col("_dst"))) & (F.col("_dst") > 0) & (F.col("_dst") < float("inf")))
    parent = via.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct(F.when(exact, F.lit(-1.0)).otherwise(offer).alias("_o"), "_src", "src"))["src"].alias("parent"))
    return cut_lineage(spark, dist.join(_moved(parent), "id", "left").select("id", F.col("level").alias("distance"), F.coalesce("parent", F.lit(-1).cast("long")).alias("parent")))


@tidied
def path_starts(spark: SparkSession, tree: DataFrame, span: int = SPAN) -> DataFrame:
    """(id, start): of each node of ``tree(id, distance, parent)`` that has a parent, the farthest node whose way leads through it (the greatest id on ties): nodes of one start are a path."""
    t = tree.filter("parent >= 0")
    up = t.select(F.col("id").alias("src"), F.col("parent").alias("dst"), F.lit(0).alias("cost"))
    far = cut_lineage(spark, relax(spark, t.select("id", (-F.col("distance")).alias("level")), up, span=span))
    on = t.select("id", "distance").join(_moved(far), "id")
    same = up.join(_moved(far.select(F.col("id").alias("src"), F.col("level").alias("_s"))), "src").join(_moved(far.select(F.col("id").alias("dst"), F.col("level").alias("_d"))), "dst").filter("_s = _d")
    none = F.lit(2**62).cast("long")
    own = on.select("id", F.when(F.col("level") == -F.col("distance"), -F.col("id")).otherwise(none).alias("level"))
    return relax(spark, cut_lineage(spark, own), same.select("src", "dst", "cost"), span=span).select("id", (-F.col("level")).alias("start"))


def _profiles(t: pa.Table) -> pa.RecordBatch:
    """Whole paths, their cells in order from the end up: (start, id, sample, below: level of the cell that it ends at) -> levels."""
    start, sample, below = (t.column(c).to_numpy() for c in ("start", "sample", "below"))
    first = np.flatnonzero(np.r_[True, start[1:] != start[:-1]])
    n = np.diff(np.r_[first, len(start)])
    fit = _isotonic(sample, n, below[first])
    # no cell more than one above the next one downstream; the cell that a path ends at goes first
    path = np.repeat(np.arange(len(n)), n)
    own = np.arange(len(fit)) + path + 1
    low, step = np.empty(len(fit) + len(n)), np.zeros(len(fit) + len(n), int)
    low[first + np.arange(len(n))] = below[first]
    step[own] = np.arange(len(fit)) - first[path] + 1
    low[own] = fit - step[own]
    _along(np.minimum, low, first + np.arange(len(n)), n + 1)
    return pa.RecordBatch.from_pydict({"id": t.column("id").combine_chunks(), "value": pa.array((low + step)[own])})


def _fit(batches):
    """Levels of sorted paths, batch by batch; the last path of a batch waits for the rest of its cells."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        start = batch.column("start").to_numpy()
        last = int(np.searchsorted(start, start[-1]))
        if last or (held and held[-1].column("start")[0].as_py() != start[-1]):
            done = [*held, batch.slice(0, last)]
            if sum(b.num_rows for b in done):
                yield _profiles(pa.Table.from_batches(done))
            held = []
        held.append(batch.slice(last))
    if held:
        yield _profiles(pa.Table.from_batches(held))


@tidied
def fit_paths(spark: SparkSession, nodes: DataFrame, edges: DataFrame, seeds: DataFrame, span: int = SPAN, rounds: int = 10_000) -> DataFrame:
    """(id, distance, parent, level): shortest paths from the outlets, then isotonic profiles along the longest paths first.

    nodes(id, sample), edges(src, dst, cost), seeds(id). A path stops where it meets a longer
    one and shares its level; then no level exceeds its downstream neighbour's by more than
    one. Of equal distances the greater id goes first. Paths that end at a level that is
    known are fitted together, each by itself, so a round is a generation of tributaries.
    """
    tree = shortest_paths(spark, nodes, edges, seeds, span)
    sample = nodes.select(F.col("id").cast("long").alias("id"), F.col("sample").cast("double").alias("sample"))
    cells = tree.filter("parent >= 0").join(_moved(path_starts(spark, tree, span)), "id").join(_moved(sample), "id")
    left = cut_lineage(spark, cells.select("start", "id", "sample", "distance", F.min_by("parent", "distance").over(W.partitionBy("start")).alias("end")))
    fresh = known = cut_lineage(spark, tree.filter("distance = 0").join(_moved(sample), "id").select("id", F.col("sample").alias("value")))
    for _ in range(rounds):
        below = fresh.select(F.col("id").alias("end"), F.col("value").alias("below"))
        # whole paths in order, as many to a batch as it holds: most are short
        ready = left.join(_moved(below), "end").repartition("start").sortWithinPartitions("start", "distance").select("start", "id", "sample", "below")
        fitted = cut_lineage(spark, ready.mapInArrow(_fit, "id long, value double"))
        if fitted.isEmpty():
            break
        # one table of all generations, so that the plan does not grow with them
        fitted.write.mode("append").parquet(known.written_at)
        rest = cut_lineage(spark, left.join(_moved(below), "end", "left_anti"))
        forget(spark, left, *([fresh] if fresh is not known else []))
        left, fresh = rest, fitted
    else:
        raise RuntimeError("fit_paths: paths are left")
    known = spark.read.schema(known.schema).parquet(known.written_at)
    out = tree.join(_moved(sample), "id").join(_moved(known), "id", "left")
    return out.select("id", "distance", "parent", F.rint(F.least(F.greatest(F.coalesce("value", "sample"), F.lit(1.0)), F.lit(255.0))).cast("int").alias("level"))


def nearest_center(cells: DataFrame, centers: DataFrame, radius: int) -> DataFrame:
    """(id, center, d2): nearest of ``centers(id, z, x)`` within a radius of ``cells(id, z, x)``; ties by (z, x)."""
    s = around(centers.select(F.col("id").alias("center"), "z", "x"), ring(radius)).select(F.col("nz").alias("_z"), F.col("nx").alias("_x"), F.struct((F.col("dz") * F.col("dz") + F.col("dx") * F.col("dx")).alias("d2"), "z", "x", "center").alias("_m"))
    j = cells.select("id", "z", "x").join(s, (F.col("z") == F.col("_z")) & (F.col("x") == F.col("_x")))
    return j.groupBy("id").agg(F.min("_m").alias("_m")).select("id", "_m.center", "_m.d2")
