"""SimHash near-duplicates by a self-join of a binary trie.

Fingerprints of 64 bits link at three or fewer differing bits. Two such
fingerprints agree in at least one of four blocks of 16 bits. So there are four
tries, each with another block on top: the walk starts at the nodes of equal top
blocks and goes down pairs of nodes together, adding up the bits in which they
differ, and leaves a pair once more than three do. Nodes of many fingerprints are
cut further: their parts are dealt out as pairs of deeper nodes whose own bits
differ in at most three places. Pairs of nodes that lie in one class already are
left out too, so a dense group costs no more than what first connects it.

Each task returns its classes as links to the least member; the classes over all
tasks are the connected components. Exact copies share a fingerprint and take part
once. No pair is dropped and no group is capped.

Null and empty texts have fingerprint 0, which links like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspark.llm.common import forget, made, named, partitions, written
from terraspark.llm.components import connected_components

BITS = 3
SEED = 42
#: Fingerprints under a node above which it is cut.
NODE = 20_000
#: Pairs of nodes with at most so many pairs of fingerprints are compared at once.
LEAF = 64
CHUNK = 400_000


def shingle_hashes(text: str, words: int = 3) -> np.ndarray:
    """XXH64 of a text's shingles, repeats included; words are split at ASCII white space, A-Z in lower case. Fewer words make one shingle, none make none."""
    import xxhash

    w = text.encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in parts), dtype="<u8")


def majority(h: np.ndarray) -> int:
    """Bit by bit, whether over half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = 3) -> int:
    return majority(shingle_hashes(text, words))


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(v.as_py() or "") for v in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, fp long")


class Classes:
    """Classes of 0..n-1 under found pairs; every member's label is the least of its class."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def classes_of(group: np.ndarray, rest: np.ndarray, full: np.ndarray, cross: np.ndarray, side: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Labels over rows in which ``group`` ascends and, within it, ``side`` and then ``rest``.

    Rows of a group are compared with each other, or (cross) those of side 0 with
    those of side 1. ``rest``: the 48 bits below the block on top.
    """
    n = len(rest)
    found = Classes(n)
    if n < 2:
        return found.label
    key = group.astype(np.uint64) << np.uint64(49) | side.astype(np.uint64) << np.uint64(48) | rest
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], n]
    x = cross[starts]
    middle = np.searchsorted(key, (group[starts].astype(np.uint64) << np.uint64(49)) | np.uint64(1 << 48))
    a = np.where(x, middle, ends)
    first = np.stack([starts, a, np.where(x, middle, starts), ends, np.zeros_like(starts)], axis=1)
    stack = [(47, part) for part in np.array_split(first, max(1, len(first) // CHUNK))]
    one = np.uint64(1)
    while stack:
        bit, p = stack.pop()
        p = p[(p[:, 1] > p[:, 0]) & (p[:, 3] > p[:, 2])]
        same = (p[:, 0] == p[:, 2]) & (p[:, 1] == p[:, 3])
        # a node with itself needs two fingerprints; a pair within one class needs no look
        step = np.r_[0, np.cumsum(found.label[1:] != found.label[:-1])]
        within = (step[p[:, 1] - 1] == step[p[:, 0]]) & (step[p[:, 3] - 1] == step[p[:, 2]]) & (found.label[p[:, 0]] == found.label[p[:, 2]])
        keep = ~within & ~(same & (p[:, 1] - p[:, 0] < 2))
        p, same = p[keep], same[keep]
        if not len(p):
            continue
        size = (p[:, 1] - p[:, 0]) * (p[:, 3] - p[:, 2])
        small = (size <= LEAF) | (bit < 0)
        if small.any():
            q, count = p[small], size[small]
            for lo in range(0, len(q), CHUNK // 8):
                part, c = q[lo : lo + CHUNK // 8], count[lo : lo + CHUNK // 8]
                at = np.repeat(np.arange(len(part)), c)
                k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                width = part[at, 3] - part[at, 2]
                i, j = part[at, 0] + k // width, part[at, 2] + k % width
                near = (i != j) & (np.bitwise_count(full[i] ^ full[j]) <= bits)
                found.add(i[near], j[near])
        p, same = p[~small], same[~small]
        if not len(p):
            continue
        if len(p) > CHUNK:
            stack += [(bit, part) for part in np.array_split(p, 2)]
            continue
        mask = np.uint64(((1 << 64) - 1) ^ ((1 << (bit + 1)) - 1))
        cut = [np.searchsorted(key, key[p[:, s]] & mask | one << np.uint64(bit)) for s in (0, 2)]
        cut = [np.clip(c, p[:, s], p[:, s + 1]) for c, s in zip(cut, (0, 2), strict=True)]
        (al, ah, bl, bh, d), (ac, bc) = p.T, cut
        parts = [np.stack([al, ac, bl, bc, d], 1), np.stack([ac, ah, bc, bh, d], 1), np.stack([al, ac, bc, bh, d + 1], 1), np.stack([ac, ah, bl, bc, d + 1], 1)[~same]]
        nxt = np.concatenate(parts)
        stack.append((bit - 1, nxt[nxt[:, 4] <= bits]))
    return found.label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tasks of a partition -> links (a: least of the class, b: member)."""
    t = pa.Table.from_batches([pa.RecordBatch.from_arrays(x.columns, schema=TASK) for x in batches], schema=TASK)
    if not t.num_rows:
        return
    task, p, q, own, fp, rest = (t.column(c).to_numpy() for c in ("task", "p", "q", "own", "fp", "rest"))
    side = (own == q) & (p != q)
    order = np.lexsort((rest, side, q, p, task))
    task, p, q, side, fp, rest = (v[order] for v in (task, p, q, side, fp, rest))
    new = np.r_[True, (task[1:] != task[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
    group = np.cumsum(new) - 1
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    # 15 bits of the key are for the group
    bounds = np.searchsorted(group, np.arange(0, group[-1] + 1 + (1 << 15), 1 << 15))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo < 2:
            continue
        s = slice(lo, hi)
        label = classes_of(group[s] - group[lo], rest[s].astype(np.uint64), fp[s].view(np.uint64), (p != q)[s], side[s])
        member = np.flatnonzero(label != np.arange(len(label)))
        a.append(fp[s][label[member]])
        b.append(fp[s][member])
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


TASK = pa.schema([("task", pa.int32()), ("p", pa.int32()), ("q", pa.int32()), ("own", pa.int32()), ("fp", pa.int64()), ("rest", pa.int64())])


def masks(depth: int, bits: int = BITS) -> list[int]:
    """Numbers of ``depth`` bits with at most ``bits`` ones."""
    from itertools import combinations

    return [sum(1 << i for i in c) for k in range(min(bits, depth) + 1) for c in combinations(range(depth), k)]


def trie_links(spark: SparkSession, fps: DataFrame, node: int = NODE) -> DataFrame:
    """Links (a, b) that connect all of ``fps(fp long, distinct)`` within three bits of each other."""
    block = lambda k: F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)
    # the other three blocks, those above first
    rests = []
    for k in range(4):
        others = [j for j in (3, 2, 1, 0) if j != k]
        rests.append(F.shiftleft(block(others[0]), 32).bitwiseOR(F.shiftleft(block(others[1]), 16)).bitwiseOR(block(others[2])))
    tries = F.explode(F.array(*(F.struct((block(k) + F.lit(k << 16)).cast("int").alias("task"), rests[k].alias("rest")) for k in range(4))))
    rows = fps.select("fp", tries.alias("_x")).select("fp", "_x.task", "_x.rest")
    # at most 4 x 65,536 top nodes; only those above ``node`` are listed, each with the depth at which it is cut
    hot = rows.groupBy("task").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > node)
    hot = hot.select("task", F.least(F.lit(12), F.ceil(F.log2(F.col("n") / node)) + 2).cast("int").alias("depth"))
    rows = rows.join(F.broadcast(hot), "task", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    rows = rows.withColumn("own", F.expr("CAST(shiftrightunsigned(rest, 48 - depth) AS INT)"))
    by_depth = F.array(*(F.array(*(F.lit(m) for m in masks(d))) for d in range(13)))
    near = rows.filter("depth > 0").withColumn("mask", F.explode(F.get(by_depth, F.col("depth")))).withColumn("other", F.col("own").bitwiseXOR(F.col("mask")))
    dealt = rows.filter("depth = 0").select("task", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("own"), "fp", "rest").unionByName(near.select("task", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "fp", "rest"))
    return dealt.repartition(partitions(spark), "task", "p", "q").mapInArrow(_links, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component: least id that links reach, itself included) for every row.

    Null ids take part in linking; a class of null ids alone has a null component.
    """
    mark = made()
    fps = written(spark, with_fingerprint(docs, id_col, text_col), "fingerprints")
    unique = written(spark, fps.groupBy("fp").agg(F.min(id_col).alias("least")), "unique")
    roots = connected_components(spark, trie_links(spark, unique.select("fp")))
    member = unique.join(roots, unique["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = written(spark, member, "members")
    forget(spark, named(made(mark), "unique", "links", "joined"))
    component = member.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = member.join(component, "root").select("fp", "component")
    return fps.join(by_fp, "fp").select(id_col, "fp", "component")
