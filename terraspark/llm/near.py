"""Near duplicates at a given similarity of their word shingles, by tries of SimHash fingerprints.

Three bits of a fingerprint find copies with hardly a change. Texts that share four
fifths of their shingles of five words differ in some 4 to 18 of 64 bits; a trie over
all texts would have to try nearly every pair for that. So texts are first dealt out:
each goes to the parts of its least shingle under four orders of shingles. Two texts
of similarity s share each of these with probability s, so at 0.8 one pair in 600 has
no part in common. Within a part the trie of its fingerprints is joined with itself:
nodes are walked in pairs, differing bits added up, and a pair of nodes is left once
more than ``BITS`` differ, or once all below them are in one class. What is left at
the bottom is checked: by all shingles of texts with at most ``SKETCH`` of them, by
the least SKETCH hashes of both otherwise.

Texts of the same set of shingles take part once. Parts of many texts are cut, and
every two pieces meet in a task. No part, pair or text is capped. Texts without words
are alike to each other only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspark.llm.common import forget, made, partitions, written
from terraspark.llm.components import connected_components
from terraspark.llm.simhash import SEED, Classes, majority, shingle_hashes

WORDS = 5
SIMILARITY = 0.8
BITS = 20
SKETCH = 256
#: Odd multipliers: one order of the shingles for each.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Texts of a part above which it is cut.
NODE = 4000
#: Pairs of nodes with at most so many pairs of texts are looked at one by one.
LEAF = 64
CHUNK = 200_000
#: Pairs whose shingles are compared together.
CHECKED = 4096


def profile(text: str, words: int = WORDS) -> tuple[int, int, list[int], bytes, int]:
    """(hash of the set of shingles, fingerprint, least shingles, sketch, distinct shingles)."""
    h = shingle_hashes(text, words)
    if not len(h):
        return 0, 0, [0], b"", 0
    fp = majority(h)
    h = np.unique(h)
    least = []
    for m in ORDERS:
        x = h * np.uint64(m)
        x ^= x >> np.uint64(29)
        least.append(int(h[x.argmin()].view(np.int64)))
    with np.errstate(over="ignore"):
        key = int((h * np.uint64(ORDERS[0]) ^ h >> np.uint64(31)).sum().view(np.int64))
    return key, fp, sorted(set(least)), np.unique(h.astype(np.uint32))[:SKETCH].tobytes(), len(h)


def with_profile(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(id, text_hash, key, fp, parts array<long>, sketch, n) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [profile(v.as_py() or "", words) for v in batch.column(2)]
            key, fp, least, sketch, n = zip(*rows, strict=True) if rows else ((),) * 5
            fp = np.array(fp, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key, pa.int64()), pa.array(fp), pa.array(least, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), pa.array(n, pa.int32())], names=[id_col, "text_hash", "key", "fp", "parts", "sketch", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, text_hash long, key long, fp long, parts array<long>, sketch binary, n int")


def similarities(i: np.ndarray, j: np.ndarray, first: np.ndarray, size: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of pairs of texts, the share of their shingles that both hold: exact if both sketches are whole, else over the least SKETCH of the two together."""
    if not len(i):
        return np.zeros(0)
    ends = np.stack([i, j], 1).ravel()
    many = size[ends]
    pair = np.repeat(np.arange(len(i)).repeat(2), many)
    at = np.repeat(first[ends] - np.cumsum(many) + many, many) + np.arange(many.sum())
    x = np.sort(pair.astype(np.uint64) << np.uint64(32) | hashes[at].astype(np.uint64))
    new = np.r_[True, x[1:] != x[:-1]]
    at = np.flatnonzero(new)
    both = np.diff(np.r_[at, len(x)]) > 1
    pair = (x[at] >> np.uint64(32)).astype(np.int64)
    start = np.searchsorted(pair, np.arange(len(i) + 1))
    rank = np.arange(len(at)) - start[pair]
    whole = (n[i] <= SKETCH) & (n[j] <= SKETCH)
    counted = whole[pair] | (rank < SKETCH)
    total = np.bincount(pair[counted], minlength=len(i))
    return np.bincount(pair[counted & both], minlength=len(i)) / np.maximum(total, 1)


def _first_set(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """In each range of fingerprints that agree above ``bit``, in order, the first that has it."""
    a, b = lo.copy(), hi.copy()
    open_ = np.flatnonzero(a < b)
    while len(open_):
        mid = (a[open_] + b[open_]) >> 1
        has = (fp[mid] >> np.uint64(bit) & np.uint64(1)).astype(bool)
        b[open_[has]] = mid[has]
        a[open_[~has]] = mid[~has] + 1
        open_ = open_[a[open_] < b[open_]]
    return a


def similar_classes(group: np.ndarray, side: np.ndarray, cross: np.ndarray, fp: np.ndarray, check, bits: int = BITS) -> np.ndarray:
    """Labels over rows in which ``group`` ascends, within it ``side``, and within that ``fp``.

    Rows of a group are compared with each other, or (cross) those of side 0 with those of
    side 1. ``check(i, j)`` says which pairs are alike.
    """
    rows = len(fp)
    found = Classes(rows)
    if rows < 2:
        return found.label
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], rows]
    middle = starts + np.add.reduceat((side == 0).astype(np.int64), starts)
    x = cross[starts]
    stack = [(63, part) for part in np.array_split(np.stack([starts, np.where(x, middle, ends), np.where(x, middle, starts), ends, np.zeros_like(starts)], 1), max(1, len(starts) // CHUNK))]
    while stack:
        bit, p = stack.pop()
        p = p[(p[:, 1] > p[:, 0]) & (p[:, 3] > p[:, 2])]
        same = (p[:, 0] == p[:, 2]) & (p[:, 1] == p[:, 3])
        # a node with itself needs two texts; what lies within one class needs no look
        step = np.r_[0, np.cumsum(found.label[1:] != found.label[:-1])]
        within = (step[p[:, 1] - 1] == step[p[:, 0]]) & (step[p[:, 3] - 1] == step[p[:, 2]]) & (found.label[p[:, 0]] == found.label[p[:, 2]])
        keep = ~within & ~(same & (p[:, 1] - p[:, 0] < 2))
        p, same = p[keep], same[keep]
        size = (p[:, 1] - p[:, 0]) * (p[:, 3] - p[:, 2])
        small = (size <= LEAF) | (bit < 0)
        q, count = p[small], size[small]
        for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(np.cumsum(count) // CHUNK)) + 1) if len(q) else []:
            r, c = q[part], count[part]
            at = np.repeat(np.arange(len(r)), c)
            k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            width = r[at, 3] - r[at, 2]
            i, j = r[at, 0] + k // width, r[at, 2] + k % width
            near = (i != j) & (np.bitwise_count(fp[i] ^ fp[j]) <= bits)
            i, j = i[near], j[near]
            twice = (j < i) & ~cross[i]  # a node with itself gives every pair two times
            i, j = i[~twice], j[~twice]
            for lo in range(0, len(i), CHECKED):
                a, b = i[lo : lo + CHECKED], j[lo : lo + CHECKED]
                apart = found.label[a] != found.label[b]
                a, b = a[apart], b[apart]
                alike = check(a, b)
                found.add(a[alike], b[alike])
        p, same = p[~small], same[~small]
        if not len(p):
            continue
        if len(p) > CHUNK:
            stack += [(bit, part) for part in np.array_split(p, 2)]
            continue
        al, ah, bl, bh, d = p.T
        ac, bc = _first_set(fp, al, ah, bit), _first_set(fp, bl, bh, bit)
        parts = [np.stack([al, ac, bl, bc, d], 1), np.stack([ac, ah, bc, bh, d], 1), np.stack([al, ac, bc, bh, d + 1], 1), np.stack([ac, ah, bl, bc, d + 1], 1)[~same]]
        nxt = np.concatenate(parts)
        stack.append((bit - 1, nxt[nxt[:, 4] <= bits]))
    return found.label


TASK = pa.schema([("part", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("own", pa.int32()), ("key", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary())])


def _solve(t: pa.Table, similarity: float) -> Iterator[pa.RecordBatch]:
    part, p, q, own, key, fp, n = (t.column(c).to_numpy() for c in TASK.names[:7])
    side = (own == q) & (p != q)
    fp = fp.view(np.uint64)
    order = np.lexsort((fp, side, q, p, part))
    part, p, q, side, key, fp, n = (v[order] for v in (part, p, q, side, key, fp, n))
    group = np.cumsum(np.r_[True, (part[1:] != part[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]) - 1
    sketches = t.column("sketch").take(pa.array(order)).to_pylist()
    size = np.array([len(s) // 4 for s in sketches])
    hashes, first = np.frombuffer(b"".join(sketches), np.uint32), np.cumsum(size) - size
    label = similar_classes(group, side.astype(np.int8), p != q, fp, lambda i, j: similarities(i, j, first, size, hashes, n) >= similarity)
    member = np.flatnonzero(label != np.arange(len(label)))
    if len(member):
        yield pa.RecordBatch.from_arrays([pa.array(key[label[member]]), pa.array(key[member])], names=["a", "b"])


def _links(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by (part, p, q); whole groups are solved together, some tens of thousands of rows at a time."""
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(pa.RecordBatch.from_arrays(batch.columns, schema=TASK))
            rows += batch.num_rows
            if rows >= 4 * NODE:
                t = pa.Table.from_batches(held)
                a, b, c = (t.column(x).to_numpy() for x in ("part", "p", "q"))
                last = np.flatnonzero((a != a[-1]) | (b != b[-1]) | (c != c[-1]))
                if len(last):
                    yield from _solve(t.slice(0, last[-1] + 1), similarity)
                    t = t.slice(last[-1] + 1)
                held, rows = t.to_batches(), t.num_rows
        if held:
            yield from _solve(pa.Table.from_batches(held, schema=TASK), similarity)

    return run


def near_classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, node: int = NODE) -> DataFrame:
    """(id, text_hash long, root long, component: least id of the class, itself included) for every row; rows of one root are a class.

    Null ids take part; a class of null ids alone has a null component.
    """
    rows = written(spark, with_profile(docs, id_col, text_col, words), "profiles")
    unique = rows.groupBy("key").agg(F.min(id_col).alias("least"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("parts").alias("parts"))
    unique = written(spark, unique, "texts")
    dealt = unique.select("key", F.explode("parts").alias("part"))
    # parts of one text have nothing to compare
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("part").alias("_part"), F.ceil(F.col("_n") / node).cast("int").alias("cuts"))
    dealt = dealt.join(parts, F.col("part") == F.col("_part")).select("key", "part", "cuts", F.pmod(F.xxhash64("key"), "cuts").cast("int").alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = dealt.select(F.col("key").alias("_key"), "part", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own")
    tasks = dealt.join(unique.select("key", "fp", "n", "sketch"), F.col("_key") == F.col("key")).select(*TASK.names)
    tasks = tasks.repartition(partitions(spark), "part", "p", "q").sortWithinPartitions("part", "p", "q")
    roots = connected_components(spark, tasks.mapInArrow(_links(similarity), "a long, b long"))
    member = unique.select("key", "least").join(roots, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    member = written(spark, member, "members")
    component = member.groupBy("root").agg(F.min("least").alias("component"))
    by_key = member.join(component, "root").select(F.col("key").alias("_k"), "root", "component")
    return rows.select(id_col, "text_hash", "key").join(by_key, F.col("key") == F.col("_k")).select(id_col, "text_hash", "root", "component")


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """All columns of one row of each class: that of the least id; of several texts of this id in a class one stays, and of repeated rows too. A class of null ids alone keeps one row."""
    mark = made()
    found = near_classes(spark, docs, id_col, text_col, **kw).filter(F.col(id_col).eqNullSafe(F.col("component")))
    texts = found.groupBy("root", F.col(id_col).alias("__kept_id"), F.col("text_hash").alias("__kept_text")).agg(F.count(F.lit(1)).alias("__kept_n"))
    chosen = texts.groupBy("root").agg(F.min(F.struct("__kept_text", "__kept_id", "__kept_n")).alias("c")).select("c.*")
    chosen = written(spark, chosen, "chosen")
    forget(spark, made(mark)[:-1])
    # the same plan at every size: chosen ids grow with the table and are never broadcast
    same = docs[id_col].eqNullSafe(F.col("__kept_id")) & (F.xxhash64(docs[text_col]) == F.col("__kept_text"))
    got = docs.join(chosen.drop("__kept_n").hint("merge"), same, "left_semi")
    repeated = chosen.filter("__kept_n > 1")
    if repeated.isEmpty():
        return got
    again = got[id_col].eqNullSafe(F.col("__kept_id")) & (F.xxhash64(got[text_col]) == F.col("__kept_text"))
    return got.join(repeated, again, "left_anti").unionByName(got.join(repeated, again, "left_semi").dropDuplicates([id_col, text_col]))
