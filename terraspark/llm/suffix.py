"""Removal of repeated passages: every byte inside a string of 200 bytes that also starts elsewhere.

Whatever repeats must share an anchor: of every run of 169 starts of 32-byte
strings the one of least hash (the last of equals). Each string of 200 bytes has one
anchor; those of an anchor start in one range, its surroundings. So each document is
reduced to its anchors, and only bytes around an anchor that occurs again are compared:

1. Anchors of all documents, each with a hash of its surroundings, are written as a
   table. Surroundings that occur twice are repeated as a whole; anchors that occur
   once are done.
2. Where an anchor has different surroundings, one of each goes to a shard, by anchor.
   A shard builds the suffix array of its bytes as Larsson and Sadakane do it, in numpy:
   suffixes are sorted by 8 bytes, then by the rank of what follows after 8, 16, ...
   bytes, and only groups that are not yet apart are sorted again. Kasai's walk gives
   the common prefixes of neighbours, along all surroundings at once. Suffixes meet only
   at the same distance from the same anchor, so a string never meets itself. Groups
   of a few surroundings are laid side by side instead.
3. Anchors with many different surroundings lie in several shards. Each shard then
   hands out its sorted strings as 128-bit digests, cut into ranges by binary
   search; runs of a range are merged and looked up by binary search.
4. What is repeated is merged to spans and cut out of the documents.

Equal texts have equal spans, so spans are held once per text; a text is known by 96
bits of its hash, surroundings by 128 (the anchor's and their own). Null texts count as
empty; texts below 200 bytes lose nothing. No anchor, group or text is capped; long
texts are read for anchors in pieces that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspark.llm.common import forget, made, partitions, written

LENGTH = 200
GRAM = 32
#: Different surroundings of an anchor that go into one shard.
SHARD = 2000
#: Bytes that are sorted together; whole groups are added until it is reached.
SORTED = 1 << 20
#: Groups of at most so many surroundings are compared side by side.
FEW = 16
#: Starts that are looked at together when a text is read for anchors.
PIECE = 1 << 20
#: How far before an anchor a string that holds it can start.
BACK = LENGTH - GRAM
#: Places around an anchor: those of all bytes of strings that hold it.
PLACES = BACK + LENGTH

_M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_ALL = (1 << 64) - 1


def rolling(a: np.ndarray, size: int, multiplier: int) -> np.ndarray:
    """Polynomial hashes of all strings of ``size`` bytes; the parts of a size that is no power of two are joined."""
    level, n, m = a.astype(np.uint64) + np.uint64(1), 1, multiplier
    out, done = None, 0
    while True:
        if size & n:
            if out is None:
                out = level
            else:
                # the parts so far stand behind this one
                power = np.uint64(pow(multiplier, done, 1 << 64))
                k = max(0, min(len(level), len(out) - n))
                out = level[:k] * power + out[n : n + k]
            done += n
        if done == size:
            return out
        if len(level) <= n:
            return np.zeros(0, np.uint64)
        level, m, n = level[:-n] * np.uint64(m) + level[n:], m * m & _ALL, 2 * n


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _anchors_of(b: bytes) -> tuple[np.ndarray, ...]:
    window = LENGTH - GRAM + 1
    h = mixed(rolling(np.frombuffer(b, np.uint8), GRAM, _M1))
    n = len(h)
    # the least hash, of equals the last start: high bits of the hash, then the start counted down
    low = np.uint64((1 << 24) - 1)
    x = np.full(-(-n // window) * window, _ALL, np.uint64)
    x[:n] = (h & ~low) | (low - np.arange(n, dtype=np.uint64))
    x = x.reshape(-1, window)
    before = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1]).ravel()
    least = np.minimum(behind[: n - window + 1], before[window - 1 : n])
    pos = (low - (least & low)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
    pos = pos[first]
    return pos, h[pos], first, np.r_[first[1:], len(least)] - 1


def anchors(b: bytes, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """Starts and hashes of the anchors, and the first and the last start of the strings of LENGTH bytes that each stands for; together they are all strings."""
    last = len(b) - LENGTH + 1
    parts: list[list[np.ndarray]] = []
    for lo in range(0, last, piece):
        pos, h, first, end = _anchors_of(b[lo : min(last, lo + piece) + LENGTH - 1])
        pos, first, end = pos + lo, first + lo, end + lo
        if parts and parts[-1][0][-1] == pos[0]:  # goes on from the piece before
            parts[-1][3][-1] = end[0]
            pos, h, first, end = pos[1:], h[1:], first[1:], end[1:]
        if len(pos):
            parts.append([pos, h, first, end])
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def packed(pos: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """An anchor's place and range of starts in one number."""
    return pos << 16 | (pos - first) << 8 | (pos - last)


def unpacked(at):
    """(place, first start, last start); for numbers, arrays and columns alike."""
    if isinstance(at, Column):
        pos = F.shiftright(at, 16)
        return pos, pos - F.shiftright(at, 8).bitwiseAND(255), pos - at.bitwiseAND(255)
    pos = at >> 16
    return pos, pos - (at >> 8 & 255), pos - (at & 255)


def _key(text: bytes) -> tuple[int, int]:
    """96 bits of the text's hash as a long and an int."""
    import xxhash

    x = xxhash.xxh3_128_intdigest(text)
    return (x & _ALL) - (1 << 63), (x >> 64 & 0xFFFFFFFF) - (1 << 31)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for value in batch.column(0):
            b = (value.as_py() or "").encode()
            pos, h, first, last = anchors(b)
            if len(pos):
                view = memoryview(b)
                # the seed tells surroundings apart that are equal but lie otherwise
                ctx = [digest(view[f : e + LENGTH], p - f) for p, f, e in zip(pos.tolist(), first.tolist(), last.tolist(), strict=True)]
                k1, k2 = _key(b)
                n = len(pos)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, k1, np.int64)), pa.array(np.full(n, k2, np.int32)), pa.array(packed(pos, first, last)), pa.array(h.view(np.int64)), pa.array(np.array(ctx, np.uint64).view(np.int64))], names=["k1", "k2", "at", "h", "ctx"]
                )


def words_at(a: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; those of the last seven places are not whole."""
    x = np.r_[a, np.zeros(7, np.uint8)].astype(np.uint64)
    for size in (1, 2, 4):
        x = x[:-size] << np.uint64(8 * size) | x[size:]
    return x


def suffix_array(v: np.ndarray, klass: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All suffixes by class, then by their bytes up to their ``end`` (a shorter one before those it begins), then by place.

    ``v``: the eight bytes at each place. Larsson-Sadakane: a suffix's rank is the last place
    of its group; groups of one, and of suffixes that have come to their end, are done.
    """
    n = len(v)
    left = end - np.arange(n)
    few = (8 - np.minimum(left, 8)).astype(np.uint64) * np.uint64(8)
    w = np.where(left >= 8, v, v >> few << few)
    # bytes and length to dense numbers, so that class and bytes go into one key
    order = np.argsort(w)
    w = w[order]
    dense = np.empty(n, np.int64)
    dense[order] = np.cumsum(np.r_[False, w[1:] != w[:-1]])
    bits = int(n * 10).bit_length()
    key = klass << bits | dense * 10 + np.minimum(left, 9)
    sa = np.argsort(key)
    key, slots, rank, size = key[sa], np.arange(n), np.zeros(n, np.int64), 8
    bits = int(n + 1).bit_length()
    while len(slots):
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        many = np.diff(np.r_[head, len(key)])
        at = sa[slots]
        rank[at] = np.repeat(slots[head + many - 1] + 1, many)
        going = np.repeat(many > 1, many) & (left[at] > size)
        slots, at = slots[going], at[going]
        key = rank[at] << bits | rank[at + size]
        order = np.argsort(key)
        sa[slots], key = at[order], key[order]
        size *= 2
    equal = rank[sa[1:]] == rank[sa[:-1]]
    slots = np.flatnonzero(np.r_[equal, False] | np.r_[False, equal])
    at = sa[slots]
    sa[slots] = at[np.argsort(rank[at] << bits | at)]
    return sa


def common_prefixes(a: np.ndarray, v: np.ndarray, sa: np.ndarray, klass: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which places start a string of ``length`` bytes that another suffix of their class starts with too.

    Kasai: the prefix that a suffix shares with the one before it in the array is at most
    one shorter than that of the suffix a byte earlier. The walk goes along all pieces
    (from ``begin`` on) at once, as far as whole strings start.
    """
    before = np.full(len(a), -1)
    same = klass[sa[1:]] == klass[sa[:-1]]
    before[sa[1:][same]] = sa[:-1][same]
    found = np.zeros(len(a), bool)
    shared = np.zeros(len(begin), np.int64)
    for step in range(int((end[begin] - begin).max(initial=0)) - length + 1):
        i = begin + step
        on = np.flatnonzero(end[begin] - i >= length)
        i = i[on]
        j = before[i]
        k = np.where(j >= 0, np.maximum(shared[on] - 1, 0), 0)
        most = np.where(j >= 0, np.minimum(length, end[j] - j), 0)
        look = np.flatnonzero(k < most)
        while len(look):  # eight bytes at a time, then one
            p, q, done = i[look] + k[look], j[look] + k[look], most[look] - k[look]
            by = np.where((done >= 8) & (v[p] == v[q]), 8, (a[p] == a[q]).astype(np.int64))
            k[look] += by
            look = look[(by > 0) & (by < done)]
        shared[on] = k
        hit = k >= length
        found[i[hit]] = found[j[hit]] = True
    return found


def side_by_side(a: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, group: np.ndarray, most: int, length: int = LENGTH) -> np.ndarray:
    """As common_prefixes, for groups of at most ``most`` pieces, which stand next to each other; ``place``: distance of a piece's first byte from BACK before its anchor."""
    found = np.zeros(len(a), bool)
    for lo in range(0, len(begin), 2048):
        # a group that is cut here is met again with the next rows
        rows = np.arange(lo, min(len(begin), lo + 2048 + most))
        b, n, f, g = begin[rows], size[rows], place[rows], group[rows]
        at = np.arange(PLACES) - f[:, None]
        inside = (at >= 0) & (at < n[:, None])
        at = np.where(inside, at + b[:, None], 0)
        m = a[at].astype(np.int16)
        m[~inside] = -1
        starts = np.zeros((len(rows), PLACES - length + 1), bool)
        for k in range(1, most):
            x, y = slice(0, max(0, len(rows) - k)), slice(k, None)
            pair = np.flatnonzero(g[x] == g[y])
            if not len(pair):
                break
            equal = (m[pair] == m[pair + k]) & inside[pair] & inside[pair + k]
            total = np.cumsum(equal, axis=1, dtype=np.int16)
            run = np.concatenate([total[:, length - 1 : length], total[:, length:] - total[:, :-length]], axis=1) == length
            starts[pair] |= run
            starts[pair + k] |= run
        r, c = np.nonzero(starts)
        found[at[r, c]] = True
    return found


def repeats(a: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, group: np.ndarray, few: int = FEW) -> np.ndarray:
    """Which places of ``a`` start a string of LENGTH bytes that stands at the same place of another piece of the group. Groups ascend."""
    if not len(begin):
        return np.zeros(len(a), bool)
    _, of, many = np.unique(group, return_inverse=True, return_counts=True)
    small = many[of] <= few
    found = side_by_side(a, begin[small], size[small], place[small], group[small], few)
    if small.all():
        return found
    # the others' bytes one after the other
    b, n, f, g = begin[~small], size[~small], place[~small], of[~small]
    new = np.cumsum(n) - n
    which = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - new[which]
    t = a[b[which] + offset]
    klass = np.unique(g, return_inverse=True)[1][which] * PLACES + f[which] + offset
    end = (new + n)[which]
    v = words_at(t)
    hit = np.flatnonzero(common_prefixes(t, v, suffix_array(v, klass, end), klass, new, end))
    found[b[which[hit]] + offset[hit]] = True
    return found


def _runs(owner: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ascending within each owner -> owners and spans that the strings cover."""
    if not len(starts):
        return owner, starts, starts
    cut = np.flatnonzero((np.diff(starts) > length) | (owner[1:] != owner[:-1]))
    lo, hi = np.r_[0, cut + 1], np.r_[cut, len(starts) - 1]
    return owner[lo], starts[lo], starts[hi] + length


SHARD_ROWS = "kind int, k1 long, k2 int, a int, b int, cut int, shard long, digests binary, owners binary"
_NAMES = ["kind", "k1", "k2", "a", "b", "cut", "shard", "digests", "owners"]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
_DIGEST = np.dtype([("x", "<u8"), ("y", "<u8")])
_OWNER = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("start", "<i8")])


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)


def _spans(k1: np.ndarray, k2: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return _batch(kind=np.zeros(len(k1), np.int32), k1=k1, k2=k2.astype(np.int32), a=a.astype(np.int32), b=b.astype(np.int32))


def _sort_shard(rows: dict[str, np.ndarray], texts: list[bytes], ranges: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, salt, salts, k1, k2, at) of whole groups, in order, and their bytes -> spans (kind 0) and, where a group has more shards, runs of digests (kind 1)."""
    size = np.array([len(t) for t in texts])
    a = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(size) - size
    h, salt = rows["h"], rows["salt"]
    group = np.cumsum(np.r_[True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])])
    pos, first, _ = unpacked(rows["at"])
    place = first - pos + BACK
    hit = np.flatnonzero(repeats(a, begin, size, place, group))
    which = np.searchsorted(begin, hit, side="right") - 1
    owner, lo, hi = _runs(which, hit - begin[which] + first[which])
    if len(owner):
        yield _spans(rows["k1"][owner], rows["k2"][owner], lo, hi)
    spread = np.flatnonzero(rows["salts"] > 1)
    if len(spread):
        x, y = mixed(rolling(a, LENGTH, _M1)), mixed(rolling(a, LENGTH, _M2))
        n = size[spread] - LENGTH + 1
        which = np.repeat(spread, n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        s = begin[which] + offset
        with_anchor = mixed(h.view(np.uint64)[which] + (place[which] + offset).astype(np.uint64) * np.uint64(_M2))
        d, own = np.zeros(len(s), _DIGEST), np.zeros(len(s), _OWNER)
        d["x"], d["y"] = x[s] ^ with_anchor, y[s] + with_anchor
        own["k1"], own["k2"], own["start"] = rows["k1"][which], rows["k2"][which], first[which] + offset
        # what repeats inside a shard is cut already: one of equal digests stands for the shard
        of = group[which]
        order = np.lexsort((of, d["y"], d["x"]))
        d, own, of = d[order], own[order], of[order]
        one = np.r_[True, (d[1:] != d[:-1]) | (of[1:] != of[:-1])]
        d, own = d[one], own[one]
        cuts = np.searchsorted(d["x"], np.array([i * (1 << 64) // ranges for i in range(1, ranges)], np.uint64)) if ranges > 1 else np.zeros(0, np.int64)
        edges = np.r_[0, cuts, len(d)]
        full = np.flatnonzero(np.diff(edges))
        shard = int(h[0]) ^ (int(salt[0]) << 40) ^ len(texts)
        yield _batch(kind=np.ones(len(full), np.int32), cut=full.astype(np.int32), shard=np.full(len(full), shard, np.int64), digests=[d[edges[i] : edges[i + 1]].tobytes() for i in full], owners=[own[edges[i] : edges[i + 1]].tobytes() for i in full])


_KEYS = ["h", "salt", "salts", "k1", "k2", "at"]


def _sorter(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = {c: t.column(c).to_numpy() for c in _KEYS}
            # copies of a text may come from several tasks
            new = np.ones(t.num_rows, bool)
            new[1:] = np.any([rows[c][1:] != rows[c][:-1] for c in _KEYS], axis=0)
            if not new.all():
                t, rows = t.filter(pa.array(new)), {c: v[new] for c, v in rows.items()}
            yield from _sort_shard(rows, t.column("bytes").to_pylist(), ranges)

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                held.append(part)
                size += part.column(6).nbytes
                if size >= SORTED:
                    t = pa.Table.from_batches(held)
                    h, salt = t.column("h").to_numpy(), t.column("salt").to_numpy()
                    # the last group may go on
                    last = np.flatnonzero((h != h[-1]) | (salt != salt[-1]))
                    if len(last):
                        yield from solve(t.slice(0, last[-1] + 1))
                        t = t.slice(last[-1] + 1)
                    held, size = t.to_batches(), sum(len(x) for x in t.column("bytes").to_pylist())
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of digests -> spans of the strings that stand in more than one place. Rows come ordered by cut."""

    def merged(runs: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        digests = [np.frombuffer(d, _DIGEST) for d, _ in runs]
        owners = [np.frombuffer(o, _OWNER) for _, o in runs]
        every = np.concatenate(digests)
        every = every[np.lexsort((every["y"], every["x"]))]
        twice = every[1:][every[1:] == every[:-1]]
        if not len(twice):
            return
        found = []
        for d, o in zip(digests, owners, strict=True):
            lo = np.searchsorted(twice["x"], d["x"])
            hit = np.zeros(len(d), bool)
            at, more = lo.copy(), np.ones(len(d), bool)
            while more.any():  # equal first halves are next to each other
                inside = more & (at < len(twice))
                same = inside.copy()
                same[inside] = twice["x"][at[inside]] == d["x"][inside]
                hit[same] |= twice["y"][at[same]] == d["y"][same]
                more = same & ~hit
                at = at + 1
            found.append(o[hit])
        o = np.concatenate(found)
        o = o[np.lexsort((o["start"], o["k2"], o["k1"]))]
        text = np.cumsum(np.r_[True, (o["k1"][1:] != o["k1"][:-1]) | (o["k2"][1:] != o["k2"][:-1])]) - 1
        head = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        owner, lo, hi = _runs(text, o["start"])
        if len(owner):
            yield _spans(o["k1"][head[owner]], o["k2"][head[owner]], lo, hi)

    cut, runs = None, []
    for batch in batches:
        for c, d, o in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("cut", "digests", "owners")), strict=True):
            if c != cut and runs:
                yield from merged(runs)
                runs = []
            cut = c
            runs.append((d, o))
    if runs:
        yield from merged(runs)


def _cut_surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, k1, k2, ragged) -> (h, salt, salts, k1, k2, at, bytes), once for equal texts of a task."""
    seen: set[tuple[int, int]] = set()
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*_KEYS, "bytes"])
    for batch in batches:
        out = []
        for text, k1, k2, ragged in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (k1, k2) in seen:
                continue
            seen.add((k1, k2))
            b = text.encode()
            for r in ragged:
                _, first, last = unpacked(r["at"])
                # by place too: the surroundings of an anchor inside one text are spread as well
                out.append((r["h"], ((k1 ^ r["at"] * 0x85EBCA77) * 0x9E3779B1 >> 7) % r["salts"], r["salts"], k1, k2, r["at"], b[first : last + LENGTH]))
                if len(out) >= 20_000:
                    yield give(out)
                    out = []
        if out:
            yield give(out)


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k1, k2 = zip(*(_key((v.as_py() or "").encode()) for v in batch.column(1)), strict=True) if batch.num_rows else ((), ())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k1, pa.int64()), pa.array(k2, pa.int32())], names=["id", "text", "k1", "k2"])


def cut_text(b: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal spans, what is left)."""
    kept, done, removed, n = [], 0, 0, 0
    end = -1
    for s, e in sorted(spans):
        s, e = max(s, 0), min(e, len(b))
        if s > end:
            n += 1
            kept.append(b[done:s])
            removed += e - s
        elif e > end:
            removed += e - end
        end = max(end, e)
        done = end
    return removed, n, b"".join([*kept, b[done:]])


def _same_text(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    r = right.withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    return left.join(r, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), how)


def repeated_spans(spark: SparkSession, docs: DataFrame, text_col: str = "text", shard: int | None = None) -> DataFrame:
    """(k1, k2, spans array<struct<a, b>>): for each text that holds repeats, by its hash, the spans to cut (they may overlap)."""
    shard = shard or SHARD
    n = partitions(spark)
    texts = docs.select(F.col(text_col).alias("text"))
    found = written(spark, texts.mapInArrow(_anchor_rows, "k1 long, k2 int, at long, h long, ctx long"), "anchors")
    counts = written(spark, found.groupBy("h", "ctx").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("k1", "k2", "at")).alias("one")), "surroundings")
    recur = counts.groupBy("h").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("c")).filter("n > 1")
    state = counts.join(recur.withColumnRenamed("h", "_h"), F.col("h") == F.col("_h"))
    state = written(spark, state.select("h", "ctx", "m", "one", F.when(F.col("c") > 1, F.ceil(F.col("c") / shard)).otherwise(0).cast("int").alias("salts")), "recurring")
    # surroundings that occur twice are repeated as a whole; equal texts give equal rows, of which one is needed
    twice = state.filter("m > 1").select(F.col("h").alias("_h"), F.col("ctx").alias("_ctx"))
    _, first, last = unpacked(F.col("at"))
    whole = found.join(twice, (F.col("ctx") == F.col("_ctx")) & (F.col("h") == F.col("_h"))).select("k1", "k2", first.cast("int").alias("a"), (last + LENGTH).cast("int").alias("b")).distinct()
    # one of each of an anchor's different surroundings is compared with the others
    ragged = state.filter("salts > 0").select("one.*", "h", "salts").groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "h", "salts")).alias("ragged"))
    keyed = docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")).mapInArrow(_with_key, "id int, text string, k1 long, k2 int")
    around = _same_text(keyed, ragged).select("text", "k1", "k2", "ragged").mapInArrow(_cut_surroundings, "h long, salt int, salts int, k1 long, k2 int, at long, bytes binary")
    spread = state.filter("salts > 1").count()
    ranges = max(1, -(-spread * (BACK + 1) // 1_000_000))
    sorted_ = around.repartition(n, "h", "salt").sortWithinPartitions("h", "salt", "k1", "k2", "at").mapInArrow(_sorter(ranges), SHARD_ROWS)
    sorted_ = written(spark, sorted_, "shards")
    spans = whole.unionByName(sorted_.filter("kind = 0").select("k1", "k2", "a", "b"))
    if spread:
        runs = sorted_.filter("kind = 1").repartition(min(ranges, 4 * n), "cut").sortWithinPartitions("cut")
        spans = spans.unionByName(runs.mapInArrow(_merge, SHARD_ROWS).select("k1", "k2", "a", "b"))
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int | None = None) -> DataFrame:
    """(id, kept binary, n_bytes, n_removed, n_spans) for every row."""
    mark = made()
    spans = written(spark, repeated_spans(spark, docs, text_col, shard), "spans")
    forget(spark, made(mark)[:-1])  # the spans are all that is still read
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_with_key, f"id {kind}, text string, k1 long, k2 int")
    both = _same_text(keyed, spans, "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                b = (text or "").encode()
                removed, k, kept = cut_text(b, [(s["a"], s["b"]) for s in found or ()])
                rows.append((kept, len(b), removed, k))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True))], names=[id_col, "kept", "n_bytes", "n_removed", "n_spans"])

    return both.mapInArrow(run, f"`{id_col}` {kind}, kept binary, n_bytes long, n_removed long, n_spans long")

