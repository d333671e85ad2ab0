"""Arc/Info grids written by hand, every way to pack a block, and tiles of several files."""

import struct

import numpy as np
import pytest

from terraspark.sources import arc_grid as A

GONE = A.NO_DATA


def packed(v, way):
    """A block's bytes behind the size. v: whole numbers, GONE for no data."""
    v = np.asarray(v, np.int64).ravel()
    there = v[v != GONE] if way in (A.LITERAL_16, A.LITERAL_8, A.LITERAL_LEAST) else v
    low = int(there.min()) if len(there) else 0
    size = next(k for k in (1, 2, 4) if -(1 << 8 * k - 1) <= low < 1 << 8 * k - 1) if low else 0
    head = bytes([way, size]) + low.to_bytes(size, "big", signed=True) if size else bytes([way, 0])
    d = v - low
    if way == A.CONSTANT:
        return head
    if way == A.BITS_1:
        return head + np.packbits(d.astype(np.uint8)).tobytes()
    if way == A.BITS_4:
        e = np.r_[d, np.zeros(len(d) % 2, np.int64)].astype(np.uint8)
        return head + (e[::2] << 4 | e[1::2]).tobytes()
    if way in (A.BITS_8, A.BITS_16, A.BITS_32):
        return head + d.astype({A.BITS_8: ">u1", A.BITS_16: ">u2", A.BITS_32: ">u4"}[way]).tobytes()
    out, i = b"", 0
    while i < len(v):
        j = i
        if way in (A.RUNS_32, A.RUNS_16, A.RUNS_8, A.RUNS_8_OTHER):
            while j < len(v) and v[j] == v[i] and j - i < 255:
                j += 1
            out += bytes([j - i]) + int(d[i]).to_bytes({A.RUNS_32: 4, A.RUNS_16: 2}.get(way, 1), "big")
        else:
            while j < len(v) and (v[j] == GONE) == (v[i] == GONE) and j - i < 127:
                j += 1
            k = {A.LITERAL_16: 2, A.LITERAL_8: 1, A.LITERAL_LEAST: 0}[way]
            out += bytes([256 - (j - i)]) if v[i] == GONE else bytes([j - i]) + b"".join(int(x).to_bytes(k, "big") for x in d[i:j]) if k else bytes([j - i])
        i = j
    return head + out


def some(rng, way, n):
    top = {A.CONSTANT: 1, A.BITS_1: 2, A.BITS_4: 16, A.BITS_8: 256, A.RUNS_8: 256, A.RUNS_8_OTHER: 256, A.LITERAL_8: 256, A.LITERAL_LEAST: 1}.get(way, 60000)
    v = rng.integers(0, top, n) + int(rng.integers(-300, 300))
    if way in (A.RUNS_32, A.RUNS_16, A.RUNS_8, A.RUNS_8_OTHER):
        v = np.repeat(v, 7)[:n]
    if way in (A.LITERAL_16, A.LITERAL_8, A.LITERAL_LEAST, A.BITS_32, A.RUNS_32):
        v[rng.random(n) < 0.4] = GONE
    return v


WAYS = [A.CONSTANT, A.BITS_1, A.BITS_4, A.BITS_8, A.BITS_16, A.BITS_32, A.LITERAL_16, A.LITERAL_8, A.LITERAL_LEAST, A.RUNS_32, A.RUNS_16, A.RUNS_8, A.RUNS_8_OTHER]


@pytest.mark.parametrize("way", WAYS)
def test_every_way_to_pack(way):
    rng = np.random.default_rng(way)
    for n in (1, 7, 64, 1023):
        v = some(rng, way, n)
        assert (A.unpacked(packed(v, way), n) == v).all()


def test_broken_blocks():
    for raw in (bytes([A.RUNS_8, 0, 3, 1]), bytes([A.LITERAL_8, 0, 2, 1, 1]), bytes([0x55, 0, 1])):
        with pytest.raises(ValueError):
            A.unpacked(raw, 9)


def write(folder, a, kind, block=(4, 8), tile=(2, 2), ways=(A.BITS_32,), lost=()):
    """a: rows of cells; tile: blocks down and along."""
    folder.mkdir()
    (bh, bw), (h, w) = block, a.shape
    head = bytearray(308)
    head[:8] = b"GRID1.2\0"
    struct.pack_into(">i", head, 16, kind)
    struct.pack_into(">2d", head, 256, 0.5, 0.25)
    struct.pack_into(">5i", head, 288, tile[1], tile[0], bw, 1, bh)
    (folder / "hdr.adf").write_bytes(head)
    (folder / "dblbnd.adf").write_bytes(struct.pack(">4d", 10.0, 40.0, 10.0 + 0.5 * w, 40.0 + 0.25 * h))
    k = 0
    for ty in range(-(-h // (bh * tile[0]))):
        for tx in range(-(-w // (bw * tile[1]))):
            data, index = bytearray(100), bytearray(100)
            for r in range(tile[0]):
                for c in range(tile[1]):
                    z, x = (ty * tile[0] + r) * bh, (tx * tile[1] + c) * bw
                    if (z, x) in lost or z >= h or x >= w:
                        index += struct.pack(">2i", 0, 0)
                        continue
                    b = np.full(block, GONE if kind == 1 else A.NO_FLOAT, float)
                    part = a[z : z + bh, x : x + bw]
                    b[: part.shape[0], : part.shape[1]] = part
                    raw = packed(b, ways[k % len(ways)]) if kind == 1 else b.astype(">f4").tobytes()
                    raw += bytes(len(raw) % 2)
                    k += 1
                    index += struct.pack(">2i", len(data) // 2, len(raw) // 2)
                    data += struct.pack(">h", len(raw) // 2) + raw
            (folder / f"{A.tile_name(ty, tx)}.adf").write_bytes(data)
            (folder / f"{A.tile_name(ty, tx)}x.adf").write_bytes(index)


@pytest.mark.parametrize("kind", [1, 2])
def test_grids_of_several_tiles(spark, tmp_path, kind):
    rng = np.random.default_rng(kind)
    a = rng.integers(-400, 4000, (29, 37)).astype(float)
    hole = rng.random(a.shape) < 0.2
    a[hole] = GONE if kind == 1 else A.NO_FLOAT
    write(tmp_path / "g", a, kind, ways=(A.BITS_32, A.LITERAL_16, A.RUNS_32), lost=[(8, 16), (0, 0)])
    lost = {(z, x) for p, q in ((8, 16), (0, 0)) for z in range(p, p + 4) for x in range(q, q + 8)}
    want = {k: None if hole[k] else a[k] for k in np.ndindex(a.shape) if k not in lost}
    df = A.read_arc_grid(spark, str(tmp_path / "g" / "w001000.adf"), 8)
    assert df.rdd.getNumPartitions() == 4 and {(r["z"], r["x"]): r["v"] for r in df.collect()} == want
    part = A.read_arc_grid(spark, str(tmp_path / "g"), 8, window=(7, 5, 18, 21))
    assert part.rdd.getNumPartitions() == 3 and {(r["z"], r["x"]): r["v"] for r in part.collect()} == {k: v for k, v in want.items() if 7 <= k[0] < 18 and 5 <= k[1] < 21}
    g = A.ArcGrid(str(tmp_path / "g")).grid()
    assert (g.width, g.height, g.c, g.f) == (37, 29, 10.0, 47.25)


def test_not_a_grid(tmp_path):
    (tmp_path / "hdr.adf").write_bytes(bytes(308))
    with pytest.raises(ValueError):
        A.ArcGrid(str(tmp_path))
