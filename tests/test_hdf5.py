"""HDF5 variables: files laid out by hand from the format's description, in the old and the new style, read back."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspark.sources import hdf5, ingest

NONE = b"\xff" * 8


def dtype_message(kind):
    kind = np.dtype(kind)
    bits = (kind.byteorder == ">") | (8 if kind.kind == "i" else 0)
    tail = struct.pack("<HH", 0, 8 * kind.itemsize) if kind.kind in "iu" else struct.pack("<HHBBBBI", 0, 32, 23, 8, 0, 23, 127)
    return struct.pack("<B3BI", 0x10 | (0 if kind.kind in "iu" else 1), bits, 31 if kind.kind == "f" else 0, 0, kind.itemsize) + tail


def space_message(shape, version):
    head = struct.pack("<BBBB", version, len(shape), 0, 1 if version == 2 else 0) + (bytes(4) if version == 1 else b"")
    return head + struct.pack(f"<{len(shape)}Q", *shape)


def attribute(name, value, version):
    d, s, raw = dtype_message("<f8"), space_message((), version and 1), struct.pack("<d", value)
    n = name.encode() + b"\0"
    if version == 1:
        pad = lambda b: b + bytes(-len(b) % 8)
        return struct.pack("<BBHHH", 1, 0, len(n), len(d), len(s)) + pad(n) + pad(d) + pad(s) + raw
    return struct.pack("<BBHHHB", 3, 0, len(n), len(d), len(s), 0) + n + d + s + raw


class Writer:
    def __init__(self):
        self.b = bytearray(96)

    def put(self, data):
        at = len(self.b)
        self.b += data + bytes(-len(data) % 8)
        return at

    def header(self, messages, new):
        """An object header whose last message stands in a continuation block."""
        if new:
            pack = lambda m: struct.pack("<BHB", m[0], len(m[1]), 0) + m[1]
            rest = b"OCHK" + pack(messages[-1]) + bytes(4)
            go = self.put(rest)
            body = b"".join(map(pack, messages[:-1])) + pack((16, struct.pack("<QQ", go, len(rest))))
            return self.put(b"OHDR" + bytes([2, 2]) + struct.pack("<I", len(body)) + body + bytes(4))
        pack = lambda m: struct.pack("<HHB3x", m[0], len(m[1]) + -len(m[1]) % 8, 0) + m[1] + bytes(-len(m[1]) % 8)
        rest = pack(messages[-1])
        go = self.put(rest)
        body = b"".join(map(pack, messages[:-1])) + pack((16, struct.pack("<QQ", go, len(rest))))
        return self.put(struct.pack("<BBHII", 1, 0, len(messages) + 1, 1, len(body)) + bytes(4) + body)

    def tree(self, chunks, rank=2, leaf=3):
        """A chunk tree, of two levels where there are more chunks than a leaf holds."""
        key = lambda c: struct.pack("<II", c[1], c[2]) + struct.pack(f"<{rank + 1}Q", *c[0], 0)
        end = struct.pack(f"<II{rank + 1}Q", 0, 0, *[1 << 40] * (rank + 1))
        node = lambda level, rows: self.put(b"TREE" + struct.pack("<BBH", 1, level, len(rows)) + NONE * 2 + b"".join(k + struct.pack("<Q", a) for k, a in rows) + end)
        groups = [chunks[i : i + leaf] for i in range(0, len(chunks), leaf)]
        leaves = [(key(g[0]), node(0, [(key(c), c[3]) for c in g])) for g in groups]
        return leaves[0][1] if len(leaves) == 1 else node(1, leaves)

    def group(self, members, new):
        if new:
            links = [(6, struct.pack("<BBB", 1, 0, len(n)) + n.encode() + struct.pack("<Q", a)) for n, a in members.items()]
            return self.header([(2, struct.pack("<BB", 0, 0) + NONE * 2), *links], True)
        names, at = bytearray(8), {}
        for n in sorted(members):
            at[n] = len(names)
            names += n.encode() + b"\0" + bytes(-(len(n) + 1) % 8)
        data = self.put(bytes(names))
        heap = self.put(b"HEAP" + bytes(4) + struct.pack("<QQQ", len(names), (1 << 64) - 1, data))
        node = self.put(b"SNOD" + struct.pack("<BBH", 1, 0, len(members)) + b"".join(struct.pack("<QQII16x", at[n], members[n], 0, 0) for n in sorted(members)))
        tree = self.put(b"TREE" + struct.pack("<BBH", 0, 0, 1) + NONE * 2 + struct.pack("<QQQ", 0, node, 0))
        return self.header([(0, bytes(8)), (17, struct.pack("<QQ", tree, heap))], False)

    def finish(self, path, root, new):
        if new:
            self.b[:48] = hdf5.MARK + bytes([2, 8, 8, 0]) + struct.pack("<QQQQ", 0, (1 << 64) - 1, len(self.b), root) + bytes(4)
        else:
            self.b[:96] = hdf5.MARK + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<4Q", 0, (1 << 64) - 1, len(self.b), (1 << 64) - 1) + struct.pack("<QQII16x", 0, root, 0, 0)
        path.write_bytes(self.b)


def variable(w, a, new, chunk=None, filters=(), lost=(), attributes=(), fill=None):
    kind, chunks = a.dtype, []
    messages = [(1, space_message(a.shape, 2 if new else 1)), (3, dtype_message(kind))]
    if fill is not None:
        messages.append((5, struct.pack("<BBI", 3, 32, kind.itemsize) + np.array(fill, kind).tobytes() if new else struct.pack("<BBBBI", 2, 2, 2, 1, kind.itemsize) + np.array(fill, kind).tobytes()))
    if chunk:
        for z in range(0, a.shape[0], chunk[0]):
            for x in range(0, a.shape[1], chunk[1]):
                if (z, x) in lost:
                    continue
                c = np.zeros(chunk, kind)
                part = a[z : z + chunk[0], x : x + chunk[1]]
                c[: part.shape[0], : part.shape[1]] = part
                raw, mask = c.tobytes(), 0
                for i, f in enumerate(filters):
                    if f == 1 and (z + x) % 3 == 2:
                        mask |= 1 << i  # now and then a filter is left out
                    elif f == 1:
                        raw = zlib.compress(raw)
                    elif f == 2:
                        raw = np.frombuffer(raw, np.uint8).reshape(-1, kind.itemsize).T.tobytes()
                    else:
                        raw += b"sum!"
                chunks.append(((z, x), len(raw), mask, w.put(raw)))
        if filters:
            each = lambda f: struct.pack("<HHHH", f, 0, 0, 1) + struct.pack("<II", 4, 0) if not new else struct.pack("<HHH", f, 0, 1) + struct.pack("<I", 4)
            messages.append((11, (bytes([2, len(filters)]) if new else bytes([1, len(filters)]) + bytes(6)) + b"".join(map(each, filters))))
        messages.append((8, struct.pack("<BBBQ3I", 3, 2, 3, w.tree(chunks) if chunks else (1 << 64) - 1, *chunk, kind.itemsize)))
    else:
        messages.append((8, struct.pack("<BBQQ", 3, 1, w.put(a.tobytes()), a.nbytes)))
    return w.header(messages + [(12, attribute(n, v, 3 if new else 1)) for n, v in attributes] + [(0, bytes(8))], new)


@pytest.mark.parametrize("new", [False, True])
@pytest.mark.parametrize("kind,filters", [("<i2", (2, 1)), (">i2", ()), ("<f4", (2, 1, 3)), ("<u1", (1,)), ("<i4", None)])
def test_written_files(spark, tmp_path, new, kind, filters):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 200, (37, 22)).astype(kind)
    w = Writer()
    place = variable(w, a, new, None if filters is None else (5, 8), filters or (), attributes=[("scale_factor", 0.5), ("add_offset", -3.0), ("_FillValue", 7.0)])
    root = w.group({"elevation": place, "sub": w.group({"other": place}, new)}, new)
    path = tmp_path / "a.nc"
    w.finish(path, root, new)
    for df in (hdf5.read_hdf5(spark, str(path), "elevation", 10), ingest.read_netcdf(spark, f"NETCDF:{path}:sub/other", 10)):
        got = {(r["z"], r["x"]): r["v"] for r in df.collect()}
        assert got == {(z, x): None if v == 7 else v * 0.5 - 3 for (z, x), v in np.ndenumerate(a.astype(float))}
    with pytest.raises(Exception, match="elevation"):
        hdf5.read_hdf5(spark, str(path), "depth").collect()


def test_a_window_reads_its_chunks_only(spark, tmp_path):
    a = np.arange(40 * 24, dtype="<i2").reshape(40, 24)
    w = Writer()
    w.finish(path := tmp_path / "a.h5", w.group({"v": variable(w, a, True, (4, 6), (2, 1))}, True), True)
    df = hdf5.read_hdf5(spark, str(path), "v", 4)
    assert df.rdd.getNumPartitions() == 10
    cut = hdf5.read_hdf5(spark, str(path), "v", 4, window=(9, 3, 14, 8))
    assert cut.rdd.getNumPartitions() == 2
    assert {(r["z"], r["x"]): r["v"] for r in cut.collect()} == {(z, x): float(a[z, x]) for z in range(9, 14) for x in range(3, 8)}
    # filters take nothing from the queries after them
    assert df.filter("z = 3").count() == 24 and df.count() == 960 and df.filter((F.col("z") == 8) & (F.col("x") > 30)).collect() == []
    for window in ((8, 30, 9, 40), (50, 0, 60, 4), (5, 5, 5, 9)):
        assert hdf5.read_hdf5(spark, str(path), "v", 4, window=window).collect() == []
    # what lies elsewhere is not even decompressed
    broken = bytearray(path.read_bytes())
    reader = hdf5.Hdf5Reader({"path": str(path), "variable": "v"})
    for (z, _), size, _, at in reader.file.chunks(reader.v.tree, 2):
        if not 8 <= z < 16:
            broken[at : at + size] = bytes(size)
    path.write_bytes(broken)
    assert cut.count() == 25
    with pytest.raises(Exception):
        df.count()


def test_chunks_never_written(spark, tmp_path):
    a = np.full((10, 9), 5, "<i2")
    w = Writer()
    lost = [(0, 0), (4, 4)]
    root = w.group({"filled": variable(w, a, False, (4, 4), (1,), lost, fill=-1), "gone": variable(w, a, False, (4, 4), (1,), lost, [("_FillValue", -1.0)], -1), "none": variable(w, a, False, (4, 4), (), [(z, x) for z in (0, 4, 8) for x in (0, 4, 8)])}, False)
    w.finish(path := tmp_path / "a.h5", root, False)
    rows = lambda v: {(r["z"], r["x"]): r["v"] for r in hdf5.read_hdf5(spark, str(path), v).collect()}
    hole = {(z, x) for p, q in lost for z in range(p, p + 4) for x in range(q, q + 4)}
    assert rows("filled") == {k: -1.0 if k in hole else 5.0 for k in np.ndindex(10, 9)}
    assert rows("gone") == {k: 5.0 for k in np.ndindex(10, 9) if k not in hole} and rows("none") == {}


def test_not_hdf5(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"CDG" * 400)
    with pytest.raises(Exception, match="HDF5"):
        hdf5.read_hdf5(spark, str(tmp_path / "x"), "v").collect()
