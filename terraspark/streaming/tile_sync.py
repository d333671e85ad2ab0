"""Climate-tile synchronisation: admission of requests, chunked transfer, reassembly, reconciliation.

Stateful parts are keyed by player (or player and tile), so state is spread by key. Each
is one function from a state and an event to a state and what is sent; the stream and
the batch form (a finished stream) run the same function. Admission alone also has a
form by windows, for maps of no more tiles than a player may hold.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed values of the protocol.
PACKET = 32_768
HELD = 256
IN_FLIGHT = 16
PER_TICK = 2
TIMEOUT_MS = 10_000


def valid(tile: str, tiles: int):
    return F.col(tile).between(0, tiles - 1)


def near_witness(region: str, witness: str, size: int = 512):
    """The witness's region is at most one away from the region asked for."""
    return F.abs(F.col(region) - F.floor(F.col(witness) / size)) <= 1


def witnessed(requests: DataFrame, width: int, height: int, layers: int, chunk: int = 32, size: int = 512) -> DataFrame:
    """Releases, and those requests(rx, rz, wx, wy, wz, loaded) whose witness chunk is loaded, lies on the map and in a region at most one away from the one asked for."""
    on = lambda c, blocks: (F.col(c) >= 0) & (F.col(c) * chunk < blocks)
    tile = F.col("rx").between(0, -(-width // size) - 1) & F.col("rz").between(0, -(-height // size) - 1)
    near = near_witness("rx", "wx", size // chunk) & near_witness("rz", "wz", size // chunk)
    return requests.filter(F.col("release") | (tile & on("wx", width) & on("wz", height) & F.col("wy").between(0, layers - 1) & near & F.col("loaded")))


ADMITTED = "player long, tile int, event long"


def _admit(held: set[int], rows, cap: int) -> list[tuple[int, int]]:
    """Requests that are served, in order: a tile is served once until it is released or its sending failed; a closed session holds nothing."""
    out = []
    for row in rows:
        kind = row.kind
        if kind == "close":
            held.clear()
        elif kind in ("release", "failed"):
            held.discard(row.tile)
        elif row.tile not in held and len(held) < cap:
            held.add(row.tile)
            out.append((row.tile, row.event))
    return out


def _events(requests: DataFrame, tiles: int) -> DataFrame:
    """(player, tile, event, kind): kind from a column of that name (request, release, failed, close), or from ``release``."""
    kind = F.col("kind") if "kind" in requests.columns else F.when(F.col("release"), "release").otherwise("request")
    r = requests.select("player", "tile", "event", kind.alias("kind"))
    return r.filter(valid("tile", tiles) | (F.col("kind") == "close"))


def admit_batch(requests: DataFrame, tiles: int = 40, cap: int = HELD) -> DataFrame:
    """(player, tile, event) of requests that are served: a tile that a player holds is not sent again until released.

    Where a player could never hold more than ``cap`` tiles and no session ends, windows
    over (player, tile) do; else the events of a player are gone through in order.
    """
    r = _events(requests, tiles)
    if tiles <= cap and "kind" not in requests.columns:
        w = W.partitionBy("player", "tile").orderBy("event")
        r = r.withColumn("_p", F.lag("kind").over(w))
        return r.filter((F.col("kind") == "request") & (F.coalesce("_p", F.lit("release")) == "release")).select("player", "tile", "event")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *x) for x in _admit(set(), pdf.sort_values("event").itertuples(), cap)], columns=["player", "tile", "event"])

    return r.groupBy("player").applyInPandas(run, ADMITTED)


def admit_stream(requests: DataFrame, tiles: int = 40, cap: int = HELD) -> DataFrame:
    """As admit_batch, over a stream. State: the tiles each player holds."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = set(state.get[0]) if state.exists else set()
        out = _admit(held, pd.concat(list(frames)).sort_values("event").itertuples(), cap)
        if held:
            state.update((sorted(held),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["player", "tile", "event"])

    return _events(requests, tiles).groupBy("player").applyInPandasWithState(step, ADMITTED, "held array<int>", "append", GroupStateTimeout.NoTimeout)


def drain(admitted: DataFrame, per_tick: int = PER_TICK, still: DataFrame | None = None) -> DataFrame:
    """The tick in which each request of a player is sent, first come first served.

    ``still(player, tile)``: what the players hold and can see when it is sent; a request for
    anything else is passed over and takes no place in a tick.
    """
    if still is not None:
        admitted = admitted.join(still.select("player", "tile").distinct(), ["player", "tile"], "left_semi")
    w = W.partitionBy("player").orderBy("event")
    return admitted.withColumn("tick", F.floor((F.row_number().over(w) - 1) / per_tick))


def _in_flight(rows, per_tick: int, most: int) -> list[tuple]:
    """(tile, tick) of each request sent: at most ``per_tick`` in a tick, none while ``most`` transfers are under way; first asked, first sent."""
    waiting, flying, out = [], set(), []
    asked, done = {}, {}
    for row in rows:
        (asked if row.kind == "ask" else done).setdefault(row.tick, []).append(row.tile)
    tick, last = min([*asked, *done], default=0), max([*asked, *done], default=-1)
    known: set[int] = set()
    while tick <= last or (waiting and len(flying) < most):
        flying -= set(done.get(tick, ()))
        for t in asked.get(tick, ()):
            if t not in known:
                known.add(t)
                waiting.append(t)
        for _ in range(min(per_tick, most - len(flying), len(waiting))):
            t = waiting.pop(0)
            flying.add(t)
            out.append((t, tick))
        tick += 1
    return out


def request_ticks(events: DataFrame, per_tick: int = PER_TICK, most: int = IN_FLIGHT) -> DataFrame:
    """(player, tile, tick) a client sends its requests in: events(player, tile, tick, kind ask|done, n), ``n`` their order."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *x) for x in _in_flight(pdf.sort_values(["tick", "n"]).itertuples(), per_tick, most)], columns=["player", "tile", "tick"])

    return events.groupBy("player").applyInPandas(run, "player long, tile int, tick long")


def chunk(tiles: DataFrame, size: int = PACKET) -> DataFrame:
    """(tile, idx, cnt, compressed_length, raw_length, data) of tiles(tile, payload): gzip, then packets."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                packed = gzip.compress(r["payload"], mtime=0)
                n = max(1, -(-len(packed) // size))
                rows += [(r["tile"], i, n, len(packed), len(r["payload"]), packed[i * size : (i + 1) * size]) for i in range(n)]
            types = [pa.int32()] * 5 + [pa.binary()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["tile", "idx", "cnt", "compressed_length", "raw_length", "data"])

    return tiles.select(F.col("tile").cast("int").alias("tile"), "payload").mapInArrow(run, "tile int, idx int, cnt int, compressed_length int, raw_length int, data binary")


def packet_ok(size: int = PACKET):
    """Packets that can be what they say: the count follows from the length, and so does the length of each part."""
    part = F.least(F.lit(size), F.col("compressed_length") - F.col("idx") * size)
    return (F.col("compressed_length") > 0) & (F.col("raw_length") > 0) & (F.col("cnt") == F.ceil(F.col("compressed_length") / size)) & F.col("idx").between(0, F.col("cnt") - 1) & (F.octet_length("data") == part)


def unpack(packed: bytes, size: int) -> bytes | None:
    """What was packed, if it is whole and of the size told."""
    try:
        raw = gzip.decompress(packed)
    except (OSError, EOFError, zlib.error):
        return None
    return raw if len(raw) == size else None


def reassemble(packets: DataFrame, size: int = PACKET) -> DataFrame:
    """(tile, payload): whole tiles of packets; repeated packets count once, tiles that lack one or fail their length give no row."""

    def join(key: tuple, t: pa.Table) -> pa.Table:
        parts = {r["idx"]: r for r in t.to_pylist()}
        first = next(iter(parts.values()))
        none = pa.table({"tile": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
        if any((r["cnt"], r["compressed_length"], r["raw_length"]) != (first["cnt"], first["compressed_length"], first["raw_length"]) for r in parts.values()) or len(parts) != first["cnt"]:
            return none
        packed = b"".join(parts[i]["data"] for i in sorted(parts))
        raw = unpack(packed, first["raw_length"]) if len(packed) == first["compressed_length"] else None
        return none if raw is None else pa.table({"tile": pa.array([first["tile"]], pa.int32()), "payload": pa.array([raw], pa.binary())})

    return packets.filter(packet_ok(size)).groupBy("tile").applyInArrow(join, "tile int, payload binary")


def assemble_stream(packets: DataFrame, timeout_ms: int = TIMEOUT_MS, size: int = PACKET) -> DataFrame:
    """(tile, payload, state) over a stream: 'done' with the payload; 'requeue' after ``timeout_ms`` without the missing packets, where packets of a tile disagree, and where what arrived is damaged.

    A tile that is done is remembered for ``timeout_ms``, so that packets that come again open nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        say = lambda *rows: pd.DataFrame([(key[0], *r) for r in rows], columns=["tile", "payload", "state"])
        meta, idx, data = state.get if state.exists else ([], [], [])
        if state.hasTimedOut:
            state.remove()
            yield say((None, "requeue")) if meta[0] else say()
            return
        meta, parts = list(meta), dict(zip(idx, data, strict=True))
        if meta and not meta[0]:  # done before
            state.setTimeoutDuration(timeout_ms)
            yield say()
            return
        for row in pd.concat(list(frames)).itertuples():
            own = [row.cnt, row.compressed_length, row.raw_length]
            if meta and own != meta:
                state.remove()
                yield say((None, "requeue"))
                return
            meta = own
            parts.setdefault(row.idx, row.data)
        if len(parts) == meta[0]:
            raw = unpack(b"".join(parts[i] for i in sorted(parts)), meta[2])
            if raw is None:
                state.remove()
                yield say((None, "requeue"))
                return
            state.update(([0, 0, 0], [], []))
            state.setTimeoutDuration(timeout_ms)
            yield say((raw, "done"))
            return
        state.update((meta, list(parts), list(parts.values())))
        state.setTimeoutDuration(timeout_ms)
        yield say()

    return packets.filter(packet_ok(size)).groupBy("tile").applyInPandasWithState(step, "tile int, payload binary, state string", "meta array<int>, idx array<int>, data array<binary>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def desired(loaded: DataFrame, cap: int = HELD) -> DataFrame:
    """(player, rx, rz) wanted: regions around the loaded ones, the nearest to the player first, at most ``cap``.

    loaded(player, rx, rz, px, pz): loaded regions and the player's region. The cap is the feature.
    """
    near = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    d = loaded.withColumn("_o", near).select("player", (F.col("rx") + F.col("_o.a")).alias("rx"), (F.col("rz") + F.col("_o.b")).alias("rz"), "px", "pz").distinct()
    far = (F.col("rx") - F.col("px")) * (F.col("rx") - F.col("px")) + (F.col("rz") - F.col("pz")) * (F.col("rz") - F.col("pz"))
    w = W.partitionBy("player").orderBy(far, "rx", "rz")
    return d.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).select("player", "rx", "rz")


def reconcile(want: DataFrame, held: DataFrame) -> DataFrame:
    """(player, rx, rz, act): what to request and what to release."""
    key = ["player", "rx", "rz"]
    a = want.join(held, key, "left_anti").withColumn("act", F.lit("request"))
    return a.unionByName(held.join(want, key, "left_anti").withColumn("act", F.lit("release")))


def solicited(packets: DataFrame, requested: DataFrame) -> DataFrame:
    """Packets of tiles that were asked for; others are dropped."""
    return packets.join(requested.select("tile").distinct(), "tile", "left_semi")


def loaded_regions(events: DataFrame, width: int, height: int, layers: int, chunk: int = 32, size: int = 512) -> DataFrame:
    """(player, rx, rz, wx, wy, wz): regions loaded after events(player, event, kind, cx, cy, cz), with the chunk last seen in each.

    kind 'chunk' is a chunk that came or the player's own chunk, 'unload' a region (rx, rz in cx,
    cz) that went, 'leave' the end of a session: what was before it counts no more. Chunks off the
    map say nothing.
    """
    e = events.withColumn("_end", F.max(F.when(F.col("kind") == "leave", F.col("event"))).over(W.partitionBy("player")))
    e = e.filter(F.col("_end").isNull() | (F.col("event") > F.col("_end")))
    side = lambda c, n: (F.col(c) >= 0) & (F.col(c) * chunk < n)
    came = e.filter((F.col("kind") == "chunk") & side("cx", width) & side("cz", height) & F.col("cy").between(0, layers - 1))
    per = size // chunk
    at = lambda c: F.floor(F.col(c) / per).cast("int")
    came = came.select("player", "event", at("cx").alias("rx"), at("cz").alias("rz"), F.struct("cx", "cy", "cz").alias("_w"))
    went = e.filter("kind = 'unload'").select("player", "event", F.col("cx").alias("rx"), F.col("cz").alias("rz"), F.lit(None).cast(came.schema["_w"].dataType).alias("_w"))
    last = came.unionByName(went).groupBy("player", "rx", "rz").agg(F.max_by("_w", "event").alias("_w"))
    return last.filter("_w IS NOT NULL").select("player", "rx", "rz", F.col("_w.cx").alias("wx"), F.col("_w.cy").alias("wy"), F.col("_w.cz").alias("wz"))


def stale_chunks(arrived: DataFrame, loaded: DataFrame, chunk: int = 32, size: int = 512) -> DataFrame:
    """(player, cx, cy, cz) to be drawn again: the loaded(player, cx, cy, cz) chunks of tiles that arrived(player, rx, rz)."""
    per = size // chunk
    at = lambda c: F.floor(F.col(c) / per).cast("int")
    keyed = loaded.withColumn("rx", at("cx")).withColumn("rz", at("cz"))
    return keyed.join(arrived.select("player", "rx", "rz").distinct(), ["player", "rx", "rz"], "left_semi").select("player", "cx", "cy", "cz")


def recent(uses: DataFrame, owner: str, key: list[str], order: str, keep: int) -> DataFrame:
    """(owner, key..) that a store of ``keep`` entries holds after all uses: those used last. The size of the store is the feature."""
    last = uses.groupBy(owner, *key).agg(F.max(order).alias("_last"))
    return last.withColumn("_n", F.row_number().over(W.partitionBy(owner).orderBy(F.desc("_last"), *key))).filter(F.col("_n") <= keep).select(owner, *key)


def store_stream(uses: DataFrame, keep: int = 64) -> DataFrame:
    """(owner, key, event, act) over a stream of uses(owner, key, event, gone boolean): 'load' where a key is used that the store lacks, 'evict' for the one it makes room with, 'drop' where a held key is gone."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict.fromkeys(state.get[0]) if state.exists else {}
        out = []
        for row in pd.concat(list(frames)).sort_values("event").itertuples():
            have = row.key in held
            held.pop(row.key, None)
            if row.gone:
                if have:
                    out.append((key[0], row.key, row.event, "drop"))
                continue
            if not have:
                out.append((key[0], row.key, row.event, "load"))
                if len(held) >= keep:
                    oldest = next(iter(held))
                    del held[oldest]
                    out.append((key[0], oldest, row.event, "evict"))
            held[row.key] = None
        state.update((list(held),))
        yield pd.DataFrame(out, columns=["owner", "key", "event", "act"])

    return uses.groupBy("owner").applyInPandasWithState(step, "owner long, key long, event long, act string", "held array<bigint>", "append", GroupStateTimeout.NoTimeout)
