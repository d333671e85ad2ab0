"""A player's session as one stateful stream: admission, a queue drained at a limited rate, checks before sending, expiry.

Events of a player change its state: tiles that are served, a queue of those not sent
yet, tiles whose witness is out of sight. Timers in processing time drain the queue, at
most ``per_tick`` tiles a tick, first asked, first sent; what was released or lost from
sight meanwhile is passed over. A tile that is sent and not confirmed in time is released.
State is keyed by player and bounded by ``cap`` tiles each, and lives in the state store,
so a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terraspark.streaming.tile_sync import HELD, PER_TICK, TIMEOUT_MS, valid

TICK_MS = 50
SENT = "player long, tile int, event long, act string"
WAITING, SENDING, HOLDS = 0, 1, 2


class Session(StatefulProcessor):
    """Events (tile, event, kind): request, release, failed, done, hidden, seen, close."""

    def __init__(self, cap: int = HELD, per_tick: int = PER_TICK, tick_ms: int = TICK_MS, timeout_ms: int = TIMEOUT_MS):
        self.cap, self.per_tick, self.tick_ms, self.timeout_ms = cap, per_tick, tick_ms, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.served = handle.getMapState("served", "tile int", "event long, state int, due long")
        self.hidden = handle.getMapState("hidden", "tile int", "event long")
        self.queue = handle.getListState("queue", "tile int, event long")
        self.next_tick = handle.getValueState("next_tick", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: r["event"]):
            tile = (r["tile"],)
            if r["kind"] == "close":
                for state in (self.served, self.hidden, self.queue):
                    state.clear()
            elif r["kind"] in ("release", "failed"):
                self.served.removeKey(tile)
            elif r["kind"] == "hidden":
                self.hidden.updateValue(tile, (r["event"],))
            elif r["kind"] == "seen":
                self.hidden.removeKey(tile)
            elif r["kind"] == "done":
                if self.served.containsKey(tile):
                    event, state, _ = self.served.getValue(tile)
                    if state == SENDING:
                        self.served.updateValue(tile, (event, HOLDS, 0))
            elif not self.served.containsKey(tile) and not self.hidden.containsKey(tile) and sum(1 for _ in self.served.keys()) < self.cap:
                self.served.updateValue(tile, (r["event"], WAITING, 0))
                self.queue.appendValue((r["tile"], r["event"]))
        self._again(timerValues.getCurrentProcessingTimeInMs())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        late = [(k[0], v[0]) for k, v in self.served.iterator() if v[1] == SENDING and v[2] <= now]
        for tile, event in sorted(late, key=lambda p: p[1]):
            self.served.removeKey((tile,))
            yield Row(player=key[0], tile=tile, event=event, act="expire")
        if self._tick() <= now:
            waiting, sent = [tuple(v) for v in self.queue.get()], 0
            while waiting and sent < self.per_tick:
                tile, event = waiting.pop(0)
                found = self.served.getValue((tile,)) if self.served.containsKey((tile,)) else None
                if found is None or found[0] != event:
                    continue  # released meanwhile, or asked for anew
                if self.hidden.containsKey((tile,)):
                    self.served.removeKey((tile,))
                    continue
                self.served.updateValue((tile,), (event, SENDING, now + self.timeout_ms))
                sent += 1
                yield Row(player=key[0], tile=tile, event=event, act="send")
            self.queue.put(waiting) if waiting else self.queue.clear()
            self.next_tick.update((now + self.tick_ms,))
        self._again(now)

    def _tick(self) -> int:
        return self.next_tick.get()[0] if self.next_tick.exists() else 0

    def _again(self, now: int) -> None:
        """One timer: for the next tick if tiles wait, or for the first that is due."""
        times = [v[2] for _, v in self.served.iterator() if v[1] == SENDING]
        if self.queue.exists():
            times.append(max(self._tick(), now + 1))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if times:
            self.handle.registerTimer(max(min(times), now + 1))

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Timers and lists of state need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def session_stream(events: DataFrame, tiles: int = 40, cap: int = HELD, per_tick: int = PER_TICK, tick_ms: int = TICK_MS, timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """(player, tile, event, act send|expire) of a stream of events(player, tile, event, kind)."""
    use_state_store(events.sparkSession)
    good = events.filter(valid("tile", tiles) | (F.col("kind") == "close")).select("player", "tile", "event", "kind")
    return good.groupBy("player").transformWithState(Session(cap, per_tick, tick_ms, timeout_ms), SENT, "Append", "ProcessingTime")
