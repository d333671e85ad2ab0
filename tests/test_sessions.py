"""The session stream against a replay by hand, over a restart from the checkpoint."""

import json
import random
import time

from terraspark.streaming import sessions as S


def replay(batches, cap):
    """Events of a batch are taken in order, then the queue is drained; nothing expires."""
    sent, state = [], {}
    for batch in batches:
        for p, tile, event, kind in sorted(batch, key=lambda r: r[2]):
            served, hidden, queue = state.setdefault(p, ({}, set(), []))
            if not (0 <= tile < 40 or kind == "close"):
                continue
            if kind == "close":
                served.clear(), hidden.clear(), queue.clear()
            elif kind in ("release", "failed"):
                served.pop(tile, None)
            elif kind == "hidden":
                hidden.add(tile)
            elif kind == "seen":
                hidden.discard(tile)
            elif kind == "request" and tile not in served and tile not in hidden and len(served) < cap:
                served[tile] = event
                queue.append((tile, event))
        for p, (served, hidden, queue) in state.items():
            for tile, event in queue:
                if served.get(tile) == event:
                    if tile in hidden:
                        del served[tile]
                    else:
                        sent.append((p, tile, event))
            queue.clear()
    return sent


def drained(query, path, spark, want, seconds=120):
    """Waits until the sink holds ``want`` rows, or time is over."""
    end, rows = time.time() + seconds, []
    while time.time() < end and len(rows) < want:
        time.sleep(1)
        assert query.exception() is None, query.exception()
        try:
            rows = [tuple(r) for r in spark.read.schema(S.SENT).parquet(path).collect()]
        except Exception:  # nothing written yet
            rows = []
    return rows


def test_stream_equals_replay_after_a_restart(spark, tmp_path):
    rng = random.Random(4)
    kinds = ["request"] * 6 + ["release", "hidden", "seen", "done", "failed"]
    n, batches = 0, []
    for size in (60, 60):
        batch = []
        for _ in range(size):
            n += 1
            batch.append((rng.randint(1, 3), rng.randint(-1, 41), n, rng.choice(kinds)))
        batches.append(batch)
    batches[1].append((2, -1, n + 1, "close"))
    batches[1].append((2, 7, n + 2, "request"))
    inp, out, check = (tmp_path / d for d in ("in", "out", "check"))
    inp.mkdir()
    want = [replay(batches[:k], 12) for k in (1, 2)]
    assert len(want[1]) > len(want[0]) > 10
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for k in (0, 1):
            (inp / f".b{k}").write_text("\n".join(json.dumps(dict(zip(("player", "tile", "event", "kind"), r))) for r in batches[k]))
            (inp / f".b{k}").rename(inp / f"b{k}.json")
            events = spark.readStream.schema("player long, tile int, event long, kind string").json(str(inp))
            stream = S.session_stream(events, cap=12, tick_ms=1, timeout_ms=10_000_000)
            q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).start()
            rows = drained(q, str(out), spark, len(want[k]))
            q.stop()
            assert sorted(r[:3] for r in rows) == sorted(want[k]) and {r[3] for r in rows} == {"send"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_unconfirmed_tiles_expire(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"player": 1, "tile": t, "event": t, "kind": "request"}) for t in range(3)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        events = spark.readStream.schema("player long, tile int, event long, kind string").json(str(tmp_path / "in"))
        q = S.session_stream(events, tick_ms=1, timeout_ms=1500).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        rows = drained(q, str(tmp_path / "out"), spark, 6)
        q.stop()
        assert sorted(rows) == sorted((1, t, t, act) for t in range(3) for act in ("send", "expire"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
