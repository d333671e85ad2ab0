"""The tile protocol as streams and as batches, against its rules gone through one event at a time."""

import gzip
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from terraspark.streaming import tile_sync as Y


def run(spark, tmp_path, df, make, name, by="event"):
    """Rows of a stream over ``df`` in two files, one after the other."""
    src = str(tmp_path / name)
    half = df.agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {by})")).first()[0]
    for part in (df.filter(F.col(by) <= half), df.filter(F.col(by) > half)):
        part.coalesce(1).write.mode("append").parquet(src)
    stream = make(spark.readStream.option("maxFilesPerTrigger", 1).schema(df.schema).parquet(src))
    # state with a processing-time timeout asks for batches without end: stopped once both files are through
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    seen, began = 0, time.time()
    while seen < df.count() and time.time() - began < 60 and q.isActive:
        time.sleep(0.5)
        seen = sum(x["numInputRows"] for x in q.recentProgress)
    q.stop()
    return spark.table(name)


def test_admission_with_cap_and_sessions(spark, tmp_path):
    rng = random.Random(4)
    kinds = ["request"] * 8 + ["release", "failed", "close"]
    rows = [(rng.randrange(4), rng.randrange(-1, 12), rng.choice(kinds), i) for i in range(400)]
    df = spark.createDataFrame(rows, "player long, tile int, kind string, event long")
    held, want = {}, []
    for player, tile, kind, event in rows:
        mine = held.setdefault(player, set())
        if kind == "close":
            mine.clear()
        elif not 0 <= tile < 12:
            continue
        elif kind != "request":
            mine.discard(tile)
        elif tile not in mine and len(mine) < 5:
            mine.add(tile)
            want.append((player, tile, event))
    assert sorted(map(tuple, Y.admit_batch(df, 12, 5).collect())) == sorted(want)
    assert sorted(map(tuple, run(spark, tmp_path, df, lambda s: Y.admit_stream(s, 12, 5), "admit_cap").collect())) == sorted(want)


def test_batch_admission_has_the_cap(spark):
    df = spark.createDataFrame([(1, t, False, t) for t in range(300)], "player long, tile int, release boolean, event long")
    assert Y.admit_batch(df, 300).count() == 256 and Y.admit_batch(df, 300, 300).count() == 300


def packets(spark, extra=()):
    noise = random.Random(1).randbytes(2500)
    tiles = spark.createDataFrame([(1, bytearray(noise)), (2, bytearray(b"a" * 100)), (3, bytearray(noise[::-1]))], "tile int, payload binary")
    return tiles, Y.chunk(tiles, 700)


def test_assembly(spark, tmp_path):
    tiles, p = packets(spark)
    bad = p.filter("tile = 3").withColumn("data", F.when(F.col("idx") == 0, F.overlay("data", F.lit(b"\xff" * 40), F.lit(20))).otherwise(F.col("data")))
    df = p.filter("tile < 3").unionAll(p.filter("tile = 1")).unionByName(bad).withColumn("event", F.monotonically_increasing_id())
    got = run(spark, tmp_path, df.coalesce(1).withColumn("event", F.monotonically_increasing_id()), lambda s: Y.assemble_stream(s.drop("event"), size=700), "assembled").collect()
    assert sorted((r["tile"], r["state"]) for r in got) == [(1, "done"), (2, "done"), (3, "requeue")]
    back = {r["tile"]: bytes(r["payload"]) for r in got if r["payload"]}
    assert back == {r["tile"]: bytes(r["payload"]) for r in tiles.filter("tile < 3").collect()}
    assert {r["tile"] for r in Y.reassemble(df.drop("event"), 700).collect()} == {1, 2}


def test_packets_that_disagree_are_asked_for_again(spark, tmp_path):
    _, p = packets(spark)
    odd = p.filter("tile = 1 AND idx = 1").withColumn("raw_length", F.lit(9))
    df = p.filter("tile = 1 AND idx < 1").unionByName(odd).withColumn("event", F.col("idx").cast("long"))
    got = run(spark, tmp_path, df, lambda s: Y.assemble_stream(s.drop("event"), size=700), "disagree").collect()
    assert [(r["tile"], r["state"]) for r in got] == [(1, "requeue")]


def test_damaged_payloads_give_none():
    whole = gzip.compress(b"abc" * 50)
    assert Y.unpack(whole, 150) == b"abc" * 50
    assert Y.unpack(whole, 149) is None and Y.unpack(whole[:-9], 150) is None and Y.unpack(b"\0" * 30, 3) is None


def test_in_flight_by_simulation(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.randrange(30), "ask", t) for t in range(40)] + [(1, t, rng.randrange(20, 70), "done", t) for t in range(40)]
    df = spark.createDataFrame(rows, "player long, tile int, tick long, kind string, n long")
    got = {r["tile"]: r["tick"] for r in Y.request_ticks(df, 2, 5).collect()}
    asked = {r[1]: r[2] for r in rows if r[3] == "ask"}
    done = {}
    for r in rows:
        if r[3] == "done":
            done.setdefault(r[2], set()).add(r[1])
    waiting, flying, want = [], set(), {}
    for tick in range(0, 200):
        flying -= done.get(tick, set())
        waiting += sorted(t for t, a in asked.items() if a == tick)
        sent = 0
        while waiting and sent < 2 and len(flying) < 5:
            t = waiting.pop(0)
            flying.add(t)
            want[t] = tick
            sent += 1
    assert got == {t: k for t, k in want.items() if t in got} and len(got) >= 10
    assert all(len([1 for v in got.values() if v == k]) <= 2 for k in got.values())


def test_store(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randrange(2), rng.randrange(7), i, rng.random() < 0.1) for i in range(200)]
    df = spark.createDataFrame(rows, "owner long, key long, event long, gone boolean")
    held, want = {}, []
    for owner, key, event, gone in rows:
        mine = held.setdefault(owner, [])
        have = key in mine
        if have:
            mine.remove(key)
        if gone:
            want += [(owner, key, event, "drop")] if have else []
            continue
        if not have:
            want.append((owner, key, event, "load"))
            if len(mine) >= 4:
                want.append((owner, mine.pop(0), event, "evict"))
        mine.append(key)
    got = run(spark, tmp_path, df, lambda s: Y.store_stream(s, 4), "store").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    stays = df.filter("NOT gone")
    last = {(r["owner"], r["key"]) for r in Y.recent(stays, "owner", ["key"], "event", 4).collect()}
    frame = pd.DataFrame(rows, columns=["owner", "key", "event", "gone"]).query("~gone").groupby(["owner", "key"]).event.max().reset_index()
    assert last == {(r.owner, r.key) for o in (0, 1) for r in frame[frame.owner == o].nlargest(4, "event").itertuples()}
