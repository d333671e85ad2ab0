"""Neighbours in order where one id, or none, holds most rows."""

import hashlib
import random

from pyspark.sql import functions as F

from terraspark.llm import bottomk
from tests.llm.test_text_operators import frame, prose


def test_fingerprints_of_many_rows_of_one_id(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 12)) for _ in range(160)] + ["same text twice over"] * 6
    ids = [5] * 80 + [None] * 50 + list(range(100, 136))
    docs = frame(spark, texts, ids)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(hashed, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"], r["text"]))
    want = []
    for k, r in enumerate(order):
        t, nxt = r["text"], order[(k + 1) % len(order)]["text"]
        want.append((str(r["doc_id"]), hashlib.sha256((t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]).encode()).hexdigest()))
    for target in (None, 10):
        got = bottomk.fingerprint_neighbours(spark, docs, target=target).collect()
        assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got) == sorted(want)
    dealt, keys = bottomk.in_order(spark, docs, target=10)
    most = dealt.filter("NOT _ghost").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    assert most <= 20
