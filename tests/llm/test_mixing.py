"""Draws of a mixture by going through blocks and documents one by one."""

import math
import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from terraspark.llm import mixing
from tests.llm.test_text_operators import frame, prose


def h(*parts):
    """Spark's xxhash64 of several values: each with the hash of those before as its seed."""
    seed = 42
    for p in parts:
        if p is None:
            continue
        seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else int(p).to_bytes(8 if not isinstance(p, Small) else 4, "little", signed=True), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


class Small(int):
    """An int of 32 bits."""


@pytest.mark.parametrize("stretch", [4096, 2])
def test_draws_by_hand(spark, monkeypatch, stretch):
    monkeypatch.setattr(mixing, "STRETCH", stretch)
    rng = random.Random(stretch)
    n = 400
    # one source holds two thirds of all rows
    sources = ["hot"] * (2 * n // 3) + [rng.choice(["a", "b", None]) for _ in range(n - 2 * n // 3)]
    texts = [prose(rng, rng.randint(0, 40)) for _ in range(n - 2)] + [None, ""]
    docs = frame(spark, texts, sources=sources)
    got = sorted((r["doc_id"], r["epoch"], r["block"], r["tokens"]) for r in mixing.mix(spark, docs, entropy_share=0.9, max_repeats=3.0, block_tokens=200, seed=11).collect())
    key = lambda s: "none" if s is None else "=" + s
    size = [-(-len((t or "").encode()) // 4) for t in texts]
    total = defaultdict(int)
    for s, k in zip(sources, size):
        total[key(s)] += k
    every = sum(total.values())
    m = mixing.fit_mixture(spark.createDataFrame(list(total.items()), "key string, tokens long"), None, 0.9, 3.0)
    want = []
    for s, t in total.items():
        budget = math.floor(math.exp(math.log(t / every) * m.exponent - m.log_norm) * every)
        blocks = max(1, math.ceil(t / 200))
        inside = defaultdict(list)
        for i, (src, text) in enumerate(zip(sources, texts)):
            if key(src) == s:
                inside[h(i, text, Small(11)) % blocks].append((i, h(i, text, Small(11)), size[i]))
        before = 0
        for epoch in range(max(1, math.ceil(budget / t))):
            for b in sorted(inside, key=lambda b: (h(s, epoch, b, Small(11)), b)):
                if before >= budget:
                    break
                whole = before + sum(k for *_, k in inside[b]) <= budget
                run = before
                for i, hi, k in sorted(inside[b], key=lambda d: (h(d[1], epoch, Small(12)), d[0], d[1])):
                    run += k
                    if whole or run <= budget:
                        want.append((i, epoch, b, k))
                before += sum(k for *_, k in inside[b])
    assert got == sorted(want)


def test_hash_is_that_of_the_engine(spark):
    r = spark.range(1).select(F.xxhash64(F.lit("x"), F.lit(5).cast("long"), F.lit(11)).alias("a"), F.xxhash64(F.lit(None).cast("string"), F.lit(3)).alias("b")).first()
    assert r["a"] == h("x", 5, Small(11)) and r["b"] == h(None, Small(3))
