"""Token counts of texts whose pre-tokens are long: what reaches the driver is bounded, counts are the library's."""

import base64
import random

from pyspark.sql import functions as F

from terraspark.llm import tokens as T
from tests.llm.test_text_operators import frame


def test_long_pre_tokens(spark):
    rng = random.Random(3)
    word = lambda n: base64.b64encode(rng.randbytes(n)).decode()
    texts = [word(4000) for _ in range(20)] + ["a b c " + word(900) + " a\n" + word(36) + "\n" + "x" * 48 + " " + "x" * 47, None, "", " " * 500, "\n" * 60]
    texts += [texts[0], texts[1] + " " + texts[2] + " " + texts[0]]
    p = T.PieceCounts(T._file("piece_bpe_32k.model"))
    want = sorted(len(p.encode(t or "")) for t in texts)
    docs = frame(spark, texts).repartition(3)
    for head in (0, 5, 200_000):
        assert sorted(r["n_tokens"] for r in T.count_tokens(docs, head=head).collect()) == want
    table = T.piece_table(docs)
    often, every = T.frequent(table, 200_000)
    assert every == table.count() and max(map(len, often)) <= T.LONG and len(often) < every
    assert sum(map(len, often)) < 1000 and table.agg(F.max(F.length("t"))).first()[0] <= T.LONG


def test_counting_remembers_nothing():
    p = T.PieceCounts(T._file("piece_bpe_32k.model"))
    assert p.count("word") == len(p.encode("word")) and not dict(p)
    assert p["word"] == p.count("word") and list(p) == ["word"]
