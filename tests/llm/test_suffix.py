"""Suffix arrays, common prefixes and anchors by their definitions; repeated passages of odd texts by brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from terraspark.llm import suffix as S
from tests.llm.test_text_operators import cut_by_hand, frame


def pieces(rows):
    a, size = np.frombuffer(b"".join(rows), np.uint8), np.array([len(r) for r in rows])
    begin = np.cumsum(size) - size
    which = np.repeat(np.arange(len(rows)), size)
    return a, begin, size, which, (begin + size)[which]


def test_suffix_array_by_definition():
    rng = random.Random(1)
    for _ in range(200):
        rows = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 8))]
        rows += rows[:2]
        a, begin, _, which, end = pieces(rows)
        klass = np.array([rng.randint(0, 1) for _ in rows])[which] * 50 + np.arange(len(a)) - begin[which]
        got = S.suffix_array(S.words_at(a), klass, end).tolist()
        assert got == sorted(range(len(a)), key=lambda i: (klass[i], bytes(a[i : end[i]]), i))


def test_repeats_in_groups_by_definition():
    rng = random.Random(2)
    for _ in range(80):
        base = [bytes(rng.choice(b"abcd") for _ in range(S.PLACES)) for _ in range(3)]
        rows, group, place = [], [], []
        for g in range(rng.randint(1, 5)):
            for _ in range(rng.choice([2, 3, 5, 7, 12, 30])):
                x = bytearray(rng.choice(base))
                for _ in range(rng.randint(0, 2)):
                    x[rng.randrange(len(x))] = rng.choice(b"abcd\0")
                lo = rng.randint(0, S.BACK)
                rows.append(bytes(x[lo : rng.randint(lo, S.BACK) + S.LENGTH]))
                group.append(g)
                place.append(lo)
        a, begin, size, *_ = pieces(rows)
        count = Counter((g, p + k, r[k : k + S.LENGTH]) for r, g, p in zip(rows, group, place) for k in range(len(r) - S.LENGTH + 1))
        want = np.zeros(len(a), bool)
        for r, g, p, b in zip(rows, group, place, begin):
            for k in range(len(r) - S.LENGTH + 1):
                want[b + k] = count[g, p + k, r[k : k + S.LENGTH]] > 1
        for few in (0, 1, 6, 100):
            assert (S.repeats(a, begin, size, np.array(place), np.array(group), few) == want).all()


@pytest.mark.parametrize("piece", [1 << 20, 100, 37])
def test_anchors_stand_for_every_string_once(piece):
    rng = random.Random(piece)
    for n in (0, 199, 200, 201, 500, 5000):
        b = bytes(rng.choice(b"abcdefgh") for _ in range(n))
        pos, h, first, last = S.anchors(b, piece)
        assert [w for x, y in zip(first, last) for w in range(x, y + 1)] == list(range(max(0, n - 199)))
        assert all((x == y).all() for x, y in zip(S.anchors(b), (pos, h, first, last)))
        assert all((x == y).all() for x, y in zip(S.unpacked(S.packed(pos, first, last)), (pos, first, last)))


def test_long_texts(spark):
    rng = random.Random(4)
    line = lambda n: "".join(rng.choice("abcdefgh ij") for _ in range(n))
    passage = line(900)
    long = line(30000) + passage + line(20000) + passage[100:600] + line(9000) + "ab" * 3000
    texts = [long, line(500) + passage + line(100), "x" * 199, "x" * 200, None, long[:7000]]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in S.remove_repeats(spark, frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == cut_by_hand([(t or "").encode() for t in texts])


def test_one_anchor_with_many_surroundings(spark):
    # lines with a common lead in one text, and a passage under many different surroundings
    rng = random.Random(8)
    line = lambda n: "".join(rng.choice("abcdefgh ij") for _ in range(n))
    lead, passage = line(60), line(230)
    log = "".join(lead + line(90) for _ in range(400))
    texts = [log, log[:20000] + "!" + log[20500:], *(line(80) + passage + line(80) for _ in range(150)), *(lead + line(200) for _ in range(50))]
    for shard in (3, 20):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in S.remove_repeats(spark, frame(spark, texts), shard=shard).collect()}
        assert [got[i] for i in range(len(texts))] == cut_by_hand([t.encode() for t in texts])


def test_shard_hands_out_one_of_equal_digests():
    rng = random.Random(9)
    passage = bytes(rng.choice(b"abcd") for _ in range(S.PLACES))
    n = 300
    rows = {"h": np.zeros(n, np.int64), "salt": np.repeat([0, 1], n // 2), "salts": np.full(n, 2), "k1": np.arange(n), "k2": np.zeros(n, np.int64), "at": S.packed(np.full(n, 500), np.full(n, 500 - S.BACK), np.full(n, 500))}
    runs = [b for b in S._sort_shard(rows, [passage] * n, 4) if b.column(0)[0].as_py() == 1]
    digests = np.concatenate([np.frombuffer(d.as_py(), S._DIGEST) for b in runs for d in b.column(7)])
    assert len(digests) == 2 * (S.BACK + 1) and len(np.unique(digests)) == S.BACK + 1


def test_clashing_columns(spark):
    rows = [(1, "a" * 500, 1, 2, "k"), (1, "a" * 500, 1, 2, "k"), (None, None, 1, 2, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 long, at long, spans string")
    assert sorted((r["n_bytes"], r["n_removed"]) for r in S.remove_repeats(spark, df).collect()) == [(0, 0), (500, 500), (500, 500)]
