"""Spelling variants against all pairs by brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from terraspark.llm.spelling import drop_one, group_variants, neighbours, roots

SCHEMA = "doc_id long, text string, word string, n int, form string"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    out, form = {}, {}
    for w in n:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = len(close)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, n[w], out[w], form[w], form[w] and n[form[w]], root)
    return sorted(out.values())


def found(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


@pytest.mark.parametrize("letters,seed", [("abc", 1), ("abàÿ", 2), ("aAÀ×", 3), ("abcdefgh", 4)])
def test_against_all_pairs(spark, letters, seed):
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(120)]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, r.choice([" ", "-", "9", "漢", "\n"]).join(r.choices(words, weights, k=r.randint(0, 120)))) for i in range(60)]
    rows += [(None, "aaaaa aaaaa"), (3, None), (3, ""), rows[0], rows[0], (9, "aaaaab " * 5000)]
    docs = spark.createDataFrame([(*x, "w", 1, "f") for x in rows], SCHEMA).repartition(3)
    assert found(group_variants(docs, filter_bits=1 << 15)) == expected(rows)


def test_a_filter_that_is_full_changes_nothing(spark):
    rows = [(i, "house houses hous housed mouse mouses blouse " * 3) for i in range(20)]
    docs = spark.createDataFrame([(*x, "w", 1, "f") for x in rows], SCHEMA)
    assert found(group_variants(docs, filter_bits=1)) == found(group_variants(docs)) == expected(rows)


def test_neighbourhood_is_whole_and_distinct():
    for word, letters in (("aabca", "abc"), ("a", "ab"), ("éééa", "éa")):
        got = [s for _, part in neighbours(np.frombuffer(word.encode("latin-1"), np.uint8)[None], np.array([ord(c) for c in letters], np.uint8), lambda h: np.ones(len(h), bool)) for s in part]
        n = len(word)
        want = {word[:i] + word[i + 1 :] for i in range(n)} | {word[:i] + c + word[i + 1 :] for i in range(n) for c in letters} | {word[:i] + c + word[i:] for i in range(n + 1) for c in letters}
        assert len(got) == len(set(got)) and set(got) == want - {word}


def test_no_words_and_drops(spark):
    docs = spark.createDataFrame([(1, None, "w", 1, "f"), (2, "a b c 12", "w", 1, "f")], SCHEMA)
    assert group_variants(docs).collect() == [] and group_variants(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        group_variants(docs, ratio=1)
    changed = [w for w in (f"word{i}" for i in range(2000)) if drop_one("7", w) != w]
    assert 5 < len(changed) < 60 and all(len(drop_one("7", w)) == len(w) - 1 for w in changed)


def test_long_ways(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(37)], "word string, form string")
    assert {tuple(r) for r in roots(spark, forms).collect()} == {(f"w{i:02}", "w37") for i in range(37)}
