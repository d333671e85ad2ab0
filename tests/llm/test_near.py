"""Near duplicates at a similarity of 0.8, against all pairs by brute force."""

import random

import numpy as np
import pytest

from terraspark.llm import near, simhash
from tests.llm.test_text_operators import ODD, frame, odd, prose

SF = "/root/testdata/sf0.001"


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({b" ".join(w)} if w else set())


def classes_by_hand(texts, least=0.8):
    s = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(s)) for j in range(i) if s[i] == s[j] or (s[i] | s[j] and len(s[i] & s[j]) / len(s[i] | s[j]) >= least)]
    c = simhash.Classes(len(texts))
    c.add(*(np.array(x, int) for x in zip(*pairs))) if pairs else None
    return c.label


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "edit" + str(rng.random())
    return " ".join(w)


def test_similarities_by_definition():
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(20)]
    texts += [edited(rng, t, rng.randint(1, 3)) for t in texts]
    s = [near.profile(t) for t in texts]
    sketch = [np.frombuffer(x[3], np.uint32) for x in s]
    size = np.array([len(x) for x in sketch])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
    got = near.similarities(i, j, np.cumsum(size) - size, size, np.concatenate(sketch), np.array([x[4] for x in s]))
    assert got == pytest.approx([len(shingles(texts[a]) & shingles(texts[b])) / len(shingles(texts[a]) | shingles(texts[b])) for a, b in zip(i, j)])


@pytest.mark.parametrize("node", [4000, 7])
def test_classes_by_brute_force(spark, node):
    rng = random.Random(node)
    base = [prose(rng, rng.choice([8, 30, 60, 120, 200])) for _ in range(40)]
    lead = prose(rng, 30)  # a stretch that many texts share
    texts = base + [edited(rng, t, rng.randint(1, 1 + len(t.split()) // 45)) for t in base for _ in range(3)] + [f"{lead} {t}" for t in base[:20]] + [base[3]] * 9 + ["", None, " \n", base[5].upper()]
    got = {r["doc_id"]: r["component"] for r in near.near_classes(spark, frame(spark, texts), node=node).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_hand(texts).tolist()


def test_recall_on_long_texts(spark):
    """Beyond the sketch's size similarities are estimates: copies well above the threshold are found, others well below are not."""
    rng = random.Random(5)
    base = [prose(rng, 1500) for _ in range(12)]
    texts = base + [edited(rng, t, 15) for t in base] + [edited(rng, t, 250) for t in base]
    got = {r["doc_id"]: r["component"] for r in near.near_classes(spark, frame(spark, texts)).collect()}
    assert all(got[12 + i] == i for i in range(12)) and all(got[24 + i] == 24 + i for i in range(12))


def test_recall_on_the_driver_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    got = {r["doc_id"]: r["component"] for r in near.near_classes(spark, docs).collect()}
    want = classes_by_hand([r["text"] for r in rows])
    assert [got[r["doc_id"]] for r in rows] == [rows[k]["doc_id"] for k in want]


def test_keep_one(spark):
    rng = random.Random(6)
    texts = [prose(rng, 60) for _ in range(12)]
    texts += [edited(rng, texts[0], 1), edited(rng, texts[1], 1), texts[2], texts[2], None, ""]
    df = frame(spark, texts)
    kept = near.keep_one(spark, df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(classes_by_hand(texts).tolist()))
    assert near.keep_one(spark, df.unionAll(df)).count() == kept.count()
    assert near.keep_one(spark, df.limit(0)).count() == 0 and near.near_classes(spark, odd(spark)).count() == len(ODD) + 2
    # one id with a copy of another text and a text of its own: the copy goes, its own stays
    twice = frame(spark, [texts[0], texts[1], texts[0], texts[4], texts[4]], [5, 7, 7, None, None])
    assert sorted((str(r["doc_id"]), r["text"]) for r in near.keep_one(spark, twice).collect()) == sorted([("5", texts[0]), ("7", texts[1]), ("None", texts[4])])
