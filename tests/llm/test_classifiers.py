"""The compression classifiers on the labels of the driver's tables, and on odd tables."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraspark.llm import quality, toxicity
from terraspark.llm.zstd_model import labelled_sample


def labelled(sf):
    d = pd.read_parquet(f"/root/testdata/{sf}/documents.parquet").merge(pd.read_parquet(f"/root/testdata/{sf}/labels.parquet"), on="doc_id")
    return d.assign(rest=[zlib.crc32(str(i).encode()) for i in d.doc_id])


@pytest.mark.parametrize("sf", ["sf0.1", "sf0.01"])
def test_held_out_toxicity(sf):
    d = labelled(sf)
    known, held = d[d.rest % 5 != 0], d[d.rest % 5 == 0]
    model = toxicity.train(*(sorted(set(known[known.toxic == y].text)) for y in (0, 1)))
    if sf == "sf0.01":  # some 40 toxic documents are enough for the largest language
        held = d[d.lang == "en"]
    hit = toxicity.Scorer(model)(list(held.text)) >= 0.5
    assert hit[held.toxic == 1].mean() >= 0.85 and hit[held.toxic == 0].mean() <= 0.03
    if sf == "sf0.1":
        for lang in ("de", "fr", "es"):
            assert hit[(held.toxic == 1) & (held.lang == lang)].mean() >= 0.65 and hit[(held.toxic == 0) & (held.lang == lang)].mean() <= 0.08


def test_held_out_quality():
    d = labelled("sf0.01")
    known, held = d[d.rest % 3 != 1], d[d.rest % 3 == 1]
    hit = quality.Scorer(quality.train(*(sorted(set(known[known.quality == y].text)) for y in (0, 1))))(list(held.text)) >= 0.5
    assert (hit == (held.quality == 1)).mean() >= 0.9


def test_both_dictionaries_agree_on_ordinary_windows():
    d = labelled("sf0.1")
    model = toxicity.train(*(sorted(set(d[d.toxic == y].text)) for y in (0, 1)))
    look = toxicity.Scorer(model)
    margins = np.concatenate([look.margins(t) for t in d[d.toxic == 0].text])
    assert (margins == 0).mean() > 0.9 and model.toxic.endswith(model.ordinary)


def test_windows_cover_the_whole_text():
    text = "Ab1c " * 700
    x = toxicity.plain(text)
    w = [v.decode() for v in toxicity.windows(text)]
    assert "".join(v[: toxicity.STEP] for v in w[:-1]) + w[-1] == x and toxicity.windows("12 !") == []


def test_labelled_sample_is_bounded(spark):
    rows = [(1, "same", "x")] * 500 + [(1, "a", "x"), (2, None, "x"), (3, "", "x"), (4, "long" * 50, "x"), (5, "b", "x"), (None, "c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _y string")
    labels = spark.createDataFrame([(i, int(i == 5), 1) for i in (1, 2, 3, 4, 5)] + [(5, 0, 1), (None, 1, 1), (9, 1, 1), (8, None, 1)], "doc_id long, toxic int, _t int")
    assert labelled_sample(docs, labels, "toxic", F.lit(True), 100, longest=100) == (["a"], ["b"])
    assert labelled_sample(docs, labels.limit(0), "toxic", F.lit(True), 100) == ([], [])


@pytest.mark.parametrize(("fit", "score"), [(toxicity.fit_toxicity, toxicity.score_toxicity), (quality.fit_quality, quality.score_quality)])
def test_odd_tables(spark, fit, score):
    docs = spark.createDataFrame([(1, None, 1.0, 2), (1, "", 1.0, 2), (None, "a" * 300000, 1.0, 2), (2, "a", 1.0, 2), (2, "a", 1.0, 2)], "doc_id long, text string, score double, predicted long")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = score(docs, fit(docs, labels, F.lit(True)))
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == 5 and score(docs.limit(0), fit(docs.limit(0), labels, F.lit(True))).count() == 0
