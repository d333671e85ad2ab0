"""op4 and op5 over a whole table against scores worked out text by text, without the operators' own helpers."""

import math
import re
import zlib

import pytest
import zstandard

from terraspark.llm import quality, toxicity
from terraspark.llm.queries import QUERIES, remainder, table

SF = "/root/testdata/sf0.01"


def packed(dictionary, params, data):
    """One frame of its own, with the dictionary given anew."""
    trained = dictionary.startswith(b"\x37\xa4\x30\xec")
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **params)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(data)


def curve(x, fit):
    mid, scale, w = fit
    z = sum((a - m) / s * k for a, m, s, k in zip(x, mid, scale, w)) + w[-1]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def quality_by_hand(model, text):
    b, saved = text.encode(), 0
    for i in range(0, len(b), 512):
        part = b[i : i + 512]
        saved += len(packed(model.bad, quality.PARAMS, part)) - len(packed(model.good, quality.PARAMS, part))
    return curve([saved / (len(b) + 160)], model.fit)


def toxicity_by_hand(model, text):
    words = [w for w in re.split(r"[\W\d_]+", text.lower()) if w]
    margins = []
    if words:
        line = " " + " ".join(words) + " "
        starts = [i for i in range(0, len(line), 32) if i == 0 or len(line) - i > 8]
        for i in starts:
            w = toxicity.LEAD + line[i : i + 40].encode()
            margins.append(len(packed(model.ordinary, toxicity.PARAMS, w)) - len(packed(model.toxic, toxicity.PARAMS, w)))
    n, x = len(margins), []
    for least, rate in zip((3, 4, 5, 7, 9), model.rates):
        hits = sum(m >= least for m in margins)
        x += [math.log(1 + hits), hits / max(n, 1), (hits - rate * n) / math.sqrt(rate * n + 1)]
    return curve([*x, math.log(1 + n)], model.fit)


@pytest.mark.parametrize(
    ("key", "fit", "by_hand", "parts", "held"),
    [("op4_toxicity", toxicity.fit_toxicity, toxicity_by_hand, 5, lambda h: h % 5 == 0), ("op5_quality", quality.fit_quality, quality_by_hand, 3, lambda h: h % 3 == 1)],
)
def test_scores(spark, key, fit, by_hand, parts, held):
    docs = table(spark, SF, "documents")
    known = remainder("_id", 5) != 0 if parts == 5 else remainder("_id", 3) != 1
    model = fit(docs, table(spark, SF, "labels"), known)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in QUERIES[key](spark, SF).collect()}
    assert got.keys() == texts.keys()
    short = {i: t for i, t in texts.items() if len(t) < 3000}
    assert len(short) > len(texts) / 2
    for i, t in texts.items():
        assert got[i]["held_out"] == held(zlib.crc32(str(i).encode())) and got[i]["predicted"] == int(got[i]["score"] >= 0.5)
    for i, t in short.items():
        assert got[i]["score"] == pytest.approx(by_hand(model, t), abs=1e-9), i


def test_classes_weigh_the_same():
    """Ten times as many good documents do not move the border into the bad ones."""
    words = lambda k, n: " ".join(f"{k}{j * 104729 % 97}" for j in range(n))
    good, bad = [words("alpha", 60 + i) for i in range(400)], [words("omega", 60 + i) for i in range(40)]
    score = quality.Scorer(quality.train(bad, good))
    mixed = [words("alpha", 30) + " " + words("omega", 30)]
    assert (score(good) > 0.5).all() and (score(bad) < 0.5).all() and 0.05 < score(mixed)[0] < 0.95
