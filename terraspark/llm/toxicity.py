"""Toxicity by compression distance of short windows.

Two zstandard dictionaries. The ordinary one is trained by zstandard on windows of
ordinary texts. For the toxic one zstandard trains on windows of toxic texts; of what
it picks, a stretch stays only if toxic windows get shorter by it several times as
often as ordinary ones (measured by compressing them, lower end of the interval), and
what stays is put in front of the ordinary dictionary. So both dictionaries do equally
well on ordinary text, down to stems inside a text of any language, and a window's
margin - its compressed length with the ordinary dictionary less that with the toxic
one - is above zero only where a learned stretch matches.

Windows are runs of characters that overlap, over the whole text in lower case with
everything but letters as one space. What counts is calibrated on labelled documents
that the dictionaries haven't seen: for several margins, how many windows reach them,
against how many would at the rate of ordinary windows. A logistic curve over these
gives the probability; a missed toxic document weighs ``COST`` rejected ordinary ones.

Labels reach the training only; a document's score depends on its text alone.
Null, empty and letterless texts score as texts without windows. Without enough
labelled documents of both classes every score is the share of toxic labels (0 if
none).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from terraspark.llm.zstd_model import LEAST, compressor, labelled_sample, logistic, probability, scored, shuffled, trained_dictionary

#: Everything between letters.
BETWEEN = re.compile(r"[\W\d_]+")
#: Characters of a window, and from one window's start to the next.
WIDTH, STEP = 40, 32
#: Shortest match of the compressor in bytes; literals are stored as they are (target_length), so lengths differ by matches alone.
MATCH = 7
PARAMS = {"compression_level": 1, "window_log": 15, "hash_log": 15, "chain_log": 10, "search_log": 1, "min_match": MATCH, "strategy": 1, "target_length": 1}
#: Bytes of the dictionaries that are trained, and of the ordinary one that windows are compressed with.
TRAINED, BASE = 65536, 4096
#: Bytes of a segment of the trainer.
SEGMENT = 16
#: Ends both dictionaries and begins every window: bytes that no text holds, one match that pays for the block's headers, so that one match more shows.
LEAD = bytes(range(0xC0, 0xF0))
#: The very end of a dictionary is not searched.
TAIL = b"\0" * 16
#: Times as often as ordinary windows that toxic windows must get shorter by a stretch.
RATIO = 6.0
#: Documents that must hold a stretch.
HOLD = 4
MARGINS = (3, 4, 5, 7, 9)
COST = 2.0


def plain(text: str) -> str:
    return f" {BETWEEN.sub(' ', text.lower()).strip()} "


def windows(text: str) -> list[bytes]:
    x = plain(text)
    return [x[i : i + WIDTH].encode("utf-8", "replace") for i in range(0, max(1, len(x) - (WIDTH - STEP)), STEP)] if len(x) > 2 else []


def apart(texts: list[str]) -> list[str]:
    """The texts without those of which most runs of three words stand in earlier ones: copies would pass for a habit of their class."""
    seen: set[int] = set()
    out = []
    for t in texts:
        x = plain(t).split()
        runs = set(map(hash, zip(x, x[1:], x[2:], strict=False)))
        if len(runs & seen) * 2 <= len(runs):
            out.append(t)
        seen |= runs
    return out


def _grams(x: str | bytes) -> Iterator:
    return (x[i : i + MATCH] for i in range(len(x) - MATCH + 1))


def times_as_often(a: int, of_a: int, b: int, of_b: int) -> float:
    """Lower end of the interval of the ratio of two shares."""
    return math.exp(math.log((a + 0.5) / of_a / ((b + 0.5) / of_b)) - 1.64 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))


def stretches(dictionary: str, toxic: list[str], ordinary: list[str]) -> list[str]:
    """What the compressor could match in the dictionary and toxic texts hold more often, as stretches of it that are as long as they can be."""
    known = set(_grams(dictionary))
    count, held, size = (Counter(), Counter()), Counter(), [1, 1]
    for side, texts in enumerate((toxic, ordinary)):
        for t in texts:
            x = plain(t)
            found = Counter(g for g in _grams(x) if g in known)
            count[side].update(found)
            size[side] += len(x)
            if side == 0:
                held.update(found.keys())
    keep = np.zeros(len(dictionary) + 1, bool)
    for i, g in enumerate(_grams(dictionary)):
        if held[g] >= HOLD and times_as_often(count[0][g], size[0], count[1][g], size[1]) > RATIO:
            keep[i : i + MATCH] = True
    edges = np.flatnonzero(np.diff(np.r_[False, keep].astype(int)))
    return sorted({dictionary[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)})


def measured(pieces: list[str], base: bytes, toxic: list[bytes], ordinary: list[bytes]) -> list[str]:
    """The pieces by which toxic windows get shorter RATIO times as often as ordinary ones; weakest first, since a dictionary's end is found first."""
    where: dict[bytes, set[int]] = {}
    for i, p in enumerate(pieces):
        for g in _grams(p.encode()):
            where.setdefault(g, set()).add(i)
    # only windows that share a match with a piece can get shorter by it
    share: list[tuple[list[bytes], list[bytes]]] = [([], []) for _ in pieces]
    for side, every in enumerate((toxic, ordinary)):
        for w in every:
            for i in set().union(*(where[g] for g in _grams(w) if g in where)):
                share[i][side].append(w)
    plain_size: dict[bytes, int] = {}
    without, out = compressor(base, PARAMS), []
    for i, p in enumerate(pieces):
        with_ = compressor(_before(base, [p]), PARAMS)
        shorter = []
        for side in share[i]:
            n = 0
            for w in side:
                if w not in plain_size:
                    plain_size[w] = len(without(LEAD + w))
                n += len(with_(LEAD + w)) < plain_size[w]
            shorter.append(n)
        r = times_as_often(shorter[0], len(toxic), shorter[1], len(ordinary))
        if r > RATIO:
            out.append((r, p))
    return [p for _, p in sorted(out)]


def _before(base: bytes, pieces: list[str]) -> bytes:
    """The pieces in front of the base. The compressor looks up every third place of a dictionary first: a length that is a multiple of it leaves the base's matches as they are."""
    x = b"\0".join(p.encode() for p in pieces) + b"\0\0"
    return b"\0" * (-len(x) % 12) + x + base


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    #: For each of MARGINS, the share of ordinary windows that reach it.
    rates: tuple
    fit: tuple | None
    prior: float

    def features(self, margins: np.ndarray) -> list[float]:
        n, out = len(margins), []
        for least, rate in zip(MARGINS, self.rates, strict=True):
            hits = int((margins >= least).sum())
            out += [math.log1p(hits), hits / max(1, n), (hits - rate * n) / math.sqrt(rate * n + 1)]
        return [*out, math.log1p(n)]


class Scorer:
    """Makes the compressors where it is first used, so that only bytes travel."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self._pair = None

    def __getstate__(self):
        return {"model": self.model, "_pair": None}

    def margins(self, text: str) -> np.ndarray:
        if self._pair is None:
            self._pair = compressor(self.model.ordinary, PARAMS), compressor(self.model.toxic, PARAMS)
        a, b = self._pair
        return np.array([len(a(w)) - len(b(w)) for w in (LEAD + x for x in windows(text))], dtype=np.int64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.model.fit is None:
            return np.full(len(texts), self.model.prior)
        if not texts:
            return np.zeros(0)
        return probability(np.array([self.model.features(self.margins(t)) for t in texts]), self.model.fit)


def train(ordinary: list[str], toxic: list[str]) -> ToxicityModel:
    """Dictionaries from two thirds of the texts of each class, calibration from the other third."""
    n0, n1 = len(ordinary), len(toxic)
    prior = n1 / (n0 + n1) if n0 + n1 else 0.0
    unknown = ToxicityModel(b"", b"", (0.0,) * len(MARGINS), None, prior)
    if min(n0, n1) < LEAST:
        return unknown
    ordinary, toxic = shuffled(ordinary), shuffled(toxic)
    o, t = apart(ordinary[n0 // 3 :]), apart(toxic[n1 // 3 :])
    ow, tw = ([w for x in side for w in windows(x) if len(w) >= 8] for side in (o, t))
    base = trained_dictionary(ow, TRAINED, SEGMENT)[-BASE:] + LEAD + TAIL
    found = trained_dictionary(tw, TRAINED, SEGMENT).decode("utf-8", "replace")
    pieces = measured(stretches(found, t, o), base, tw, ow)
    look = Scorer(ToxicityModel(base, _before(base, pieces), unknown.rates, None, prior))
    seen = [[look.margins(x) for x in side] for side in (ordinary[: n0 // 3], toxic[: n1 // 3])]
    every = np.concatenate([*seen[0], np.zeros(1, np.int64)])
    model = ToxicityModel(base, look.model.toxic, tuple(float((every >= m).mean()) for m in MARGINS), None, prior)
    x = np.array([model.features(m) for side in seen for m in side])
    y = np.repeat([0.0, 1.0], [len(side) for side in seen])
    return ToxicityModel(model.ordinary, model.toxic, model.rates, logistic(x, y, weight=np.where(y > 0, COST, 1.0)), prior)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learnable: Column, rows: int = 3000, label: str = "toxic") -> ToxicityModel:
    """A model from at most ``rows`` labelled documents of each class; ``learnable``: a condition on ``_id``."""
    return train(*labelled_sample(docs, labels, label, learnable, rows))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for every row."""
    return scored(docs, Scorer(model), id_col, text_col)


def reject_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """All columns of the rows whose score is below one half."""
    scorer, at = Scorer(model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep = scorer([v.as_py() or "" for v in batch.column(at)]) < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
