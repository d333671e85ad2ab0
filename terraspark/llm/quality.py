"""Quality by compression: which of two zstandard dictionaries suits a text better.

One dictionary is trained on good, one on bad labelled texts. A text is cut into
blocks, every block compressed with both; the difference of the two totals, per
byte, becomes a probability by a logistic curve fitted on labelled documents that
the dictionaries haven't seen. Both classes weigh the same in the fit, however many
documents each has: else 0.5 would lie among the rarer class.

Labels reach the training only. Null and empty texts have difference 0. Without
enough labelled documents of both classes every score is the share of good labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from terraspark.llm.zstd_model import LEAST, compressor, labelled_sample, logistic, probability, scored, shuffled, trained_dictionary

BLOCK = 512
SIZE = 65536
PARAMS = {"compression_level": 3, "window_log": 17, "hash_log": 15, "chain_log": 15, "search_log": 1, "min_match": 5, "strategy": 2}
#: Bytes added to a text's length, so that a few words cannot make a great difference.
FIRM = 160


def blocks(text: str) -> list[bytes]:
    b = text.encode()
    return [b[i : i + BLOCK] for i in range(0, len(b), BLOCK)]


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    fit: tuple | None
    prior: float


class Scorer:
    """Makes the compressors where it is first used, so that only bytes travel."""

    def __init__(self, model: QualityModel):
        self.model = model
        self._pair = None

    def __getstate__(self):
        return {"model": self.model, "_pair": None}

    def difference(self, text: str) -> float:
        """Compressed bytes with the bad dictionary less those with the good one, per byte of text."""
        if self._pair is None:
            self._pair = compressor(self.model.good, PARAMS), compressor(self.model.bad, PARAMS)
        good, bad = self._pair
        n = d = 0
        for b in blocks(text):
            n += len(b)
            d += len(bad(b)) - len(good(b))
        return d / (n + FIRM)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.model.fit is None:
            return np.full(len(texts), self.model.prior)
        if not texts:
            return np.zeros(0)
        return probability(np.array([[self.difference(t)] for t in texts]), self.model.fit)


def train(bad: list[str], good: list[str]) -> QualityModel:
    n0, n1 = len(bad), len(good)
    if min(n0, n1) < LEAST:
        return QualityModel(b"", b"", None, n1 / (n0 + n1) if n0 + n1 else 0.0)
    bad, good = shuffled(bad), shuffled(good)
    made = [trained_dictionary([b for t in side[len(side) // 4 :] for b in blocks(t) if len(b) >= 8], SIZE) for side in (good, bad)]
    look = Scorer(QualityModel(*made, None, 0.5))
    x = np.array([[look.difference(t)] for side in (bad[: n0 // 4], good[: n1 // 4]) for t in side])
    y = np.repeat([0.0, 1.0], [n0 // 4, n1 // 4])
    return QualityModel(*made, logistic(x, y, weight=np.where(y > 0, 1.0, (y > 0).sum() / (y == 0).sum())), n1 / (n0 + n1))


def fit_quality(docs: DataFrame, labels: DataFrame, learnable: Column, rows: int = 2000, label: str = "quality") -> QualityModel:
    """A model from at most ``rows`` labelled documents of each class; ``learnable``: a condition on ``_id``."""
    return train(*labelled_sample(docs, labels, label, learnable, rows))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for every row."""
    return scored(docs, Scorer(model), id_col, text_col)
