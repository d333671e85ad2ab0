"""What the two compression classifiers share: labelled samples, dictionaries, calibration."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes with fewer sampled documents than this give no model.
LEAST = 8
#: Bytes of the longest text that is learned from.
LONGEST = 65536


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, rows: int, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> tuple[list[str], list[str]]:
    """Texts of class 0 and of class 1: of the rows that may be learned from, at most ``rows`` of each class by hash of the id.

    ``rows`` times ``longest`` bounds what reaches the driver: texts of more bytes are
    scored like any other, but not learned from, and an id gives one text (the least)
    however often it stands in the table. Rows without a label are not used; of several
    labels of one document the greatest counts; equal texts count once.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1)).filter(learnable)
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    picked = [known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows) for y in (0, 1)]
    ids = picked[0].union(picked[1])  # at most 2 x rows: small enough for every executor
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter(F.octet_length("_t") <= longest)
    got = texts.join(F.broadcast(ids), "_id").groupBy("_id", "_y").agg(F.min("_t").alias("_t")).select("_y", "_t").collect()
    return tuple(sorted({r["_t"] for r in got if r["_y"] == y and r["_t"]}) for y in (0, 1))  # type: ignore[return-value]


def shuffled(texts: list[str]) -> list[str]:
    out = list(texts)
    random.Random(7).shuffle(out)
    return out


def trained_dictionary(samples: list[bytes], size: int, segment: int = 0) -> bytes:
    """A zstandard dictionary from samples of one class; the samples themselves where they are too few to train on.

    ``segment``: bytes of the parts it is put together from (0: the trainer's own choice).
    """
    try:
        return zstandard.train_dictionary(size, samples, level=3, **({"k": segment, "d": 8} if segment else {})).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(dictionary: bytes, params: dict) -> Callable[[bytes], bytes]:
    p = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **params)
    kind = zstandard.DICT_TYPE_AUTO if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    d = zstandard.ZstdCompressionDict(dictionary or b"\0" * 8, dict_type=kind)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (last: the constant) by Newton steps."""
    mid, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([(x - mid) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + ridge * np.append(w[:-1], 0) * 0.1
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.eye(len(w)) * (0.1 * ridge + 1e-6)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mid, scale, w


def probability(x: np.ndarray, fit: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mid, scale, w = fit
    return 1 / (1 + np.exp(-np.clip(((x - mid) / scale) @ w[:-1] + w[-1], -30, 30)))


def scored(docs: DataFrame, score_batch: Callable[[list[str]], np.ndarray], id_col: str, text_col: str) -> DataFrame:
    """(id, score double, predicted int) for every row; ``score_batch`` is made once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.asarray(score_batch([v.as_py() or "" for v in batch.column(1)]), dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
