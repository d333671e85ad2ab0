"""Spelling variants: words at one edit from one another, found by generating whole neighbourhoods.

1. Every task counts the words of its texts and hands the counts on; words that are long
   and frequent enough are the vocabulary, a table with one row a word.
2. Each word emits every distinct string at one deletion, replacement or insertion over
   the code points the vocabulary is written with. Words are rows of a byte matrix, so
   a neighbourhood is arithmetic: the hash of a word is a sum of code times power of the
   place, and the hash of a neighbour that sum with one term changed. A filter of
   ``filter_bits`` bits, of fixed size whatever the vocabulary, holds two bits for each
   word; a neighbour whose bits are not set is no word and is not written out.
3. The neighbours left are written out as strings and hash-joined to the vocabulary. What
   joins is a word at exactly one edit; no distance is computed.
4. A word's form is the most frequent neighbour, if frequent enough; roots are found by
   pointer jumping, whose rounds are few since frequencies grow along a path.

Texts hold Latin letters up to U+00FF; in code-point order equals in byte order of UTF-8.
Null and empty texts have no words, repeated rows count again, a null id draws as the
empty string, columns beside the id and the text are ignored. A table without words
gives no row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspark.llm.common import forget, made, named, partitions, written

#: Distinct words that a task holds before it hands their counts on.
HELD = 400_000
#: Neighbours that are hashed at a time.
BLOCK = 1 << 20
#: Size of the filter; 32 MB, one neighbour in a thousand passes by chance with some five million words.
FILTER_BITS = 1 << 28
BASE = np.uint64(0x9E3779B97F4A7C15)
#: The inverse of BASE modulo 2**64.
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))


def drop_one(doc: str, word: str, one_in: int = 97) -> str:
    """One occurrence rule for all occurrences of a word in a document: now and then a code point is lost."""
    h = zlib.crc32(f"{doc}:{word}".encode())
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, change: Callable[[str, str], str] | None = drop_one) -> DataFrame:
    """(word, n long): words of at least ``least`` code points, each occurrence changed by ``change`` first.

    ``change`` never adds to a word, so runs that are too short from the first are not looked at.
    """
    find = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}").findall
    give = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                # bytes.lower() changes A-Z only
                words = Counter(find((text.as_py() or "").encode().lower().decode()))
                if change is not None:
                    doc = doc.as_py() or ""
                    for word, n in words.items():
                        found[change(doc, word)] += n
                else:
                    found.update(words)
                if len(found) >= HELD:
                    yield give(found)
                    found.clear()
        yield give(found)

    seen = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, "word string, n long")
    return seen.filter(F.length("word") >= least).groupBy("word").agg(F.sum("n").alias("n"))


# -- neighbourhoods


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = _mixed(h)
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = BASE
    return np.cumprod(out)


def _hashes(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, matrix of code points) of the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cut = np.flatnonzero(np.diff(lengths[order])) + 1
    for rows in np.split(order, cut):
        if len(rows):
            yield rows, np.frombuffer("".join(words[i] for i in rows).encode("latin-1"), np.uint8).reshape(len(rows), -1)


def filter_part(words: list[str], bits: int) -> np.ndarray:
    """Numbers of the bits that the words set."""
    return np.unique(np.concatenate([b for _, codes in _by_length(words) for b in _bits(_hashes(codes), bits)] or [np.zeros(0, np.uint64)]))


def neighbours(codes: np.ndarray, alphabet: np.ndarray, known: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(row, neighbour) of all distinct neighbours of words of one length whose hash is ``known``.

    Of a run of equal code points only the first is deleted, a code point is replaced by others
    only, and none is inserted before its equal: so no string comes twice.
    """
    n, size = codes.shape
    power = _powers(size + 1)
    c, a = codes.astype(np.uint64), alphabet.astype(np.uint64)
    term = c * power[:size]
    before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(term, axis=1, dtype=np.uint64)], axis=1)
    whole = before[:, -1]
    for at in range(size + 1):
        after = whole - before[:, at]
        if at < size:
            rows = np.arange(n) if at == 0 else np.flatnonzero(codes[:, at] != codes[:, at - 1])
            h = before[rows, at] + (whole[rows] - before[rows, at + 1]) * BASE_INV
            rows = rows[known(h)]
            yield rows, _strings(np.delete(codes[rows], at, axis=1))
            h = (whole - term[:, at])[:, None] + a * power[at]
            row, letter = np.nonzero(known(h.ravel()).reshape(h.shape) & (codes[:, at, None] != alphabet))
            changed = codes[row]
            changed[:, at] = alphabet[letter]
            yield row, _strings(changed)
        h = (before[:, at] + after * BASE)[:, None] + a * power[at]
        fits = known(h.ravel()).reshape(h.shape)
        if at < size:
            fits &= codes[:, at, None] != alphabet
        row, letter = np.nonzero(fits)
        yield row, _strings(np.insert(codes[row], at, 0, axis=1), at, alphabet[letter])


def _strings(codes: np.ndarray, at: int | None = None, letters: np.ndarray | None = None) -> list[str]:
    if at is not None:
        codes[:, at] = letters
    text, size = codes.tobytes().decode("latin-1"), codes.shape[1]
    return [text[i * size : (i + 1) * size] for i in range(len(codes))]


def near_words(vocabulary: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(word, n, near, near_n): every pair of words of ``vocabulary`` (word, n) at one edit, in both directions."""
    spark = vocabulary.sparkSession
    # at most one row a code point, of which there are fewer than a hundred
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), np.uint8)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = filter_part(batch.column(0).to_pylist(), filter_bits)
            yield pa.RecordBatch.from_arrays([pa.array(bits.astype(np.int64))], names=["bit"])

    # bitmaps of 32,768 places each, which Spark counts from 1: filter_bits / 8 bytes at most, whatever the vocabulary
    places = vocabulary.select("word").mapInArrow(numbers, "bit long")
    maps = places.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits"))
    held = np.zeros(max(filter_bits // 8, 4096), np.uint8)
    for r in maps.collect():
        first = (r["bucket"] - 1) * 4096
        held[first : first + 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(held.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)

        def known(h: np.ndarray) -> np.ndarray:
            one, two = _bits(h, filter_bits)
            found = (bitmap[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8)) & 1
            at = np.flatnonzero(found)
            two = two[at]
            out = np.zeros(len(h), bool)
            out[at] = ((bitmap[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            return out

        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            of: list[int] = []
            near: list[str] = []
            give = lambda: pa.RecordBatch.from_arrays([pa.array([words[i] for i in of], pa.string()), pa.array(counts[of], pa.int64()), pa.array(near, pa.string())], names=["word", "n", "near"])  # noqa: E731, B023
            for rows, codes in _by_length(words):
                step = max(BLOCK // max(len(alphabet), 1), 1)
                for i in range(0, len(rows), step):
                    for at, strings in neighbours(codes[i : i + step], alphabet, known):
                        of += rows[i : i + step][at].tolist()
                        near += strings
                        if len(of) >= 100_000:
                            yield give()
                            of, near = [], []
            if of:
                yield give()

    # a word's neighbourhood is some thousand strings: many small tasks
    spread = vocabulary.repartition(4 * partitions(spark), "word")
    given = spread.mapInArrow(run, "word string, n long, near string")
    other = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return given.join(other.hint("shuffle_hash"), "near").select("word", "n", "near", "near_n")


def roots(spark, forms: DataFrame) -> DataFrame:
    """(word, root) of all rows (word, form) with a form: the last word on the way, by pointer jumping.

    The way of every round is twice as long as the one before; a table is written each round.
    """
    at, mark = written(spark, forms.select("word", F.col("form").alias("at")), "form_way"), made()
    ended = None
    while True:
        step = at.select(F.col("word").alias("at"), F.col("at").alias("next"))
        on = written(spark, at.join(step.hint("merge"), "at", "left").select("word", F.coalesce("next", "at").alias("at"), F.col("next").isNull().alias("end")), "form_way")
        ended = on
        if on.filter("NOT end").isEmpty():
            break
        at = on.select("word", "at")
    last = made()
    forget(spark, named(made(mark)[: max(last - mark - 1, 0)], "form_way"))
    return ended.select("word", F.col("at").alias("root"))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, times: int = 3, ratio: int = 2, change: Callable[[str, str], str] | None = drop_one, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``least`` code points and ``times`` occurrences.

    form: the most frequent neighbour (of equally frequent ones the first in code-point order) if it
    occurs at least ``ratio`` times as often as the word, else null; ratio is 2 or more, so ways end.
    """
    if ratio < 2:
        raise ValueError("a form is at least twice as frequent as the word")
    spark = docs.sparkSession
    words = written(spark, word_counts(docs, id_col, text_col, least, change).filter(F.col("n") >= times), "spelling_words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    near = near_words(words, filter_bits).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = -F.col("best.n") >= ratio * F.col("n")
    found = words.join(near.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")
    )
    found = written(spark, found, "spelling_forms")
    ends = roots(spark, found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(ends.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
