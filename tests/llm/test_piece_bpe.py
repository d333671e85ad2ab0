"""Merge rounds against the library, id by id."""

import base64
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terraspark.llm.piece_bpe import Encoder, Vocabulary, _file, decode, encode, round_trip

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(_file(MODEL))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=_file(MODEL))


def digests(ids, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))


def same(text, encoder, library):
    ids = library.encode(text)
    assert encoder.encode(text).tolist() == ids
    assert encoder.v.decode(ids) == library.decode(ids)
    assert tuple(x[0] for x in encoder.digests([text])) == digests(ids, library)


FIXED = ["", " ", "  ", "\n", "▁", "▁▁ x", "a  b   c     d", " " * 100, " " * 37 + "x", " \n" * 9, "a\x00b", "<0x41>", "<s>", "é漢😀́", "�", "theth" * 9, "a" * 500, "\x00", "\t\tx", "​﻿"]


@pytest.mark.parametrize("text", FIXED)
def test_fixed_texts(vocabulary, library, text):
    same(text, Encoder(vocabulary), library)
    same(text, Encoder(vocabulary, stretch=5, remembered=9), library)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abcdeinorst ▁\n", max_size=200), st.text("aeé漢😀 ", max_size=60)))
def test_any_text(vocabulary, library, text):
    same(text, Encoder(vocabulary, stretch=16, remembered=64), library)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=30))
def test_any_ids_decode(vocabulary, library, ids):
    ids = [i for i in ids if i != 0]  # what stands for an unknown piece is left to the library
    if not any(3 <= i < 259 for i in ids):
        assert vocabulary.decode(ids) == library.decode(ids)


def test_hard_long_texts(vocabulary, library):
    r = random.Random(5)
    draw = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    for text in (base64.b64encode(r.randbytes(60_000)).decode(), draw("abcdefghijklmnopqrstuvwxyz", 80_000), draw("etaoin", 30_000), "ab" * 100_000, " " * 100_000, draw("漢字仮名交文", 60_000), draw(" \n", 50_000)):
        assert Encoder(vocabulary, stretch=10_000).encode(text).tolist() == library.encode(text)


def test_scan_takes_what_a_merge_opens(vocabulary):
    # pairs of one rank: the left one first, and what it makes before the next
    ids, n = vocabulary.encode_words(["▁" * k for k in range(1, 60)])
    assert n.sum() == len(ids) and (np.bincount(ids).nonzero()[0] < vocabulary.size).all()


def test_tables(spark, library):
    texts = [None, "", "a b c", "a b c", "été 漢字\n\n  x", "word " * 30_000, "x" * 3000]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)] + [(2, "a b c", 1, "k"), (None, "no id", 1, "k")], "doc_id long, text string, ids int, n_tokens string").repartition(2)
    want = sorted((repr(r["doc_id"]), *digests(library.encode(r["text"] or ""), library)) for r in docs.collect())
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in round_trip(docs).collect()) == want
    encoded = encode(docs)
    assert sorted((repr(r["doc_id"]), tuple(r["ids"])) for r in encoded.collect()) == sorted((repr(r["doc_id"]), tuple(library.encode(r["text"] or ""))) for r in docs.collect())
    assert sorted((repr(r["doc_id"]), r["text"]) for r in decode(encoded).collect()) == sorted((repr(r["doc_id"]), r["text"] or "") for r in docs.collect())
    assert round_trip(docs.limit(0)).count() == 0
