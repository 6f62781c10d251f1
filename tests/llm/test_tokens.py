from __future__ import annotations

import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataflow.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def encoder():
    with open(T.VOCABULARY, "rb") as f:
        return T.Encoder(f.read())


@pytest.fixture(scope="module")
def peer():
    tiktoken = pytest.importorskip("tiktoken")
    with open(T.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("peer", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = st.text(max_size=60) | st.text(alphabet="abcdeth 'sl\n\t0129.,é日🧪", max_size=120)


@settings(max_examples=500, deadline=None)
@given(text=TEXTS)
def test_same_ids_as_a_public_library(encoder, peer, text):
    assert encoder.encode(text) == peer.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="abcdefgh", min_size=1, max_size=40))
def test_backtracking_equals_merging(encoder, text):
    assert encoder.piece(text) == [encoder.ranks[t] for t in encoder.merged(text)]


def test_ids_decode_to_the_text(encoder):
    text = "Zellmaß – 検体 <|endoftext|> \u0000 ok"
    words = {v: k for k, v in encoder.ranks.items()}
    assert "".join(words[i] for i in encoder.encode(text)).encode("latin-1").decode() == text


def test_long_pieces_stay_linear(encoder, peer):
    for text in ("a" * 100_000, "ab" * 50_000, "hgfedcba" * 20_000):
        assert encoder.encode(text) == peer.encode_ordinary(text)


def test_table(spark, peer):
    rows = [(1, "a cat", 0), (2, "", 1), (3, None, 2), (4, "<|endoftext|>", 3), (4, "<|endoftext|>", 3), (None, "x", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in T.encode_corpus(df).collect()), key=str)
    assert got == sorted(((i, peer.encode_ordinary(t) if t else []) for i, t, _ in rows), key=str)
    assert T.encode_corpus(df.limit(0)).count() == 0
