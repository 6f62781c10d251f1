"""Encoding of a corpus with a public byte-level BPE vocabulary.

The bytes of a pre-split piece map one to one to Latin-1 characters, so that an Aho-Corasick automaton
over the vocabulary finds, for every place, the tokens that begin there. The encoder goes left to right
with the longest token and backtracks to shorter ones where the token does not fit its left neighbour.
Two adjacent tokens fit if merging their joined bytes by rank gives back exactly the two; this is
memoised per pair. A sequence whose neighbours all fit is the sequence that the merges produce, and
places that were given up are marked, so the work is linear in the piece's length.

Defined cases: null and empty texts give the empty list; strings that look like special tokens are
ordinary text; a text of any length is encoded whole; equal texts give equal ids; other columns are
ignored and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pieces for texts of ASCII alone, in classes that need no Unicode tables.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Bytes that a vocabulary file may have to be sent to every task; a bound, not a guess: vocabularies are fixed files.
VOCABULARY_LIMIT = 16 * 1024 * 1024
#: Pieces whose ids a worker keeps, and the longest piece that is worth keeping.
MEMO, MEMO_CHARS = 500_000, 64


class Encoder:
    """Ids of texts under the ranks of one vocabulary file."""

    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        self.automaton = ahocorasick.Automaton()
        for token in self.ranks:
            self.automaton.add_word(token, len(token))
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.split_ascii = regex.compile(ASCII_PATTERN).findall
        self.memo: dict[str, list[int]] = {}
        self.fits = functools.lru_cache(maxsize=1_000_000)(self._fits)
        self.shorter = functools.lru_cache(maxsize=200_000)(self._shorter)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text after merging by rank, the definition that `piece` must reproduce."""
        parts = list(text)
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        return self.merged(left + right) == ([left, right] if left else [right])

    def _shorter(self, token: str) -> str:
        """The longest token that is a proper prefix; '' after a single byte."""
        return next((token[:k] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ranks), "")

    def piece(self, text: str) -> list[int]:
        """Ids of one pre-split piece, given as Latin-1 characters of its bytes."""
        if text in self.ranks and self.fits("", text):
            return [self.ranks[text]]
        n = len(text)
        longest = np.ones(n, np.int64)
        for end, size in self.automaton.iter(text):
            at = end - size + 1
            if size > longest[at]:
                longest[at] = size
        size_at = longest.tolist()
        open_place = bytearray(b"\x01") * (n + 1)
        tokens: list[str] = []
        at, token = 0, text[: size_at[0]]
        while at < n:
            left = tokens[-1] if tokens else ""
            while token and not (open_place[at + len(token)] and self.fits(left, token)):
                token = self.shorter(token)
            if token:
                tokens.append(token)
                at += len(token)
                token = text[at : at + size_at[at]] if at < n else ""
            else:  # nothing fits here: give the place up and shorten what led to it
                if not tokens:
                    raise ValueError("the vocabulary lacks single bytes")
                open_place[at] = 0
                token = tokens.pop()
                at -= len(token)
        return [self.ranks[t] for t in tokens]

    def _miss(self, word: str) -> list[int]:
        ids = self.piece(word.encode().decode("latin-1"))
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        words = (self.split_ascii if text.isascii() else self.split)(text)
        known, out = self.memo.get, []
        for word in words:
            out += known(word) or self._miss(word)
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: bytes) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def encode_corpus(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `ids` of every row, without a shuffle. The vocabulary file is read by the driver and sent to the workers."""
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        content = f.read(VOCABULARY_LIMIT + 1)
    if len(content) > VOCABULARY_LIMIT:
        raise ValueError(f"{vocabulary} is larger than {VOCABULARY_LIMIT} bytes")
    shared = spark.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strataflow.llm.tokens import _encoder as encoder_of  # the module's own state, kept between tasks

        encode = encoder_of(shared.value).encode
        for batch in batches:
            ids: list[int] = []
            offsets = [0]
            for value in batch.column(1).to_pylist():
                if value:
                    ids += encode(value)
                offsets.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(ids, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(run, f"{key} long, ids array<int>")
