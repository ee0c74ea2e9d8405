"""Texts as ids of a public byte-level BPE vocabulary, by one walk through the trie of their distinct words.

The last token of the encoding of a prefix says all: the rest is the encoding of what stands before it. So
each prefix needs one state (its last token), and words that begin alike share the states of what they
have in common. Sorted, the distinct words of a batch are the trie in depth-first order: the walk
steps back to the common prefix of neighbours and goes on from there.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.plans.spread import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are cut into words before encoding: the vocabulary's fixed pattern.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept with their ids by each Python worker; when there are more, it starts anew. Bears on speed only.
KEPT_WORDS = 200_000
KEPT_BYTES = 64


class TrieEncoder:
    """Encodes words by a vocabulary whose ids are the order of its merges."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.split = regex.compile(WORDS).findall
        # Every end of a token, so that a look back from a place stops where no token can go on.
        self.ends: dict[bytes, int] = {}
        for token, i in self.ids.items():
            for k in range(1, len(token)):
                self.ends.setdefault(token[k:], -1)
            self.ends[token] = i
        self.sizes = {i: len(b) for b, i in self.ids.items()}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self.known: dict[str, list[int]] = {}

    def _half(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the token's own merge joins; None for a single byte."""
        if token not in self._halves:
            word = [bytes([b]) for b in self.bytes[token]]
            while len(word) > 2:
                best = min(range(len(word) - 1), key=lambda k: self.ids.get(word[k] + word[k + 1], 1 << 60))
                word[best : best + 2] = [word[best] + word[best + 1]]
            self._halves[token] = (self.ids[word[0]], self.ids[word[1]]) if len(word) == 2 else None
        return self._halves[token]

    def _stands(self, left: int, right: int) -> bool:
        """Whether both tokens stay as they are when their bytes are encoded together."""
        known = self._pairs.get((left, right))
        if known is None:
            known = self._pairs[left, right] = self._stay(left, right)
        return known

    def _stay(self, a: int, b: int) -> bool:
        """Undo the merges of a and b at their border, the latest first: none of what comes to stand side by side may have
        merged before what was undone; of two alike the left one was first."""
        limit = 1 << 60
        while True:
            if self.ids.get(self.bytes[a] + self.bytes[b], limit) < limit:
                return False
            left, right = self._half(a), self._half(b)
            if left and (a > b or not right):
                limit, a = a, left[1]
            elif right:
                limit, b = b + 1, right[0]
            else:
                return True

    def _walk(self, words: list[bytes]) -> Iterator[list[int]]:
        """The ids of each of the sorted words."""
        ends, stands = self.ends, self._stands
        last: list[int] = []  # the last token of each prefix of the word
        before = b""
        sizes = self.sizes
        for word in words:
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del last[same:]
            for end in range(same + 1, len(word) + 1):
                start = end - 1
                found = ends[word[start:end]]
                if start and not (found >= 0 and stands(last[start - 1], found)):
                    found = -1
                while start and found < 0:
                    start -= 1
                    token = ends.get(word[start:end])
                    if token is None:
                        raise AssertionError("no encoding; the vocabulary's ids are not the order of its merges")
                    if token >= 0 and (not start or stands(last[start - 1], token)):
                        found = token
                last.append(found)
            before = word
            out, end = [], len(word)
            while end:
                out.append(last[end - 1])
                end -= sizes[last[end - 1]]
            out.reverse()
            yield out

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; of a null or empty one none. Text that looks like a special token is ordinary text."""
        split = [self.split(t) if t else [] for t in texts]
        known = self.known
        new: dict[bytes, str] = {}
        for words in split:
            for w in words:
                if w not in known:
                    b = w.encode("utf-8", "replace")
                    whole = self.ids.get(b)
                    if whole is not None:
                        known[w] = [whole]
                    else:
                        new[b] = w
        order = sorted(new)
        here = {new[b]: ids for b, ids in zip(order, self._walk(order))}
        out = [[i for w in words for i in (known.get(w) or here[w])] for words in split]
        if len(known) + len(here) > KEPT_WORDS:
            known.clear()
        known.update((w, ids) for w, ids in here.items() if len(w) <= KEPT_BYTES)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def _batches(texts: list[str | None], most: int = 256, chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts that are encoded together."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if k - start + 1 >= most or size >= chars:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, ids) of each row's text, without special tokens; a null or empty text has an empty list.

    One pass without a shuffle; every row comes out, repeated ids too. Texts may be of any length, and are
    never cut. Extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _batches(texts, 4096, 4 << 20):
                ids = pa.array(enc.encode_batch(texts[a:b]), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, text_col: str, count_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the number of tokens of its text in count_col, 0 for a null or empty text."""
    @F.pandas_udf("bigint")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary)
        for part in parts:
            texts = part.tolist()
            yield pd.Series([len(ids) for a, b in _batches(texts, 4096, 4 << 20) for ids in enc.encode_batch(texts[a:b])], dtype="int64")

    return spread(df).withColumn(count_col, run(F.col(f"`{text_col}`")))
