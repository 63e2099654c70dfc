"""Embedders: an interface, a hash embedder, and the job that embeds a corpus.

An embedder has a name, a dimension and ``encode``, from texts to an array of unit rows.
Any model fits in; it runs in Arrow batches on the executors, loaded once for each worker.
The hash embedder puts words and character trigrams into signed buckets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.storage import written

_WORD = re.compile("[a-z0-9]+")


class Embedder(Protocol):
    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """A unit vector: every word and trigram (a shorter word once more) adds its sign to a bucket of its 64-bit hash."""

    name = "hash"

    def __init__(self, dim: int = 256):
        self.dim = dim
        self._of = lru_cache(200_000)(self._word)

    def _word(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        pieces = [word, *([word[i : i + 3] for i in range(len(word) - 2)] or [word])]
        h = [int.from_bytes(blake2b(p.encode(), digest_size=8).digest(), "little") for p in pieces]
        return np.array([x % self.dim for x in h]), np.array([1.0 if x >> 63 else -1.0 for x in h])

    def _vector(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        if not words:
            return np.zeros(self.dim)
        at, sign = zip(*map(self._of, words))
        v = np.bincount(np.concatenate(at), weights=np.concatenate(sign), minlength=self.dim)
        norm = np.linalg.norm(v)
        return v / norm if norm else v

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.stack([self._vector(t) for t in texts]) if texts else np.zeros((0, self.dim))


#: Embedders by the first part of their specification ``kind:argument``.
MAKERS: dict[str, Callable[[str], Embedder]] = {"hash": lambda arg: HashEmbedder(int(arg or 256))}


@lru_cache(8)
def make_embedder(spec: str) -> Embedder:
    kind, _, arg = spec.partition(":")
    if kind not in MAKERS:
        raise ValueError(f"unknown embedder {spec!r}: one of {', '.join(sorted(MAKERS))}")
    return MAKERS[kind](arg)


def hash_vector(text: str | None, dim: int) -> np.ndarray:
    return make_embedder(f"hash:{dim}").encode([text])[0]


def embedding(text: Column, make: Callable[[], Embedder]) -> Column:
    """The vector of a text column by the embedder that ``make()`` gives, called once for each Python worker and stage."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = make()
        for s in batches:
            yield pd.Series(list(np.asarray(e.encode(s.tolist()), dtype=np.float32)), index=s.index)

    return run(text)


def hash_embedding(text: Column, dim: int = 256) -> Column:
    return embedding(text, lambda: make_embedder(f"hash:{dim}"))


def embed_corpus(texts: DataFrame, make: Callable[[], Embedder], path: str | None = None) -> DataFrame:
    """card_id, embedding for cards (card_id, txt), written (to ``path``, if given) and read back."""
    return written(texts.select("card_id", embedding(F.col("txt"), make).alias("embedding")), "vectors", path)


def updated(vectors: DataFrame, news: DataFrame) -> DataFrame:
    """``vectors`` with those of ``news`` in place of their old ones; cards that ``vectors`` lacks are added."""
    both = vectors.join(news.select("card_id", F.col("embedding").alias("new")), "card_id", "full")
    return both.select("card_id", F.coalesce("new", "embedding").alias("embedding"))
