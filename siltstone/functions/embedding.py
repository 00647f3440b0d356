"""Embedding models by name. Without a network the built-in one hashes words; others can be registered."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.operators.keyword import tokens

#: Fixed value: what English models of the BGE family want before a query.
BGE_PREFIX = "Represent this sentence for searching relevant passages: "


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...

    def query_text(self, query: str) -> str: ...


@lru_cache(1 << 17)
def _place(word: str, dim: int) -> int:
    """Twice the place of a word, and 1 more where its sign is plus."""
    h = hashlib.md5(word.encode()).digest()
    return int.from_bytes(h[:8], "big") % dim * 2 + (h[8] & 1)


class HashEmbedder:
    """Each word adds its sign at a place, both from its MD5; the sum has unit length."""

    def __init__(self, dim: int = 64) -> None:
        self.dim, self.name = dim, f"hash-embedder-{dim}"

    def embed(self, texts: list[str]) -> np.ndarray:
        words = [tokens(t) for t in texts]
        codes = np.fromiter((_place(w, self.dim) for ws in words for w in ws), np.int64)
        at = np.repeat(np.arange(len(texts)), [len(ws) for ws in words]) * self.dim + codes // 2
        sums = np.bincount(at, weights=codes % 2 * 2.0 - 1.0, minlength=len(texts) * self.dim)
        return unit(sums.reshape(len(texts), self.dim).astype(np.float32))

    def query_text(self, query: str) -> str:
        return query


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=x.copy(), where=n > 0)


def query_text(model: str, query: str) -> str:
    low = model.lower()
    return BGE_PREFIX + query if low.startswith("bge-") and "-en" in low else query


_REGISTRY: dict[str, Callable[[], Embedder]] = {f"hash-embedder-{d}": (lambda d=d: HashEmbedder(d)) for d in (64, 128, 384)}
DEFAULT = "hash-embedder-64"


def register(name: str, make: Callable[[], Embedder]) -> None:
    _REGISTRY[name] = make


def models() -> list[str]:
    return sorted(_REGISTRY)


def load(name: str) -> Embedder:
    if name not in _REGISTRY:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(models())}")
    return _REGISTRY[name]()


def maker(name: str) -> Callable[[], Embedder]:
    """What makes a model where it is used, for the tasks of a pass."""
    load(name)
    return _REGISTRY[name]


def embedded(text: Column, name: str) -> Column:
    """Vectors of texts; the model is loaded once in each Python worker and sees Arrow batches."""
    make = _REGISTRY[name]

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for b in batches:
            yield pd.Series(list(model.embed(b.fillna("").tolist())))

    return run(text)
