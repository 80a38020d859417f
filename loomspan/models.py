"""Seams for external models: embedders and language models, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.config import EMBED_DIM


class Embedder(Protocol):
    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class LanguageModel(Protocol):
    def call(self, messages: list[dict[str, str]]) -> str: ...


class HashingEmbedder:
    """Unit vectors from hashed words: the same text always gives the same vector."""

    def __init__(self, dim: int = EMBED_DIM):
        self.dim = dim

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1 if h >> 63 else -1
            row /= max(float(np.sqrt((row * row).sum())), 1e-12)
        return out


class ScriptedModel:
    """Answers with given replies, in turn."""

    def __init__(self, replies: Sequence[str]):
        self.replies, self.calls = list(replies), []

    def call(self, messages: list[dict[str, str]]) -> str:
        self.calls.append(messages)
        return self.replies[(len(self.calls) - 1) % len(self.replies)]


def embed(text: Column, make: Callable[[], Embedder] = HashingEmbedder) -> Column:
    """The vector of a text column; the model is made once a task and sees Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            yield pd.Series(list(model.encode(s.fillna("").tolist())), index=s.index)

    return encode(text)
