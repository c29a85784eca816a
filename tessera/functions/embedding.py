"""Vectors of documents and queries, from a provider that the caller brings."""

from __future__ import annotations

import collections
import threading
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.analyzer import terms

CACHED_QUERIES = 1024


class EmbeddingProvider(Protocol):
    """``fingerprint`` names the model; an index takes vectors of one model only. It is sent to the workers, once a task."""

    fingerprint: str
    dimension: int

    def encode_documents(self, texts: list[str]) -> np.ndarray: ...

    def encode_query(self, text: str) -> np.ndarray: ...

    def truncates(self, text: str) -> bool: ...


def embedding_text() -> Column:
    """What a document is encoded from."""
    return F.concat_ws("\n", "title", "body")


def encode(documents: DataFrame, provider: EmbeddingProvider) -> DataFrame:
    """``documents`` with ``vector`` and ``truncated`` (the model saw a part only); clashing columns are replaced."""
    kind = T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("truncated", T.BooleanType())])

    @F.pandas_udf(kind)
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = [x or "" for x in batch]
            rows = np.asarray(provider.encode_documents(found), np.float32).reshape(len(found), provider.dimension) if found else np.zeros((0, provider.dimension), np.float32)
            yield pd.DataFrame({"vector": list(rows), "truncated": [provider.truncates(x) for x in found]})

    kept = [F.col(f"`{c}`") for c in documents.columns if c not in ("vector", "truncated")]
    return documents.select(*kept, vectors(embedding_text()).alias("_encoded")).select(*kept, "_encoded.vector", "_encoded.truncated")


class CachedQueries:
    """A provider whose last CACHED_QUERIES query vectors are kept; callers get copies."""

    def __init__(self, provider: EmbeddingProvider, size: int = CACHED_QUERIES):
        self.provider, self.size = provider, size
        self.fingerprint, self.dimension = provider.fingerprint, provider.dimension
        self._kept: collections.OrderedDict[str, np.ndarray] = collections.OrderedDict()
        self._lock = threading.Lock()

    def encode_query(self, text: str) -> np.ndarray:
        with self._lock:
            if text in self._kept:
                self._kept.move_to_end(text)
            else:
                self._kept[text] = np.asarray(self.provider.encode_query(text), np.float32)
                if len(self._kept) > self.size:
                    self._kept.popitem(last=False)
            return self._kept[text].copy()


class TermSketch:
    """A provider without a model, for tests and machines without one: signed counts of hashed terms, of unit length.

    The first component is the same in all vectors, so that none is zero.
    """

    def __init__(self, dimension: int = 64, max_terms: int | None = None):
        if dimension < 2:
            raise ValueError("at least two components")
        self.dimension, self.max_terms = dimension, max_terms
        self.fingerprint = f"term-sketch-{dimension}-{max_terms}"

    def truncates(self, text: str) -> bool:
        return self.max_terms is not None and len(terms(text)) > self.max_terms

    def encode_query(self, text: str) -> np.ndarray:
        v = np.zeros(self.dimension, np.float32)
        v[0] = 1.0
        for t in terms(text)[: self.max_terms]:
            h = zlib.crc32(t.encode())
            v[1 + (h >> 1) % (self.dimension - 1)] += 1.0 if h & 1 else -1.0
        return v / np.linalg.norm(v)

    def encode_documents(self, texts: list[str]) -> np.ndarray:
        return np.stack([self.encode_query(t) for t in texts]) if texts else np.zeros((0, self.dimension), np.float32)
