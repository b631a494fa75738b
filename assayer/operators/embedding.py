"""Embedding as a plug-in, with a deterministic default that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LOWERED

DIMENSIONS = 64


def bucket(token: str, dimensions: int = DIMENSIONS) -> int:
    """The first two bytes of the token's MD5, modulo the dimensions."""
    return int(hashlib.md5(token.encode()).hexdigest()[:4], 16) % dimensions


class _Known(dict):
    """Of each token its bucket, in two bytes."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions

    def __missing__(self, token: bytes) -> bytes:
        self[token] = found = bucket(token.decode(), self.dimensions).to_bytes(2, "little")
        return found


def hashed(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts of hashed lower-cased tokens."""
    known, out = _Known(dimensions), np.zeros((len(texts), dimensions))
    for row, t in zip(out, texts, strict=True):
        tokens = t.encode("utf-8", "surrogatepass").translate(LOWERED).split()
        row += np.bincount(np.frombuffer(b"".join(map(known.__getitem__, tokens)), "<u2"), minlength=dimensions)
    return out


def embed(df: DataFrame, text_col: str = "text", model: Callable[[list[str]], np.ndarray] = hashed, out: str = "vec") -> DataFrame:
    """Adds an array<double> column. model: a picklable function of a list of texts; it is called in Arrow batches. Null
    texts are embedded as the empty one."""
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(model(s.fillna("").tolist())), dtype=object)

    # Not deterministic by mark, so that a filter on the vectors isn't pushed below and evaluates them anew.
    return df.withColumn(out, F.pandas_udf(vectors, "array<double>").asNondeterministic()(F.col(text_col)))
