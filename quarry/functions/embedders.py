"""Embedding back ends behind one interface: text columns to vector columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quarry.functions.vectors import hash_embed


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """(key, embedding array<double>) per row, vectors of length one or zero."""


class HashEmbedder:
    """Signed token hashing; needs no model and stays in the JVM."""

    name = "hash"

    def __init__(self, dim: int = 256):
        self.dim = dim

    def embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        return hash_embed(rows, key, text, self.dim)


class FunctionEmbedder:
    """A model's ``encode``: a list of texts to an array (texts, dim); called once per Arrow batch of a task.

    ``load`` runs in the worker, so that a model is read there and never shipped.
    """

    def __init__(self, name: str, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int):
        self.name, self.load, self.dim = name, load, dim

    def embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        load, dim, name = self.load, self.dim, self.name

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encode = load()
            for batch in batches:
                if not len(batch):
                    continue
                x = np.asarray(encode(batch["_text"].fillna("").tolist()), np.float64)
                if x.shape != (len(batch), dim):
                    raise ValueError(f"{name} gave vectors of shape {x.shape}, not {(len(batch), dim)}")
                x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
                yield pd.DataFrame({key: batch[key], "embedding": list(x)})

        kind = dict(rows.dtypes)[key]
        return rows.select(key, rows[text].alias("_text")).mapInPandas(run, f"{key} {kind}, embedding array<double>")


_MAKERS: dict[str, Callable[..., Embedder]] = {"hash": HashEmbedder}


def register(name: str, maker: Callable[..., Embedder]) -> None:
    """Make a back end known under ``name``; models and remote services come in this way."""
    _MAKERS[name] = maker


def embedder(name: str, **options) -> Embedder:
    if name not in _MAKERS:
        raise ValueError(f"unknown embedding back end {name!r}; known are {', '.join(sorted(_MAKERS))}")
    return _MAKERS[name](**options)
