"""Embedders: text columns to unit vectors, one per tier."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quire import constants as C
from quire.errors import ModelUnavailableError
from quire.functions.vector import HASH_DIM, hashing_embedding
from quire.runtime import ship


def check_tier(tier: str) -> str:
    if tier not in C.TIERS:
        raise ValueError(f"unknown tier {tier!r}; choose from {', '.join(C.TIERS)}")
    return tier


class Embedder(Protocol):
    tier: str
    dim: int

    def embed(self, text: Column) -> Column: ...


class HashingEmbedder:
    """The deterministic default: character-code buckets of tokens, in SQL expressions only."""

    def __init__(self, tier: str = C.DEFAULT_TIER, dim: int = HASH_DIM):
        self.tier, self.dim = check_tier(tier), dim

    def embed(self, text: Column) -> Column:
        return hashing_embedding(text, self.dim).cast("array<float>")


_models: dict[str, object] = {}


class ModelEmbedder:
    """A model tier: `load` runs once per Python worker and returns texts -> matrix; batches arrive through Arrow.

    A model that can't be loaded raises ModelUnavailableError; there is no silent fallback.
    """

    def __init__(self, tier: str, dim: int, load: Callable[[], Callable[[list[str]], np.ndarray]]):
        self.tier, self.dim, self.load = check_tier(tier), dim, load

    def embed(self, text: Column) -> Column:
        tier, load = self.tier, self.load
        ship(SparkSession.getActiveSession())

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            if tier not in _models:
                try:
                    _models[tier] = load()
                except OSError as e:
                    raise ModelUnavailableError(f"the model of tier {tier} can't be loaded: {e}") from e
            for texts in batches:
                m = np.asarray(_models[tier](texts.fillna("").tolist()), np.float32)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                yield pd.Series(list(m))

        return run(text)
