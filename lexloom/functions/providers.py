"""Pluggable models as column functions: each loads once in a worker and works on Arrow batches."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.operators.answer import SYSTEM
from lexloom.operators.dense import mock_embedding

# Names of providers, and the key that a settings template holds.
STAND_INS, SERVICES, NO_KEY = ("mock", "fake", "test"), ("openai", "default"), "your-api-key-here"


class Embedder(Protocol):
    """Texts to vectors of `dimension`."""

    dimension: int

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class PairScorer(Protocol):
    def score(self, pairs: Sequence[tuple[str, str]]) -> Sequence[float]: ...


class Answerer(Protocol):
    """Prompts to answers under instructions; one that fails raises, and no other answer takes its place."""

    def answer(self, prompts: Sequence[str], instructions: str) -> Sequence[str]: ...


def _batches(values: Sequence, size: int) -> Iterator[Sequence]:
    for a in range(0, len(values), size):
        yield values[a : a + size]


def embedding_column(load: Callable[[], Embedder], batch: int = 50) -> Callable[[Column], Column]:
    """A column function text -> array<double>. A vector of another dimension than the model's raises ValueError."""

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in parts:
            out: list = []
            for some in _batches(texts.fillna("").tolist(), batch):
                made = model.embed(some)
                if len(made) != len(some) or any(len(v) != model.dimension for v in made):
                    raise ValueError(f"the model did not give {len(some)} vectors of {model.dimension}")
                out += [[float(x) for x in v] for v in made]
            yield pd.Series(out, dtype=object)

    return embed


def embedder(name: str, dimension: int, load: Callable[[], Embedder] | None = None, key: str | None = None, batch: int = 50) -> Callable[[Column], Column]:
    """The column function of a provider: the stand-in, or a service whose client `load` makes.

    A service without a key falls back to the stand-in with a warning; an unknown name raises ValueError.
    """
    kind = name.lower()
    if kind not in STAND_INS and kind not in SERVICES:
        raise ValueError(f"no such embedding provider: {name}")
    if dimension <= 0:
        raise ValueError("the embedding dimension must be positive")
    if kind in SERVICES and key and key != NO_KEY and load is not None:
        return embedding_column(load, batch)
    if kind in SERVICES:
        warnings.warn("the embedding service has no key or client; the stand-in is used", stacklevel=2)
    return lambda text: mock_embedding(text, dimension)


def rerank_column(load: Callable[[], PairScorer], batch: int = 64) -> Callable[[str, str, str], Column]:
    """A score for fusion.rerank from a model of (query, text) pairs, rounded to 4 places."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in parts:
            pairs = list(zip(queries.fillna(""), texts.fillna("")))
            yield pd.Series([float(s) for some in _batches(pairs, batch) for s in model.score(some)], dtype=float)

    return lambda query, text, fused: F.round(score(F.col(query), F.col(text)), 4)


def answer_column(load: Callable[[], Answerer], batch: int = 16, instructions: str = SYSTEM) -> Callable[[Column], Column]:
    """A column function prompt -> answer, of a model that gets the instructions with each batch. A missing answer raises ValueError."""

    @F.pandas_udf("string")
    def answer(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for prompts in parts:
            out: list = []
            for some in _batches(prompts.fillna("").tolist(), batch):
                made = model.answer(some, instructions)
                if len(made) != len(some):
                    raise ValueError(f"the model gave {len(made)} answers to {len(some)} prompts")
                out += made
            yield pd.Series(out, dtype=object)

    return answer
