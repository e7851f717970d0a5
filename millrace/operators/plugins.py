"""Models as plug-ins: loaded once a worker, applied to Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Loads an encoder that turns texts into vectors.
EncoderFactory = Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]]
#: Loads a scorer of (query, text) pairs.
ScorerFactory = Callable[[], Callable[[Sequence[tuple[str, str]]], Sequence[float]]]


def encoded(text: Column, load: EncoderFactory) -> Column:
    """The vectors of a text column; a null text counts as empty."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            yield pd.Series([list(map(float, v)) for v in model(s.fillna("").tolist())], dtype=object)

    return run(text)


def pair_scores(query: str, text: Column, load: ScorerFactory) -> Column:
    """The scores of a text column against one query, through a logistic curve. Limit the rows before: a scorer is costly."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            yield 1 / (1 + (-pd.Series(model([(query, t) for t in s.fillna("")]), dtype=float)).map(math.exp))

    return run(text)


def rescored(ranked: DataFrame, key: str, text: str, score: str, query: str, load: ScorerFactory, top_k: int = 10) -> DataFrame:
    """(key, pair_score) of the top_k rows by score: the cut comes before the model."""
    return ranked.orderBy(F.col(score).desc(), F.col(key)).limit(top_k).select(key, pair_scores(query, F.col(text), load).alias("pair_score"))
