"""Embedders: from a text column to a vector column."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr

#: Texts that an embedding function gets at once.
BATCH = 256


def letter_frequency(text: Column) -> Column:
    """Counts of a to z in the lower-case text; pure expression, for tests and baselines."""
    low = F.lower(text)  # a to z have one byte each, and bytes need not be counted
    return F.array(*[(F.octet_length(low) - F.octet_length(F.replace(low, F.lit(c), F.lit("")))).cast("float") for c in string.ascii_lowercase])


def feature_hashing(size: int = 256) -> Callable[[Column], Column]:
    """Word counts hashed to ``size`` places; pure expression."""

    def embed(text: Column) -> Column:
        places = F.transform(expr.tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(size)))
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("float"))

    return embed


def by_function(fn: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """A batch function (a model, a service) as an embedder, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def embed(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            held = texts.tolist()
            yield pd.Series([v for i in range(0, len(held), BATCH) for v in fn(held[i : i + BATCH])], index=texts.index, dtype=object)

    return embed


def embed_chunks(chunks: DataFrame, embed: Callable[[Column], Column], keep: bool = True) -> DataFrame:
    """Adds ``vector`` and its ``norm``, of what the chunk reads as; vectors that are
    already there stay if ``keep``."""
    for c in ("window_text", "context_prefix"):
        if c not in chunks.columns:
            chunks = chunks.withColumn(c, F.lit(None).cast("string"))
    made = embed(expr.as_text())
    chunks = chunks.withColumn("vector", F.coalesce("vector", made) if keep and "vector" in chunks.columns else made)
    return chunks.withColumn("norm", expr.norm("vector"))
