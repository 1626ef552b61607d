"""Rerankers: a ranked table of units in another order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr


def cross_encoder(found: DataFrame, queries: DataFrame, score: Callable[[Column, Column], Column], top_k: int = 0, threshold: float | None = 0.0) -> DataFrame:
    """New scores of (query text, unit text); those below ``threshold`` go, ``top_k``
    of each query stay (0: all). ``score`` may be an expression or a pandas UDF."""
    texts = queries.select(F.col("query_id").alias("_asked"), F.col("text").alias("_query"))
    scored = found.join(texts, F.col("query_id") == F.col("_asked")).withColumn("score", score(F.col("_query"), F.col("as_text")).cast("double"))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
    ranked = scored.withColumn("rank", F.row_number().over(by))
    if top_k > 0:
        ranked = ranked.where(F.col("rank") <= top_k)
    return ranked.withColumn("scores", expr.with_score("scores", "crossencoder", F.col("score"))).drop("_asked", "_query")


def lost_in_the_middle(found: DataFrame) -> DataFrame:
    """The best units at both ends and the worst in the middle; scores stay."""
    whole = Window.partitionBy("query_id")
    place = F.row_number().over(whole.orderBy(F.desc("score"), "rank")) - 1
    half = F.expr("_place div 2")
    rank = F.when(F.col("_place") % 2 == 0, half).otherwise(F.col("_count") - 1 - half) + 1
    placed = found.withColumn("_place", place).withColumn("_count", F.count("*").over(whole))
    return placed.withColumn("rank", rank.cast("int")).withColumn("scores", expr.with_score("scores", "litm_reorder", F.col("score"))).drop("_place", "_count")
