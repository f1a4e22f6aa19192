"""Exact vector ranking with pre-filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector

THRESHOLD = 0.7


def similarity(query: list[float], column: str = "embedding") -> Column:
    return vector.cosine(F.col(column), F.array(*[F.lit(float(x)) for x in query]))


def top_k(rows: DataFrame, query: list[float], k: int, key: str, threshold: float | None = None, recency: str | None = None) -> DataFrame:
    """The k most similar rows; ties by recency, then key. One pass and a bounded heap per task."""
    s = rows.where(F.col("embedding").isNotNull()).withColumn("sem_score", F.round(similarity(query), 9))
    if threshold is not None:
        s = s.where(F.col("sem_score") >= threshold)
    order = [F.col("sem_score").desc(), *([F.col(recency).desc()] if recency else []), F.col(key)]
    return s.orderBy(*order).limit(k)
