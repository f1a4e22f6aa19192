"""Reciprocal rank fusion and the final order of a context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import temporal

K = 10.0
#: Weight and priority of each leg.
LEGS = {"lexical": (1.0, 0), "community": (0.7, 1), "semantic": (0.5, 2)}
MAX_PER_EPISODE = 2


def leg(hits: DataFrame, name: str, order: list[Column], rationale: Column | None = None) -> DataFrame:
    """A leg's hits with their 0-based rank. Legs are cut to a budget before, so the rank window is small."""
    weight, priority = LEGS[name]
    rank = F.row_number().over(Window.orderBy(*order)) - 1
    return hits.withColumns({"rank": rank, "weight": F.lit(weight), "source_priority": F.lit(priority), "rationale": rationale if rationale is not None else F.lit(name)})


def reciprocal_ranks(legs: DataFrame, as_of) -> DataFrame:
    """One row per fact: the sum of weight / (11 + rank), the highest decayed confidence, the row of the best
    leg. legs: rows of all legs with rank, weight, source_priority."""
    extra = ("rank", "weight", "source_priority")
    cols = [c for c in legs.columns if c not in extra and c != "fact_id"]
    best = F.min_by(F.struct(*cols), F.struct("source_priority", "rank"))
    return legs.withColumn("_c", temporal.retrieval_confidence(as_of)).groupBy("fact_id").agg(
        F.sum(F.col("weight") / (F.lit(K) + F.col("rank").cast("double") + F.lit(1.0))).alias("fusion_score"), F.max("_c").alias("decayed_confidence"),
        F.min("source_priority").alias("source_priority"), best.alias("r")).select("fact_id", "fusion_score", "decayed_confidence", "source_priority", "r.*")


def composite_score() -> Column:
    return F.col("fusion_score") * F.greatest(F.col("decayed_confidence"), F.lit(0.01)) * (F.lit(1.0) + F.coalesce(F.col("ft_score"), F.lit(0.0)))


def relevance_order() -> list[Column]:
    """Scores that agree to nine decimals count as equal, so that the order does not hang on the order of sums."""
    return [F.round(composite_score(), 9).desc(), F.col("source_priority").asc(), F.col("t_valid").desc(), F.col("fact_id").asc()]


def timeline_order() -> list[Column]:
    return [F.col("t_valid").asc(), F.col("fact_id").asc()]


def time_window(df: DataFrame, start=None, end=None) -> DataFrame:
    """Both ends inclusive, either may be open."""
    if start is not None:
        df = df.where(F.col("t_valid") >= temporal.ts(start))
    if end is not None:
        df = df.where(F.col("t_valid") <= temporal.ts(end))
    return df


def diversify(df: DataFrame, order: list[Column], most: int = MAX_PER_EPISODE) -> DataFrame:
    """At most two facts of an episode, the first in final order."""
    rn = F.row_number().over(Window.partitionBy("source_episode").orderBy(*order))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= most).drop("_rn")
