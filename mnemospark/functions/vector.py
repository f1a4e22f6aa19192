"""Vector expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Zero if either is empty or the lengths differ."""
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(same, F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _divisor(a: Column) -> Column:
    """The norm, or one where it is next to zero."""
    n = norm(a)
    return F.when(n > 1.1920929e-07, n).otherwise(F.lit(1.0))


def l2_normalize(a: Column) -> Column:
    """The norm is bound as the element of an array of one, so it is computed once and not for each component."""
    return F.get(F.transform(F.array(_divisor(a)), lambda n: F.transform(a, lambda x: x.cast("double") / n)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """The dot product of both, normalised; a vector next to zero is taken as it is."""
    return dot(a, b) / (_divisor(a) * _divisor(b))


def mean_pool(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Mean of each position per group, then L2-normalised: rows of (by, pos, value). Partial sums are made
    before the shuffle, one row per group and position."""
    each = df.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    size = each.groupBy(*by).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("norm"))
    return each.join(size, by).select(*by, "pos", F.when(F.col("norm") > 1.1920929e-07, F.col("mean") / F.col("norm")).otherwise(F.col("mean")).alias("value"))


def token_windows(words: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of an array of tokens."""
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1 - overlap, F.lit(0)), F.lit(step))
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.slice(words, i + 1, size))).otherwise(F.array().cast("array<array<string>>"))
