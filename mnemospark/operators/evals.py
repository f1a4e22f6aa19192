"""Evaluation metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize


def latency_percentiles(samples: DataFrame, by: str, value: str) -> DataFrame:
    """p50, p95, p99 by nearest rank: the value at place round((n - 1) * p). Values are counted first, with map-side
    combine; ranks are running sums over what is distinct, and no group is gathered."""
    counts = samples.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by).orderBy(value)
    ranked = counts.withColumns({"_to": F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(Window.partitionBy(by))})
    at = lambda p: F.min(F.when(F.col("_to") > F.round((F.col("_all") - 1).cast("double") * F.lit(p)), F.col(value)))
    return ranked.groupBy(by).agg(*[at(p).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


def retrieval_metrics(cases: DataFrame, results: DataFrame, by_tier: bool = True) -> DataFrame:
    """cases (id, tier, must_contain, must_not_contain, expect_empty), results (id, rank from 1, content).
    Sums over cases: recall, precision, reciprocal rank, passed, empty when irrelevant; cases that expect
    nothing do not count in tiers."""
    got = results.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", normalize("content").alias("c")))).alias("got"))
    c = cases.join(got, "id", "left").withColumn("texts", F.coalesce(F.transform("got", lambda x: x["c"]), F.array().cast("array<string>")))
    holds = lambda needle: F.exists("texts", lambda t: F.contains(t, normalize(needle)))
    hits = F.size(F.filter("must_contain", holds))
    n = F.size("texts")
    first = F.array_position(F.transform("texts", lambda t: F.exists("must_contain", lambda m: F.contains(t, normalize(m)))), True)
    empty = F.col("expect_empty")
    ok_empty = empty & (n == 0)
    recall = F.when(empty, ok_empty.cast("double")).when(F.size("must_contain") == 0, 1.0).otherwise(hits / F.size("must_contain"))
    precision = F.when(empty, ok_empty.cast("double")).when(n == 0, 0.0).otherwise(hits / F.greatest(n, F.lit(1)))
    rr = F.when(empty, ok_empty.cast("double")).when(first > 0, 1.0 / first).otherwise(0.0)
    passed = F.when(empty, ok_empty).otherwise((hits == F.size("must_contain")) & ~F.exists("must_not_contain", holds))
    each = c.select("id", "tier", "expect_empty", recall.alias("recall"), precision.alias("precision"), rr.alias("rr"), passed.alias("passed"), ok_empty.alias("ok_empty"))
    if by_tier:
        each = each.where(~F.col("expect_empty"))
    sums = (F.count("*").alias("cases"), F.sum("recall").alias("recall_sum"), F.sum("precision").alias("precision_sum"), F.sum("rr").alias("reciprocal_rank_sum"),
            F.count_if("passed").alias("passed"), F.count_if("ok_empty").alias("empty_hits"))
    return (each.groupBy("tier") if by_tier else each.groupBy()).agg(*sums)


def extraction_metrics(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Entities (id, entity_type, canonical_name) of both sides: true and false positives, false negatives,
    precision, recall, F1."""
    norm = lambda df: df.select("id", normalize("entity_type").alias("t"), normalize("canonical_name").alias("n")).distinct()
    e, a = norm(expected).withColumn("_e", F.lit(True)), norm(actual).withColumn("_a", F.lit(True))
    j = e.join(a, ["id", "t", "n"], "full_outer")
    s = j.agg(F.count_if(F.col("_e") & F.col("_a")).alias("tp"), F.count_if(F.col("_e").isNull()).alias("fp"), F.count_if(F.col("_a").isNull()).alias("fn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def fact_type_accuracy(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Both (id, fact_type): hits, total, share."""
    e = expected.distinct().join(actual.distinct().withColumn("hit", F.lit(1)), ["id", "fact_type"], "left")
    return e.agg(F.count("hit").alias("hits"), F.count("*").alias("total")).select("hits", "total", F.try_divide(F.col("hits").cast("double"), F.col("total")).alias("accuracy"))
