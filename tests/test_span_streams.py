"""Suppression over streams of many small groups and over chains that cross batches."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from mnemospark.operators import spans


def plain(items, most):
    kept = []
    for a, b, s in sorted(items, key=lambda x: (-x[2], x[0], x[1])):
        if all(not ((i := min(b, y) - max(a, x)) > 0 and i / (b - a + y - x - i) > most) for x, y, _ in kept):
            kept.append((a, b, s))
    return kept


def test_chains_cross_batches_and_large_places():
    rng = random.Random(4)
    for low in (0, -50, 1 << 60):
        rows = sorted((g, low + (a := rng.randrange(90)), low + a + rng.choice([0, 1, 3, 9, 40]), rng.randrange(30) / 30) for g in range(12) for _ in range(rng.choice([1, 2, 40])))
        rows = [("p", *r) if r[0] else (None, *r) for r in rows]
        table = pa.table({n: pa.array(c, t) for n, c, t in zip(("label", "g", "start", "end", "score"), zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64()))})
        for size in (1, 7, 1000):
            got = sorted((r["g"], r["start"], r["end"], r["score"]) for b in spans._suppressed(2, 0.5)(iter(table.to_batches(size))) for r in b.to_pylist())
            want = sorted((g, *x) for g in range(12) for x in plain([r[2:] for r in rows if r[1] == g], 0.5))
            assert got == want


def test_spans_without_an_end_stay(spark):
    df = spark.createDataFrame([(1, "p", None, 4, 0.5), (1, "p", 1, 9, 0.4), (1, "p", 1, 9, 0.3)], "doc int, label string, start int, end int, score double")
    assert sorted(r["score"] for r in spans.suppress_overlaps(df, ["doc"]).collect()) == [0.4, 0.5]


def test_small_groups_cost_no_call_of_their_own(spark):
    at = F.pmod(F.xxhash64("id"), F.lit(500))
    df = spark.range(400_000).select((F.col("id") % 80_000).alias("doc"), F.lit("p").alias("label"), at.alias("start"), (at + 9).alias("end"), (F.col("id") % 97 / 97.0).alias("score"))
    began = time.time()
    assert spans.suppress_overlaps(df, ["doc"]).count() > 300_000
    assert time.time() - began < 30
