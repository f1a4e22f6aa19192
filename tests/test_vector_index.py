"""The stored vector index: recall against the exact scan, filters before the cut, create and drop."""

import numpy as np
from pyspark.sql import functions as F

from mnemospark.operators import semantic
from mnemospark.operators.vector_index import VectorIndex


def vectors(spark, n=3_000, dims=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dims))
    rows = [(i, (centres[i % 40] + rng.normal(0, 0.6, dims)).tolist(), i % 3) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, 0), (n + 1, [1.0], 0), (n + 2, [float("nan")] * dims, 0)], "id long, embedding array<double>, kind int").repartition(4).cache()


def test_recall_filters_and_the_exact_way(spark, tmp_path):
    rows, ix = vectors(spark), VectorIndex(spark, f"file://{tmp_path}/v", part_rows=40)
    assert not ix.exists()
    ix.create(rows.where("id < 2000 OR id >= 3000"), "id", "embedding", 24)
    ix.add(rows.where("id BETWEEN 2000 AND 2999"), "id", "embedding")
    assert ix.exists() and ix.codes().count() == 3_000
    queries = rows.where("id % 100 = 0 AND id < 3000").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {}
    for r in ix.search_batch(queries, rows, 10, "id").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["key"]))
    asked = {r["query_id"]: r["vector"] for r in queries.collect()}
    hits = 0
    points = np.array([r["embedding"] for r in rows.where("id < 3000").orderBy("id").collect()])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    for q, v in asked.items():
        want = np.argsort(-np.round(points @ (np.array(v) / np.linalg.norm(v)), 9), kind="stable")[:10]
        hits += len({k for _, k in got[q]} & set(want.tolist()))
        assert [n for n, _ in sorted(got[q])] == list(range(1, 11)) and min(got[q])[1] == q
    assert hits >= 0.9 * 10 * len(asked)
    some = rows.where("kind = 1")
    one = asked[100]
    mine, plain = ix.search(some, one, 10, "id"), semantic.top_k(some, one, 10, "id")
    assert [r["kind"] for r in mine.collect()] == [1] * 10  # what may not be found takes no place
    assert [tuple(r) for r in ix.search(some, one, 10, "id", exact=True).select("id", "sem_score").collect()] == [tuple(r) for r in plain.select("id", "sem_score").collect()]
    every = ix.search(some, one, 10, "id", probes=1_000, candidates=1_000)
    assert [r["id"] for r in every.collect()] == [r["id"] for r in plain.collect()]
    plan = ix.codes().where("cell IN (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    ix.drop()
    assert not ix.exists()


def test_empty_table(spark, tmp_path):
    ix = VectorIndex(spark, f"file://{tmp_path}/v")
    none = vectors(spark, 10).limit(0)
    ix.create(none, "id", "embedding", 24)
    assert ix.exists() and ix.search(none, [1.0] * 24, 3, "id").collect() == []
