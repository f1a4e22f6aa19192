"""Edges are contracted where they are read, before anything is moved."""

import random

import numpy as np
from pyspark.sql import functions as F

from mnemospark.operators import graphs


def test_labels_equal_a_walk():
    rng = random.Random(5)
    for n, m in ((1, 0), (50, 20), (300, 280), (300, 900)):
        a, b = (np.array([rng.randrange(n) for _ in range(m)], np.int64) for _ in range(2))
        want = list(range(n))
        for x, y in zip(a, b):
            low, high = sorted((want[x], want[y]))
            want = [low if w == high else w for w in want]
        assert graphs._labels(a, b, n).tolist() == want
    path = np.random.default_rng(0).permutation(20_000)
    assert (graphs._labels(path[:-1], path[1:], 20_000) == 0).all()


def test_rounds_see_nodes_and_not_edges(spark, monkeypatch):
    rows, kept = [], graphs.cut

    def counted(df):
        out = kept(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graphs, "cut", counted)
    monkeypatch.setattr(graphs, "CONTRACTED", 4_000)
    pairs = spark.range(40_000).select(F.concat(F.lit("a"), F.col("id") % 200).alias("in_id"), F.concat(F.lit("b"), F.floor(F.col("id") / 200)).alias("out_id"))
    more = spark.createDataFrame([("x", "x"), ("y", None), (None, "z"), ("p", "o"), ("q", "p")], "in_id string, out_id string")
    got = {r["node"]: r["component"] for r in graphs.components(pairs.coalesce(2).union(more.coalesce(1))).collect() if r["node"] is not None}
    assert got == {**{f"{x}{k}": "a0" for x in "ab" for k in range(200)}, "x": "x", "y": "y", "z": "z", "o": "o", "p": "o", "q": "o"}
    assert max(rows) < 20_000  # there are 40,000 edges
