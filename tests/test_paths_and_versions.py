"""Paths from both ends and supersession over many tasks, against brute force."""

import datetime as dt
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import graphs

T = dt.datetime(2026, 1, 1)


def graph(spark, pairs):
    rows = [(f"e{k}", a, "knows", b, 0.5, T, None, None, None) for k, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "edge_id string, in_id string, relation string, out_id string, strength double, t_valid timestamp_ntz, t_ingested timestamp_ntz, t_invalid timestamp_ntz, t_invalid_ingested timestamp_ntz").cache()


def test_paths(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(36)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    edges = graph(spark, pairs)
    for target in ("n1", "n5", "n17", "n33", "nowhere"):
        far, queue = {"n0": 0}, deque(["n0"])
        while queue:
            x = queue.popleft()
            for y in near.get(x, ()):
                if y not in far:
                    far[y] = far[x] + 1
                    queue.append(y)
        got = graphs.shortest_path(edges, "n0", target, T, 4)
        if far.get(target, 9) <= 4:
            assert got["status"] == "found" and len(got["path"]) == far[target] + 1 and got["path"][0] == "n0" and got["path"][-1] == target
            assert all(b in near[a] for a, b in zip(got["path"], got["path"][1:]))
        else:
            assert got == {"status": "no_path", "path": []}
    assert graphs.shortest_path(edges, "n0", "n0") == {"status": "found", "path": ["n0"]}


def test_a_hub_is_passed_and_a_budget_holds(spark):
    pairs = [("a", "hub"), ("b", "hub"), *[("hub", f"leaf{k}") for k in range(300)], *[("c", f"x{k}") for k in range(60)], *[("d", f"y{k}") for k in range(60)], ("y1", "z"), ("z", "x1")]
    edges = graph(spark, pairs)
    assert graphs.shortest_path(edges, "a", "b", T, 4, 10)["path"] == ["a", "hub", "b"]
    assert graphs.shortest_path(edges, "c", "d", T, 4, 10) == {"status": "depth_limit_exceeded", "path": []}
    assert graphs.shortest_path(edges, "c", "d", T, 4, 500)["path"] == ["c", "x1", "z", "y1", "d"]
    assert graphs.shortest_path(edges, "c", "d", T, 3)["status"] == "no_path" and graphs.shortest_path(edges, "c", "d", T - dt.timedelta(days=1))["status"] == "no_path"
    entities = spark.createDataFrame([("hub", "company", "Hub")], "entity_id string, entity_type string, canonical_name string")
    steps = [tuple(r) for r in graphs.path_steps(edges, entities, ["a", "hub", "b"], T).orderBy("position").select("position", "node", "label", "edge_id", "direction", "strength").collect()]
    assert steps == [(0, "a", None, "e0", "outgoing", 0.5), (1, "hub", "Hub", "e1", "incoming", 0.5), (2, "b", None, None, None, None)]
    assert graphs.path_steps(edges, entities, []).count() == 0


def plain(rows):
    out = {}
    for edge, key, v, i, closed in rows:
        later = [(i2, v2, e2) for e2, k2, v2, i2, _ in rows if k2 == key and (i2, v2, e2) > (i, v, edge) and v2 >= v] if v is not None else []
        nxt = min(later, default=None)
        out[edge] = (closed, None) if closed else (nxt[1], nxt[0]) if nxt else (None, None)
    return out


@pytest.mark.parametrize("kind", ["random", "rising", "falling", "late"])
def test_supersession_over_many_tasks(spark, kind):
    rng = random.Random(6)
    rows = []
    for k in range(240):
        i = T + dt.timedelta(days=k)
        v = {"random": T + dt.timedelta(days=rng.randrange(60)), "rising": i, "falling": T - dt.timedelta(days=k), "late": i if rng.random() < 0.7 else T - dt.timedelta(days=rng.randrange(90))}[kind]
        rows.append((f"e{k:03}", "hot" if k % 3 else f"t{k % 4}", v, i, T if k % 29 == 5 else None))
    schema = "edge_id string, in_id string, t_valid timestamp_ntz, t_ingested timestamp_ntz, t_invalid timestamp_ntz"
    df = spark.createDataFrame(rows, schema).select("edge_id", "in_id", F.lit("r").alias("relation"), F.lit("o").alias("out_id"), "t_valid", "t_ingested", "t_invalid", F.lit(None).cast("timestamp_ntz").alias("t_invalid_ingested"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")  # the hot triple is cut into several tasks
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["edge_id"]: (r["t_invalid"], r["t_invalid_ingested"]) for r in graphs.close_superseded(df.repartition(5)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plain(rows)
