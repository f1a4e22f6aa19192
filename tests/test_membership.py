"""Membership rows, digests and components kept up to date, against brute force."""

import random

from pyspark.sql import functions as F

from mnemospark.operators import graphs, membership


def edges(spark, pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], "in_id string, out_id string")


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def labels(df):
    return {r["node"]: r["component"] for r in df.collect()}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(80)] + [("chain0", "n0")] + [(f"chain{k}", f"chain{k + 1}") for k in range(40)] + [("self", "self"), ("hub", "n1"), *[("hub", f"leaf{k}") for k in range(300)]]
    assert labels(graphs.components(edges(spark, pairs))) == brute(pairs)
    assert labels(graphs.components(edges(spark, []))) == {} and labels(graphs.components(edges(spark, [("x", "x")]))) == {"x": "x"}


def test_updates_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(2)
    store, now = membership.ComponentStore(spark, f"file://{tmp_path}/c", 8), set()
    for k in range(3):
        added = {(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(25)} - now
        removed = set(rng.sample(sorted(now), min(len(now), 7))) if k else None
        now = (now - (removed or set())) | added
        store.update(edges(spark, now), edges(spark, added), edges(spark, removed) if removed is not None else None)
        assert labels(store.labels()) == brute(now)
        assert labels(store._table("by_component").select("node", "component")) == brute(now)
    # an edge far from a component does not touch its folder
    before = {r["path"] for r in store._table("by_component").select(F.input_file_name().alias("path")).distinct().collect()}
    store.update(edges(spark, now | {("zz1", "zz2")}), edges(spark, [("zz1", "zz2")]))
    after = {r["path"] for r in store._table("by_component").select(F.input_file_name().alias("path")).distinct().collect()}
    assert len(before - after) <= 1 and labels(store.labels()) == brute(now | {("zz1", "zz2")})


def test_membership_rows(spark):
    pairs = [("entity:a", "entity:b"), ("entity:b", "fact:1"), ("entity:c", "fact:2"), *[("entity:z", f"entity:m{k:03}") for k in range(500)]]
    rows = membership.members_of(graphs.components(edges(spark, pairs))).cache()
    names = spark.createDataFrame([("entity:a", "Bea"), ("entity:b", "Al"), ("entity:m001", None)], "entity_id string, canonical_name string")
    got = {r["n_members"]: r["summary"] for r in membership.summaries(rows, names).collect()}
    assert got == {2: "Al, Bea", 501: "entity:m000, entity:m001, entity:m002"}  # one entity alone is no community
    turned = rows.orderBy(F.col("entity_id").desc()).repartition(7)
    assert {tuple(r) for r in membership.digests(turned, "component").collect()} == {tuple(r) for r in membership.digests(rows, "component").collect()}
    stored = rows.select("community_id", "entity_id")
    assert membership.stale(stored, rows).count() == 0
    drifted = stored.where("entity_id <> 'entity:m007'").unionByName(spark.createDataFrame([("community:one", "entity:q")], stored.schema))
    assert {r["reason"] for r in membership.stale(drifted, rows).collect()} == {"too_small", "drifted"}
    assert membership.members_of(graphs.components(edges(spark, []))).count() == 0
