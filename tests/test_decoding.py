"""Decoders with defaults, lookups over namespaces, exports, edges by default, failing providers, the inspector."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import temporal
from mnemospark.operators import relational
from mnemospark.plans.engine import MemoryEngine
from mnemospark.sources import store as S

T = dt.datetime(2026, 1, 1)


def test_decoders(spark):
    e = S.decode_episodes(spark.createDataFrame([("e1", "c", "org", T), ("e2", None, "org", T)], "episode_id string, content string, scope string, t_ref timestamp_ntz")).collect()
    assert [(r["episode_id"], r["t_ingested"], r["visibility_scope"], r["policy_tags"]) for r in e] == [("e1", T, "org", [])]
    c = S.decode_communities(spark.createDataFrame([("c1", ["a"], "x"), ("c2", [], "x"), ("c3", ["a"], " "), ("c4", None, "x")], "community_id string, member_entities array<string>, summary string")).collect()
    assert [r["community_id"] for r in c] == ["c1"]
    g = S.decode_edges(spark.createDataFrame([("g1", "a", "r", "b"), ("g2", "a", None, "b")], "edge_id string, in_id string, relation string, out_id string")).collect()
    assert [(r["edge_id"], r["strength"], r["confidence"]) for r in g] == [("g1", 0.0, 0.0)]


def test_times_and_namespaces(spark):
    texts = ["2026-03-01T10:00:00Z", "2026-03-01t10:00:00.1234567+02:30", "2026-03-01 10:00:00-01:00", "2026-03-01T10:00:00", "soon", "2026-13-01T10:00:00Z", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(temporal.parse_rfc3339("t")).collect()]
    assert got == [dt.datetime(2026, 3, 1, 10), dt.datetime(2026, 3, 1, 7, 30, 0, 123456), dt.datetime(2026, 3, 1, 11), None, None, None, None]
    rows = spark.createDataFrame([("k", "private", 1), ("k", "org", 2), ("j", "org", 3)], "id string, scope string, n int")
    assert [r["n"] for r in relational.find_in_namespaces(rows, "id", "k", ["personal", "private", "org"]).collect()] == [1]
    assert relational.find_in_namespaces(rows, "id", "k", ["personal"]).count() == 0


def test_diff_exports(spark, tmp_path):
    diff = spark.createDataFrame([("f1", "note", "a", "added"), ("f2", "note", "b", "added"), ("f3", "note", "c", "removed")], "fact_id string, fact_type string, content string, change string")
    S.write_diff(diff, f"file://{tmp_path}/j")
    rows = [json.loads(x) for p in (tmp_path / "j").glob("change=added/*.json") for x in p.read_text().splitlines()]
    assert sorted(r["fact"]["fact_id"] for r in rows) == ["f1", "f2"]
    S.write_diff(diff, f"file://{tmp_path}/m", "markdown")
    assert sorted(x for p in (tmp_path / "m").glob("*.txt") for x in p.read_text().splitlines()) == ["- added: 2", "- removed: 1"]


def test_edges_by_default_failing_providers_and_the_inspector(spark, tmp_path):
    engine = MemoryEngine(S.MemoryStore(spark, f"file://{tmp_path}/m"))
    names = {r["name"]: r["entity_id"] for r in engine.resolve_typed("person", ["Ann", "Ben", "Cy"], T).collect()}
    ann, ben, cy = (names[n] for n in ("Ann", "Ben", "Cy"))
    engine.relate(spark.createDataFrame([(ann, "knows", ben), (cy, "knows", ann)], "in_id string, relation string, out_id string"), T)
    edge = engine.store.read("edge").where(F.col("in_id") == ann).first()
    assert (edge["strength"], edge["confidence"], edge["t_valid"], edge["t_ingested"]) == (1.0, 0.8, T, T) and edge["edge_id"].startswith("edge:")
    engine.app_command("rebuild_communities", T, dry_run=False, confirmed=True)

    @F.udf("array<double>")
    def broken(text):
        raise RuntimeError("no provider")

    facts = spark.createDataFrame([("note", "Ann met Ben", "", "episode:1", T, 0.9, [ann], "org")], "fact_type string, content string, quote string, source_episode string, t_valid timestamp_ntz, confidence double, entity_links array<string>, scope string")
    with pytest.warns(UserWarning, match="without vectors"):
        engine.add_facts(facts, T, broken)
    assert [(r["content"], r["embedding"]) for r in engine.store.read("fact").collect()] == [("Ann met Ben", None)]
    seen = engine.inspect(ann, T + dt.timedelta(days=1)).first()
    assert [x["neighbour"] for x in seen["outgoing"]] == [ben] and [x["neighbour"] for x in seen["incoming"]] == [cy]
    assert [x["content"] for x in seen["facts"]] == ["Ann met Ben"] and len(seen["communities"]) == 1
