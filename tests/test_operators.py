"""Golden behaviours of operators, plans, store and streams on small fixtures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mnemospark import schemas
from mnemospark.functions import text
from mnemospark.operators import evals, extraction, fusion, graphs, lexical, lifecycle, relational
from mnemospark.operators import spans as spans_
from mnemospark.plans.engine import MemoryEngine
from mnemospark.plans.retrieval import ContextRequest, MemoryTables, assemble_context
from mnemospark.sources import store as S
from mnemospark.streaming import twins

D = lambda m, d, h=0: dt.datetime(2026, m, d, h)


def facts(spark, rows):
    base = dict(fact_type="note", quote="", source_episode="episode:seed", t_ingested=None, t_invalid=None, t_invalid_ingested=None, confidence=0.9, scope="personal", policy_tags=[], entity_links=[], index_keys=[])
    full = [base | {"t_ingested": r.get("t_valid")} | r for r in rows]
    return S.decode_facts(spark.createDataFrame([tuple(x.get(c) for c in schemas.FACT.names) for x in full], schemas.FACT))


def edges(spark, pairs, t=D(1, 1)):
    return spark.createDataFrame([(f"edge:{i}", a, "knows", b, t, t, None, None) for i, (a, b) in enumerate(pairs)],
                                 "edge_id string, in_id string, relation string, out_id string, t_valid timestamp_ntz, t_ingested timestamp_ntz, t_invalid timestamp_ntz, t_invalid_ingested timestamp_ntz")


def found(df):
    return [r["fact_id"] for r in df.orderBy("place").collect()]


def test_terms_need_not_be_adjacent_and_separators_split(spark):
    f = facts(spark, [{"fact_id": "a", "content": "the atlas_launch slipped", "t_valid": D(1, 1)}, {"fact_id": "b", "content": "nothing here", "t_valid": D(1, 1)}])
    assert found(assemble_context(MemoryTables(f), ContextRequest("atlas launch", "personal", D(2, 1)))) == ["a"]
    assert found(assemble_context(MemoryTables(f), ContextRequest("atlas budget", "personal", D(2, 1)))) == ["a"]  # one term of two
    assert found(assemble_context(MemoryTables(f), ContextRequest("zebra", "personal", D(2, 1)))) == []


def test_index_keys_match(spark):
    f = facts(spark, [{"fact_id": "a", "content": "signed", "t_valid": D(3, 15), "index_keys": ["march 2026", "2026-03", "alice smith"]}])
    for q in ("march 2026", "alice smith"):
        assert found(assemble_context(MemoryTables(f), ContextRequest(q, "personal", D(4, 1)))) == ["a"]


def test_scope_policy_and_episode_cap(spark):
    f = facts(spark, [{"fact_id": f"f{i}", "content": "salary plan", "t_valid": D(1, 1 + i), "source_episode": "episode:1"} for i in range(4)]
              + [{"fact_id": "secret", "content": "salary plan", "t_valid": D(1, 9), "policy_tags": ["hr.salary"]}, {"fact_id": "other", "content": "salary plan", "t_valid": D(1, 9), "scope": "org"}])
    got = found(assemble_context(MemoryTables(f), ContextRequest("salary", "personal", D(2, 1), allowed_tags=["deal.pipeline"])))
    assert len(got) == 2 and not {"secret", "other"} & set(got)
    assert found(assemble_context(MemoryTables(f), ContextRequest("salary", "personal", D(2, 1), allowed_scopes=["org"]))) == []


def test_timeline_window(spark):
    f = facts(spark, [{"fact_id": n, "content": "report", "t_valid": D(m, 15), "source_episode": f"episode:{n}"} for n, m in (("jan", 1), ("feb", 2), ("mar", 3))])
    r = ContextRequest("report", "personal", D(4, 1), view="timeline", window_start=D(2, 1), window_end=D(3, 31))
    assert found(assemble_context(MemoryTables(f), r)) == ["feb", "mar"]


def test_legs_and_fallback(spark):
    f = facts(spark, [{"fact_id": "lex", "content": "alice moves", "t_valid": D(1, 1), "source_episode": "episode:1"}, {"fact_id": "linked", "content": "unrelated words", "t_valid": D(1, 2), "entity_links": ["entity:b"], "source_episode": "episode:2"}])
    ent = spark.createDataFrame([("entity:a", "person", "Alice", "alice", ["al"]), ("entity:b", "person", "Bob", "bob", [])], schemas.ENTITY)
    eps = spark.createDataFrame([("episode:3", "alice wrote this", D(1, 3), "personal")], "episode_id string, content string, t_ref timestamp_ntz, scope string")
    t = MemoryTables(f, eps, ent, edges(spark, [("entity:a", "entity:b")]), spark.createDataFrame([], schemas.COMMUNITY))
    rows = assemble_context(t, ContextRequest("alice", "personal", D(2, 1))).orderBy("place").collect()
    assert [r["fact_id"] for r in rows] == ["lex", "linked", "episode:3"] and rows[2]["source_episode"] == "episode:3"


def test_reciprocal_rank_sums_over_legs(spark):
    f = facts(spark, [{"fact_id": "x", "content": "c", "t_valid": D(1, 1)}, {"fact_id": "y", "content": "c", "t_valid": D(1, 2)}]).withColumn("ft_score", F.lit(0.0))
    order = [F.col("fact_id")]
    legs = fusion.leg(f, "lexical", order).unionByName(fusion.leg(f.where("fact_id = 'y'"), "semantic", order))
    got = {r["fact_id"]: r["fusion_score"] for r in fusion.reciprocal_ranks(legs, D(1, 3)).collect()}
    assert got == {"x": pytest.approx(1 / 11), "y": pytest.approx(1 / 12 + 0.5 / 11)}


def test_intro_chain_and_paths(spark):
    e = edges(spark, [("entity:alice", "entity:bob"), ("entity:bob", "entity:openai"), ("entity:zed", "entity:alice")])
    assert graphs.intro_chain(e, "entity:openai", 2).first()["path"] == ["entity:alice", "entity:bob", "entity:openai"]
    assert graphs.intro_chain(e, "entity:openai", 3, dt.datetime(2020, 1, 1)).first() is None
    assert graphs.shortest_path(e, "entity:openai", "entity:zed")["path"] == ["entity:openai", "entity:bob", "entity:alice", "entity:zed"]
    assert graphs.shortest_path(e, "entity:openai", "entity:nobody")["status"] == "no_path"
    near = {r["node"]: r["distance"] for r in graphs.within_hops(e, spark.createDataFrame([("entity:alice",)], "node string"), 2).collect()}
    assert near == {"entity:bob": 1, "entity:openai": 2}


def test_overlapping_cohorts_are_one_community(spark):
    c = graphs.communities(edges(spark, [("entity:a", "entity:b"), ("entity:b", "entity:c"), ("entity:x", "entity:y")])).collect()
    assert sorted(r["member_entities"] for r in c) == [["entity:a", "entity:b", "entity:c"], ["entity:x", "entity:y"]]
    stored = spark.createDataFrame([("community:old", ["entity:a", "entity:b"], "", None)], schemas.COMMUNITY)
    assert graphs.stale_communities(stored, edges(spark, [("entity:a", "entity:b")])).count() == 1


def test_late_arrival_closes_nothing_newer(spark):
    rows = [("e1", D(1, 1), D(1, 1)), ("e2", D(2, 1), D(2, 1)), ("late", D(1, 15), D(3, 1))]
    e = spark.createDataFrame([(i, "a", "r", "b", v, t, None, None) for i, v, t in rows], edges(spark, []).schema)
    got = {r["edge_id"]: r["t_invalid"] for r in graphs.close_superseded(e).collect()}
    assert got == {"e1": D(2, 1), "e2": None, "late": None}


def test_diff_decay_archive(spark):
    f = facts(spark, [{"fact_id": "gone", "content": "c", "t_valid": D(1, 1), "t_invalid": D(2, 15), "t_invalid_ingested": D(2, 15)}, {"fact_id": "new", "content": "c", "t_valid": D(2, 20)}, {"fact_id": "stays", "content": "c", "t_valid": D(1, 1)}])
    assert {(r["fact_id"], r["change"]) for r in lifecycle.temporal_diff(f, D(2, 1), D(3, 1)).collect()} == {("gone", "removed"), ("new", "added")}
    later = f.where("fact_id = 'stays'").select("fact_id", F.lit("edited").alias("content"))
    assert ("stays", "changed") in {(r["fact_id"], r["change"]) for r in lifecycle.temporal_diff(f, D(2, 1), D(3, 1), later_versions=later).collect()}
    old = facts(spark, [{"fact_id": "cold", "content": "c", "confidence": 0.5, "t_valid": D(1, 1)}, {"fact_id": "hot", "content": "c", "confidence": 0.5, "t_valid": D(1, 1), "access_count": 2, "last_accessed": D(4, 1)}])
    assert [r["fact_id"] for r in lifecycle.decay_pass(old, D(4, 11), 0.26, 100.0).collect()] == ["cold"]
    eps = spark.createDataFrame([("e1", None, D(1, 1)), ("e2", "archived", D(1, 1)), ("e3", None, D(1, 1)), ("e4", None, D(6, 1))], "episode_id string, status string, t_ref timestamp_ntz")
    keep = facts(spark, [{"fact_id": "k", "content": "c", "t_valid": D(1, 1), "source_episode": "e3"}])
    assert [r["episode_id"] for r in lifecycle.archival_candidates(eps, keep, D(6, 2), 90).collect()] == ["e1"]


def test_nms_and_extraction(spark):
    spans = spark.createDataFrame([(1, "p", 0, 10, 0.9), (1, "p", 1, 10, 0.8), (1, "p", 20, 25, 0.5), (1, "q", 1, 10, 0.1)], "doc int, label string, start int, end int, score double")
    assert {(r["label"], r["start"]) for r in spans_.suppress_overlaps(spans, ["doc"]).collect()} == {("p", 0), ("p", 20), ("q", 1)}


def test_nms_is_the_greedy_choice(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.choice("pq"), a := rng.randrange(60), a + rng.randrange(0, 20), rng.randrange(8) / 8) for _ in range(300)]
    want = set()
    for group in {r[:2] for r in rows}:
        kept = []
        for s in sorted((r for r in rows if r[:2] == group), key=lambda r: (-r[4], r[2], r[3])):
            def iou(k):
                inter = max(0, min(k[3], s[3]) - max(k[2], s[2]))
                union = k[3] - k[2] + s[3] - s[2] - inter
                return inter / union if union > 0 else 0
            if all(iou(k) <= 0.5 for k in kept):
                kept.append(s)
        want |= set(kept)
    df = spark.createDataFrame(rows, "doc int, label string, start int, end int, score double")
    assert {tuple(r) for r in spans_.suppress_overlaps(df, ["doc"]).collect()} == want


def test_all_legs_take_part(spark):
    import os

    from mnemospark.plans import catalog

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    rows = catalog.QUERIES["assemble_context_all_legs"](spark, sf).collect()
    assert [r["place"] for r in rows] == list(range(1, len(rows) + 1)) and 0 < len(rows) <= 24
    assert len({r["fact_id"] for r in rows}) == len(rows)
    why = " ".join(r["rationale"] for r in rows)
    assert "community summary" in why and "semantic similarity" in why and "linked to an entity" in why


def test_metrics(spark):
    cases = spark.createDataFrame([("a", "direct", ["Launch plan", "budget"], ["secret"], False), ("b", "direct", [], [], True)], "id string, tier string, must_contain array<string>, must_not_contain array<string>, expect_empty boolean")
    results = spark.createDataFrame([("a", 1, "other"), ("a", 2, "the LAUNCH  plan")], "id string, rank int, content string")
    r = evals.retrieval_metrics(cases, results, by_tier=False).first()
    assert (r["cases"], r["recall_sum"], r["precision_sum"], r["reciprocal_rank_sum"], r["passed"], r["empty_hits"]) == (2, 1.5, 1.5, 1.5, 1, 1)
    s = spark.createDataFrame([("op", float(x)) for x in range(1, 11)], "op string, v double")
    assert tuple(evals.latency_percentiles(s, "op", "v").first())[1:] == (6.0, 10.0, 10.0)


def test_asof_and_aliases(spark):
    left = spark.createDataFrame([("k", 1, 5), ("k", 2, 1), ("z", 3, 9)], "key string, id int, t int")
    right = spark.createDataFrame([("k", 3, "early"), ("k", 5, "same")], "key string, t int, v string")
    assert {(r["id"], r["v_asof"]) for r in relational.asof_join(left, right, "key", "t", "t", "v").collect()} == {(1, "same"), (2, None), (3, None)}
    ent = spark.createDataFrame([("entity:a", "person", "Bob Stone", "bob stone", ["bobby"]), ("entity:b", "person", "bobby", "bobby", [])], schemas.ENTITY)
    names = spark.createDataFrame([("BOBBY",), ("bob  stone",), ("x",)], "name string")
    assert {r["name"]: (r["entity_id"], r["matched"]) for r in relational.resolve_names(names, ent).collect()} == {"BOBBY": ("entity:b", "canonical"), "bob  stone": ("entity:a", "canonical")}


def test_engine_round_trip(spark, tmp_path):
    e = MemoryEngine(S.MemoryStore(spark, f"file://{tmp_path}/mem"))
    eps = spark.createDataFrame([("chat", "1", "Alice Smith: ARR is $3M. I will send it.", D(3, 1, 10), "personal"), ("chat", "2", " ", D(3, 1), "personal")], "source_type string, source_id string, content string, t_ref timestamp_ntz, scope string")
    assert e.ingest(eps, D(3, 2)).count() == 1 and e.rejected(eps).count() == 1
    e.ingest(eps, D(3, 3))
    assert e.store.read("episode").count() == 1
    out = e.extract(e.store.read("episode"), D(3, 2))
    assert {r["fact_type"] for r in out["facts"].collect()} == {"metric", "promise"}
    e.extract(e.store.read("episode"), D(3, 2))
    stored = e.store.read("fact")
    assert stored.count() == 2
    ctx = e.assemble_context(ContextRequest("ARR", "personal", D(4, 1)), now=D(4, 1))
    assert ctx.count() == 2
    assert e.store.read("access_log").count() == 2
    fid = stored.first()["fact_id"]
    req = spark.createDataFrame([(fid, "wrong", D(3, 20))], "fact_id string, reason string, t_invalid timestamp_ntz")
    assert e.invalidate(req, D(3, 21), dry_run=True).count() == 1 and e.store.read("fact").where("t_invalid IS NOT NULL").count() == 0
    e.invalidate(req, D(3, 21))
    assert e.store.read("fact").where("t_invalid IS NOT NULL").count() == 1 and e.invalidate(req, D(3, 22)).count() == 0
    assert e.explain([fid]).first()["all_sources"][0]["kind"] == "direct"
    twice = spark.createDataFrame([(f"edge:{i}", "entity:a", "knows", "entity:b", D(1, i), D(1, i)) for i in (1, 2)], "edge_id string, in_id string, relation string, out_id string, t_valid timestamp_ntz, t_ingested timestamp_ntz")
    e.relate(twice.where("edge_id = 'edge:1'"), D(1, 1))
    e.relate(twice.where("edge_id = 'edge:2'"), D(1, 2))
    own = e.store.read("edge").where("relation = 'knows'")
    assert own.count() == 2 and own.where("t_invalid IS NULL").count() == 1
    with pytest.raises(ValueError):
        e.app_command("archive", D(5, 1), dry_run=False)
    with pytest.raises(ValueError):
        e.store.read("nothing")


def test_drafts(spark):
    items = spark.createDataFrame([("d", "i1", "entity", "approved", json.dumps({"name": "Acme"})), ("d", "i2", "fact", "edited", json.dumps({"content": "c"})), ("d", "i3", "edge", "approved", json.dumps({"from": "acme", "to": "i2"})), ("d", "i4", "fact", "rejected", "{}")],
                                  "draft_id string, item_id string, item_type string, status string, payload string")
    plan = {r["item_id"]: (r["stage"], r["src"], r["dst"]) for r in lifecycle.draft_commit_plan(items).collect()}
    assert plan == {"i1": (1, None, None), "i2": (2, None, None), "i3": (3, "i1", "i2")}
    r = lifecycle.draft_summary(items).first()
    assert (r["entities"], r["facts"], r["edges"], r["rejected"]) == (1, 2, 1, 1)


def test_fixture_contracts(spark, tmp_path):
    case = {"id": "x", "description": "", "episodes": [], "query": {"query": "q", "scope": "s", "budget": 0}, "expected": {"must_contain": ["a"], "must_not_contain": [], "expect_empty": True, "tier": "odd"}}
    (tmp_path / "c.json").write_text(json.dumps([case, case]))
    bad = S.check_retrieval_cases(S.read_json_cases(spark, f"file://{tmp_path}/c.json", schemas.RETRIEVAL_CASE))
    assert {r["reason"] for r in bad.collect()} == {"duplicate id", "expect_empty with must_contain", "budget must be positive", "unknown tier"}


def test_streams_match_batches(spark, tmp_path):
    rows = [("a", "r", "b", f"e{i}", D(1, v), D(1, t)) for i, (v, t) in enumerate([(1, 1), (5, 5), (3, 7)])]
    df = spark.createDataFrame(rows, "in_id string, relation string, out_id string, edge_id string, t_valid timestamp_ntz, t_ingested timestamp_ntz")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/edges")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/edges")
    got = twins.run_available(twins.supersede(stream), "closed").collect()
    assert [(r["edge_id"], r["t_invalid"].replace(tzinfo=None)) for r in got] == [("e0", D(1, 5))]
    sink = twins.insert_new(spark, f"file://{tmp_path}/out", "edge_id")
    sink(df, 0)
    sink(df, 0)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 3
    logs = spark.createDataFrame([("f", 1, D(1, 1)), ("f", 3, D(1, 2))], schemas.ACCESS_LOG)
    logs.write.parquet(f"file://{tmp_path}/log")
    live = twins.run_available(twins.heat(spark.readStream.schema(schemas.ACCESS_LOG).parquet(f"file://{tmp_path}/log")), "live_heat", "complete").collect()
    assert live == lifecycle.heat(logs).collect()
