"""Verbs that write: drafts, communities, re-embedding, lifecycle console, migrations, sessions, cache."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mnemospark import schemas
from mnemospark.operators import graphs
from mnemospark.plans.engine import MemoryEngine
from mnemospark.plans.retrieval import ContextRequest
from mnemospark.plans.sessions import ContextCache, TokenBucket
from mnemospark.sources import store as S

D = lambda m, d: dt.datetime(2026, m, d)
FACTS = "fact_type string, content string, quote string, source_episode string, t_valid timestamp_ntz, confidence double, entity_links array<string>, scope string"


@pytest.fixture()
def engine(spark, tmp_path):
    return MemoryEngine(S.MemoryStore(spark, f"file://{tmp_path}/mem"), cache=ContextCache())


def test_draft_is_stored_and_closed(spark, engine):
    p = lambda **x: json.dumps(x)
    items = spark.createDataFrame([("i1", "entity", p(name="Acme", entity_type="company"), 0.9), ("i2", "fact", p(content="Acme signed the deal", fact_type="decision", entity_links=["acme"]), 0.8),
                                   ("i3", "entity", p(name="Bob"), 0.9), ("i4", "edge", {"from": "bob", "to": "i1", "relation": "works_at"} and p(**{"from": "bob", "to": "i1", "relation": "works_at"}), 0.7), ("i5", "fact", p(content="rejected"), 0.5)],
                                  "item_id string, item_type string, payload string, confidence double")
    assert engine.create_draft("d", "personal", items, D(3, 1)).first()["pending"] == 5
    engine.app_command("approve", D(3, 1), dry_run=False, item_ids=["i1", "i2", "i3", "i4"])
    engine.app_command("reject", D(3, 1), dry_run=False, item_ids=["i5"])
    assert engine.app_command("commit", D(3, 2), draft_id="d").count() == 4 and engine.store.read("fact").count() == 0
    with pytest.raises(ValueError):
        engine.app_command("commit", D(3, 2), dry_run=False, draft_id="d")
    done = engine.app_command("commit", D(3, 2), dry_run=False, confirmed=True, draft_id="d").first()
    assert (done["entities"], done["facts"], done["edges"]) == (2, 1, 2)
    fact = engine.store.read("fact").first()
    acme = engine.store.read("entity").where("canonical_name = 'Acme'").first()["entity_id"]
    assert fact["entity_links"] == [acme] and fact["source_episode"] == done["source_episode"] and "acme" in fact["index_keys"]
    assert {(r["relation"], r["in_id"] == acme, r["out_id"] == acme) for r in engine.store.read("edge").collect()} == {("involved_in", True, False), ("works_at", False, True)}
    assert engine.store.read("community").count() == 1 and engine.store.read("episode").count() == 1
    assert engine.store.read("draft_ingestion").first()["status"] == "committed"
    with pytest.raises(ValueError):
        engine.commit_draft("d", D(3, 3))


def test_a_commit_that_failed_is_run_again_later(spark, engine, monkeypatch):
    items = spark.createDataFrame([("i1", "entity", json.dumps({"name": "Acme"})), ("i2", "fact", json.dumps({"content": "Acme signed", "entity_links": ["acme"], "source_text": "Acme signed."}))], "item_id string, item_type string, payload string")
    engine.create_draft("d", "personal", items, D(3, 1))
    engine.app_command("approve", D(3, 1), dry_run=False, item_ids=["i1", "i2"])
    with monkeypatch.context() as m:
        m.setattr(MemoryEngine, "_update_communities", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            engine.commit_draft("d", D(3, 1) + dt.timedelta(hours=1))
    engine.commit_draft("d", D(3, 1) + dt.timedelta(hours=3))
    assert [engine.store.read(t).count() for t in ("episode", "entity", "fact", "edge")] == [1, 1, 1, 1]


def test_an_id_read_reads_no_vectors_and_an_indexed_engine_finds_stems(spark, tmp_path):
    e = MemoryEngine(S.MemoryStore(spark, f"file://{tmp_path}/ix"), indexed=True)
    rows = [("note", "Running shoes at the café", "", "episode:1", D(1, 2), 0.9, [], "personal"), ("note", "nothing like it", "", "episode:2", D(1, 3), 0.9, [], "personal")]
    e.add_facts(spark.createDataFrame(rows, FACTS), D(1, 4))
    e.add_facts(spark.createDataFrame(rows[:1], FACTS), D(1, 5))  # known: stored and indexed once
    assert e.content_index.statistics().first()["docs"] == 2
    plan = e.store.read("fact").select("fact_id")._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan and "content" not in plan
    assert [r["content"] for r in e.assemble_context(ContextRequest("runs cafe", "personal", D(2, 1))).collect()] == ["Running shoes at the café"]


def test_a_fact_without_text_stops_a_commit(spark, engine):
    engine.create_draft("e", "personal", spark.createDataFrame([("i", "fact", "{}")], "item_id string, item_type string, payload string"), D(3, 1))
    engine.app_command("approve", D(3, 1), dry_run=False, item_ids=["i"])
    with pytest.raises(ValueError, match="without content"):
        engine.commit_draft("e", D(3, 1))


def test_facts_are_found_by_their_entities_and_the_cache_forgets(spark, engine):
    found = engine.resolve_typed("person", ["Alice Stone"], D(1, 1)).first()["entity_id"]
    engine.add_facts(spark.createDataFrame([("note", "signed", "", "episode:1", D(1, 2), 0.9, [found], "personal")], FACTS), D(1, 2))
    ask = ContextRequest("alice stone", "personal", D(2, 1))
    assert engine.assemble_context(ask).count() == 1 and len(engine.cache.rows) == 1
    engine.add_facts(spark.createDataFrame([("note", "alice stone again", "", "episode:2", D(1, 3), 0.9, [], "personal")], FACTS), D(1, 3))
    assert len(engine.cache.rows) == 0 and engine.assemble_context(ask).count() == 2
    old = engine.store.read("fact").where("content = 'signed'").first()["fact_id"]
    assert engine.supersede_metric(old, 7, D(1, 5), D(1, 6)).count() == 1 and engine.supersede_metric("fact:none", 7, D(1, 5), D(1, 7)).count() == 0
    assert "Superseded by 7" in engine.store.read("fact").where(F.col("fact_id") == old).first()["provenance"].values()


def test_reembedding_goes_on_where_it_stopped(spark, engine):
    engine.add_facts(spark.createDataFrame([("note", f"c{i}", "", "episode:1", D(1, 2), 0.9, [], "personal") for i in range(5)], FACTS), D(1, 2), lambda t: F.array(F.lit(1.0)))
    two = lambda t: F.array(F.lit(2.0), F.lit(2.0))
    assert engine.reembed("p", "m2", 2, two, D(2, 1), batch=3) == {"status": "migrating", "staged": 3}
    assert all(r["embedding"] == [1.0] for r in engine.store.read("fact").collect())
    assert engine.reembed("p", "m2", 2, two, D(2, 2), batch=3) == {"status": "ready", "staged": 2}
    assert all(r["embedding"] == [2.0, 2.0] and r["embedding_next"] is None for r in engine.store.read("fact").collect())
    assert engine.reembed("p", "m2", 2, two, D(2, 3)) == {"status": "ready", "staged": 0}


def test_console_archival_and_sessions(spark, engine):
    eps = spark.createDataFrame([("chat", str(i), "text", D(1, 1 + i), "personal") for i in range(3)], "source_type string, source_id string, content string, t_ref timestamp_ntz, scope string")
    engine.ingest(eps, D(1, 9))
    names = [r["episode_id"] for r in engine.store.read("episode").orderBy("t_ref").collect()]
    engine.add_facts(spark.createDataFrame([("note", "weak", "", names[2], D(1, 2), 0.3, [], "personal")], FACTS), D(1, 9))
    sid, view = engine.open_session("lifecycle", "personal", D(6, 1), view="archival_candidates")
    assert [r["episode_id"] for r in view.collect()] == names[:2]
    engine.act_in_session(sid, "archive_episodes", D(6, 1), dry_run=False, confirmed=True, episode_ids=names[:1])
    assert [r["episode_id"] for r in engine.refresh_session(sid, D(6, 1), view="archived").collect()] == names[:1]
    assert engine.refresh_session(sid, D(6, 1), view="low_confidence").count() == 1
    engine.close_session(sid)
    with pytest.raises(KeyError):
        engine.refresh_session(sid, D(6, 1))
    assert engine.maintain(D(6, 2)) == {"decayed": 1, "archived": 2}
    engine.limiter = TokenBucket(1, 1)
    engine.assemble_context(ContextRequest("x", "personal", D(6, 2)), now=D(6, 2))
    with pytest.raises(RuntimeError):
        engine.assemble_context(ContextRequest("x", "personal", D(6, 2)), now=D(6, 2))


def test_migrations_run_once_and_may_not_change(engine):
    scripts = [("001", "entity", "SELECT 'entity:x' AS entity_id, 'concept' AS entity_type, 'X' AS canonical_name")]
    assert engine.store.migrate(scripts, 1) == ["001"] and engine.store.migrate(scripts, 2) == [] and engine.store.read("entity").count() == 1
    with pytest.raises(ValueError):
        engine.store.migrate([("001", "entity", "SELECT 1 AS entity_id")], 3)


def test_communities_keep_an_id_and_overlaps_go(spark):
    stored = spark.createDataFrame([("community:b", ["entity:1", "entity:2"], "", None), ("community:a", ["entity:3"], "", None), ("community:z", ["entity:9"], "", None)], schemas.COMMUNITY)
    new = spark.createDataFrame([("community:n", ["entity:1", "entity:2", "entity:3"], "", None)], schemas.COMMUNITY)
    kept = graphs.upsert_communities(stored, new)
    assert [r["community_id"] for r in kept.collect()] == ["community:a"]
    assert [r["community_id"] for r in graphs.overlapped_communities(stored, kept).collect()] == ["community:b"]


def test_a_scope_prunes_folders(spark, engine):
    engine.add_facts(spark.createDataFrame([("note", s, "", "episode:1", D(1, 2), 0.9, [], s) for s in ("personal", "org")], FACTS), D(1, 2))
    plan = engine.store.read("fact").where("scope = 'org'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scope" in plan and engine.store.read("fact").where("scope = 'org'").count() == 1
