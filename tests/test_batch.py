"""Batch retrieval against single calls, and the suites from JSON cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mnemospark.operators.postings import FullTextIndex
from mnemospark.plans import batch, suites
from mnemospark.plans.retrieval import ContextRequest, MemoryTables, assemble_context
from mnemospark.schemas import TABLES
from mnemospark.sources.store import conform

T = dt.datetime(2026, 3, 15)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    words = ["alice atlas deck", "atlas launch review", "quarterly revenue review", "bob met alice", "launch of the deck", "nothing of note"]
    facts = [(f"fact:{i}", "metric" if i % 4 == 0 else "note", f"{words[i % 6]} {i}", f"episode:{i // 3}", T - dt.timedelta(days=i), T - dt.timedelta(days=i), T if i % 9 == 8 else None, T if i % 9 == 8 else None, 0.5 + i % 5 / 10,
              [f"entity:{'ab'[i % 2]}"] if i % 3 else [], ["org", "private"][i % 7 == 6], ["secret"] if i % 5 == 4 else [], ["march 2026"] if i % 2 else ["february 2026"]) for i in range(60)]
    f = conform(spark.createDataFrame(facts, "fact_id string, fact_type string, content string, source_episode string, t_valid timestamp_ntz, t_ingested timestamp_ntz, t_invalid timestamp_ntz, t_invalid_ingested timestamp_ntz, confidence double, entity_links array<string>, scope string, policy_tags array<string>, index_keys array<string>"), TABLES["fact"]).drop("embedding").cache()
    entities = spark.createDataFrame([("entity:a", "person", "Alice", "alice", ["Ally Smith"]), ("entity:b", "person", "Bob", "bob", []), ("entity:c", "company", "Corp", "corp", ["the firm"])], "entity_id string, entity_type string, canonical_name string, canonical_name_normalized string, aliases array<string>")
    edges = spark.createDataFrame([("e1", "entity:c", "knows", "entity:b", T - dt.timedelta(days=90), None, None, None)], "edge_id string, in_id string, relation string, out_id string, t_valid timestamp_ntz, t_ingested timestamp_ntz, t_invalid timestamp_ntz, t_invalid_ingested timestamp_ntz")
    communities = spark.createDataFrame([("community:1", ["entity:a", "entity:c"], "Alice, Corp"), ("community:2", ["entity:b"], "Bob of the launch")], "community_id string, member_entities array<string>, summary string")
    path = f"file://{tmp_path_factory.mktemp('ix')}"
    content, keys = FullTextIndex(spark, f"{path}/c", 2), FullTextIndex(spark, f"{path}/k", 2)
    content.add(f, "fact_id", "content")
    keys.add(f.withColumn("index_keys", F.array_join("index_keys", " ")), "fact_id", "index_keys")
    return MemoryTables(f, None, entities, edges, communities, content, keys)


def test_batch_equals_single_calls(spark, tables):
    asked = [("a", "alice atlas deck", "org", 5, None, None), ("b", "", "org", 4, None, None), ("c", "launches of the firm", "org", 6, "timeline", None), ("d", "who knows Corp", "org", 8, None, None),
             ("e", "review last month", "private", 5, None, None), ("f", "Alice", "org", 3, None, ["other"]), ("g", "zzzz", "nowhere", 5, None, None), ("h", "AND OR", "org", 5, None, None), ("i", "deck zzzz", "org", 7, None, ["secret"])]
    requests = spark.createDataFrame([(i, q, s, T, b, v, tags) for i, q, s, b, v, tags in asked], "request_id string, query string, scope string, as_of timestamp_ntz, budget int, view string, allowed_tags array<string>")
    got = {}
    for r in batch.assemble_contexts(tables, requests).collect():
        got.setdefault(r["request_id"], []).append(tuple(r)[1:])
    assert set(got) == {"a", "b", "c", "d", "e", "f", "i"}
    for i, q, s, b, v, tags in [x for x in asked if x[0] in "abcdei"]:
        want = [tuple(r) for r in assemble_context(tables, ContextRequest(q, s, T, b, view=v or "relevance", allowed_tags=tags)).collect()]
        assert sorted(got.get(i, [])) == sorted(want), i


def test_suites(spark, tables, tmp_path):
    episode = lambda sid, content, day: {"source_type": "chat", "source_id": sid, "content": content, "t_ref": f"2026-03-{day:02d}T09:00:00Z", "scope": "personal"}
    case = lambda i, episodes, query, **expected: {"id": i, "description": "", "episodes": episodes, "query": {"query": query, "scope": "personal", "budget": 5, "as_of": None},
                                                   "expected": {"must_contain": [], "must_not_contain": [], "expect_empty": False} | expected}
    cases = [case("r1", [episode("1", "Alice will send the Atlas deck by Friday.", 1), episode("2", "We discussed unrelated travel plans for the whole of next week.", 1)], "alice atlas deck", must_contain=["Atlas deck"], must_not_contain=["travel plans"]),
             case("r2", [episode("1", "We discussed launch readiness and the deployment timing in detail.", 2)], "Robert passport", expect_empty=True, must_not_contain=["launch"]),
             case("r3", [episode("1", "The decision was approved by Carol Jones in the budget meetings.", 3)], "meeting of carol", must_contain=["approved by Carol"])]
    (tmp_path / "r.json").write_text(json.dumps(cases))
    contexts, metrics = suites.retrieval_suite(spark, str(tmp_path / "r.json"))
    m = metrics.first()
    assert (m["cases"], m["recall_sum"], m["passed"], m["empty_hits"]) == (3, 3.0, 3, 1)
    assert all("travel" not in r["content"] for r in contexts.where("request_id = 'r1'").collect())
    (tmp_path / "bad.json").write_text(json.dumps([*cases, cases[0]]))
    with pytest.raises(ValueError, match="duplicate id"):
        suites.retrieval_suite(spark, str(tmp_path / "bad.json"))
    extraction = [{"id": "x1", "description": "", "content": "Acme Corp approved the plan with Carol Jones.", "scope": "org", "t_ref": "2026-03-01T00:00:00Z", "expected": {"entities": [{"entity_type": "company", "canonical_name": "Acme Corp"}, {"entity_type": "person", "canonical_name": "Carol Jones"}], "fact_types": ["decision", "metric"]}}]
    (tmp_path / "x.json").write_text(json.dumps(extraction))
    entities, types = suites.extraction_suite(spark, str(tmp_path / "x.json"))
    assert tuple(entities.first())[:3] == (2, 0, 0) and tuple(types.first()) == (1, 2, 0.5)
    p = suites.run_latency(tables, ContextRequest("alice", "org", T, 3), 0, 2).first()
    assert 0 < p["p50"] <= p["p99"]
