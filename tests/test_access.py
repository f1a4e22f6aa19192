"""Scope, tags, time and window hold in every leg of a context and in its fallback."""

import dataclasses
import datetime as dt

import pytest

from mnemospark import schemas
from mnemospark.plans.retrieval import ContextRequest, MemoryTables, assemble_context
from mnemospark.sources import store as S

T = dt.datetime(2026, 1, 2)


def row(schema, **x):
    return tuple(x.get(c) for c in schema.names)


@pytest.fixture(scope="module")
def tables(spark):
    def fact(i, content, links, tags, scope="private", episode="episode:has", **more):
        return row(schemas.FACT, fact_id=i, fact_type="note", content=content, quote="", source_episode=episode, t_valid=T, t_ingested=T, confidence=0.9, entity_links=links, scope=scope,
                   policy_tags=tags, index_keys=[], **more)

    def episode(i, tags, day=2):
        return row(schemas.EPISODE, episode_id=i, source_type="s", source_id=i, content="alice wrote a note", t_ref=dt.datetime(2026, 1, day), t_ingested=T, scope="private", policy_tags=tags)

    facts = S.decode_facts(spark.createDataFrame([fact("lexical", "alice said so", [], []), fact("tagged", "alice said more", [], ["hr"]), fact("linked", "words", ["entity:a"], []), fact("linked-hr", "words", ["entity:a"], ["hr"]),
                                                  fact("near", "words", [], ["hr"], embedding=[1.0, 0.0]), fact("next", "words", ["entity:b"], []), fact("summary", "words", ["entity:c"], []),
                                                  fact("other", "alice elsewhere", [], [], "org"), fact("решение", "принято решение по договору", [], []), fact("nick", "al was here", [], [])], schemas.FACT))
    episodes = spark.createDataFrame([episode("episode:free", []), episode("episode:hr", ["hr"]), episode("episode:late", [], 20)], schemas.EPISODE)
    entities = spark.createDataFrame([row(schemas.ENTITY, entity_id="entity:a", entity_type="person", canonical_name="Alice", canonical_name_normalized="alice", aliases=["Al"])], schemas.ENTITY)
    edges = spark.createDataFrame([row(schemas.EDGE, edge_id="edge:1", in_id="entity:a", relation="knows", out_id="entity:b", t_valid=T, t_ingested=T)], schemas.EDGE)
    communities = spark.createDataFrame([("community:1", ["entity:c"], "alice and friends", T)], schemas.COMMUNITY)
    return MemoryTables(facts, episodes, entities, edges, communities)


def ids(tables, **x):
    r = dataclasses.replace(ContextRequest("alice", "private", dt.datetime(2026, 2, 1), 20, embedding=[1.0, 0.0]), **x)
    return {i["fact_id"] for i in assemble_context(tables, r).collect()}


def test_every_leg_answers(tables):
    assert ids(dataclasses.replace(tables, facts=tables.facts.withColumn("source_episode", tables.facts.fact_id))) == {"lexical", "tagged", "linked", "linked-hr", "near", "next", "summary", "nick", "episode:free", "episode:hr", "episode:late"}


def test_a_refused_scope_gives_nothing(tables):
    assert ids(tables, allowed_scopes=["org"]) == set()
    assert ids(tables, allowed_scopes=["org"], cross_scope=[{"from": "*", "to": "private"}]) != set()


def test_tags_hold_everywhere(tables):
    own = dataclasses.replace(tables, facts=tables.facts.withColumn("source_episode", tables.facts.fact_id))
    assert ids(own, allowed_tags=["none"]) == {"lexical", "linked", "next", "summary", "nick", "episode:free", "episode:late"}


def test_window_and_time_hold_for_the_fallback(tables):
    assert "episode:late" not in ids(tables, window_end=dt.datetime(2026, 1, 10)) and "episode:late" not in ids(tables, as_of=dt.datetime(2026, 1, 10))


def test_other_alphabets(tables):
    assert ids(tables, query="решение", embedding=None) == {"решение"}
    assert ids(tables, query="зарплата", embedding=None) == set() and ids(tables, query="?!", embedding=None) == set()


def test_rewrites_use_aliases(tables):
    got = {i["fact_id"]: i["rationale"] for i in assemble_context(tables, ContextRequest("Alice", "private", dt.datetime(2026, 2, 1), 20)).collect()}
    assert got["nick"] == "matched rewrite Al"
