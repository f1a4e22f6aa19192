"""The entity leg's limit counts allowed facts only."""

import datetime as dt

from mnemospark import schemas
from mnemospark.plans.retrieval import ContextRequest, MemoryTables, assemble_context
from mnemospark.sources import store as S


def fact(fact_id, hour, tag):
    t = dt.datetime(2026, 1, 2, hour)
    x = dict(fact_id=fact_id, fact_type="note", content="words", quote="", source_episode=f"episode:{fact_id}", t_valid=t, t_ingested=t, confidence=0.9, entity_links=["entity:a"], scope="personal", policy_tags=[tag], index_keys=[])
    return tuple(x.get(c) for c in schemas.FACT.names)


def test_disallowed_facts_take_no_places(spark):
    f = S.decode_facts(spark.createDataFrame([fact("open", 0, "ok")] + [fact(f"h{i}", i + 1, "hr") for i in range(8)], schemas.FACT))
    ent = spark.createDataFrame([("entity:a", "person", "Alice", "alice", [])], schemas.ENTITY)
    r = ContextRequest("alice", "personal", dt.datetime(2026, 2, 1), 2, allowed_tags=["ok"])
    assert [x["fact_id"] for x in assemble_context(MemoryTables(f, None, ent), r).collect()] == ["open"]
