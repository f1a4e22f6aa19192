"""Explicit schemas of the memory tables; nothing is inferred at load."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType, MapType, StringType, StructField, StructType,
                               TimestampNTZType)


def _table(**columns) -> StructType:
    return StructType([StructField(k, v, True) for k, v in columns.items()])


S, D, N, T, B = StringType(), DoubleType(), LongType(), TimestampNTZType(), BooleanType()
A, V, M = ArrayType(StringType()), ArrayType(DoubleType()), MapType(StringType(), StringType())

EPISODE = _table(episode_id=S, source_type=S, source_id=S, content=S, t_ref=T, t_ingested=T, status=S, archived_at=T, scope=S,
                 visibility_scope=S, policy_tags=A)
ENTITY = _table(entity_id=S, entity_type=S, canonical_name=S, canonical_name_normalized=S, aliases=A)
FACT = _table(fact_id=S, fact_type=S, content=S, quote=S, source_episode=S, t_valid=T, t_ingested=T, t_invalid=T,
              t_invalid_ingested=T, confidence=D, entity_links=A, embedding=V, embedding_next=V, scope=S, policy_tags=A, provenance=M,
              index_keys=A, access_count=N, last_accessed=T)
EDGE = _table(edge_id=S, in_id=S, relation=S, out_id=S, strength=D, confidence=D, provenance=M, t_valid=T, t_ingested=T,
              t_invalid=T, t_invalid_ingested=T)
COMMUNITY = _table(community_id=S, member_entities=A, summary=S, updated_at=T)
DRAFT = _table(draft_id=S, scope=S, status=S, created_at=T, expires_at=T, access_ctx=S)
DRAFT_ITEM = _table(draft_id=S, item_id=S, item_type=S, status=S, payload=S, original_payload=S, confidence=D, rationale=S,
                    source_snippet=S)
ACCESS_LOG = _table(fact_id=S, boost=N, ts=T)
EMBEDDING_SCHEMA = _table(provider=S, model=S, dimension=N, status=S, target_provider=S, target_model=S, target_dimension=N)
RETRIEVAL_CASE = _table(id=S, description=S,
                        episodes=ArrayType(_table(source_type=S, source_id=S, content=S, t_ref=S, scope=S)),
                        query=_table(query=S, scope=S, budget=N, as_of=S),
                        expected=_table(must_contain=A, must_not_contain=A, expect_empty=B, min_recall_at_k=D, tier=S))
EXTRACTION_CASE = _table(id=S, description=S, content=S, scope=S, t_ref=S,
                         expected=_table(entities=ArrayType(_table(entity_type=S, canonical_name=S)), fact_types=A))
LATENCY_CASE = _table(id=S, description=S, query=S, scope=S, episode_count=N, warmup_iterations=N, measured_iterations=N)

#: Tables by name; a scan of any other name is refused.
TABLES = {"episode": EPISODE, "entity": ENTITY, "fact": FACT, "edge": EDGE, "community": COMMUNITY, "draft_ingestion": DRAFT,
          "draft_item": DRAFT_ITEM, "access_log": ACCESS_LOG, "embedding_schema": EMBEDDING_SCHEMA}
#: The key of each table.
KEYS = {"episode": "episode_id", "entity": "entity_id", "fact": "fact_id", "edge": "edge_id", "community": "community_id",
        "draft_ingestion": "draft_id", "draft_item": "item_id", "access_log": "fact_id", "embedding_schema": "provider"}
