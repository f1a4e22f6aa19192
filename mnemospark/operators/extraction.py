"""Episodes to entities, typed facts and edges, in expressions; plug-in extractors bring a column of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text

FACT_CONFIDENCE = 0.7


def entities_of(episodes: DataFrame, candidates: Column | None = None, locations=text.LOCATIONS) -> DataFrame:
    """(episode_id, canonical_name, entity_type, entity_id) of names in the content. A plug-in's candidates
    (array of names) come first; the names found here are added if it gave two or fewer, else acronyms only."""
    own = text.name_candidates("content")
    if candidates is not None:
        more = F.when(F.size(candidates) <= 2, own).otherwise(F.filter(own, text.is_acronym))
        own = F.array_distinct(F.concat(candidates, more))
    names = episodes.select("episode_id", F.explode(own).alias("canonical_name"))
    typed = names.withColumn("entity_type", text.classify_entity(F.col("canonical_name"), locations))
    return typed.withColumn("entity_id", ids.entity_id("entity_type", "canonical_name"))


def facts_of(episodes: DataFrame, plain: bool = False) -> DataFrame:
    """One fact per type that the content states; each holds the whole content. plain: types as SQL finds them."""
    f = episodes.select("*", F.explode(text.fact_types("content", plain)).alias("fact_type"))
    f = f.withColumns({"source_episode": F.col("episode_id"), "t_valid": F.col("t_ref"), "confidence": F.lit(FACT_CONFIDENCE)})
    return f.withColumn("fact_id", ids.fact_id("fact_type", "content", "source_episode", "t_valid")).withColumn("index_keys", text.index_keys("content", "t_valid"))


def edges_of(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """mentioned_in from each entity to its episode, involved_in to each of the episode's facts."""
    when = facts.select("episode_id", "t_valid").distinct()
    mentioned = entities.join(when, "episode_id").select(F.col("entity_id").alias("in_id"), F.lit("mentioned_in").alias("relation"), F.col("episode_id").alias("out_id"), "t_valid", F.lit(1.0).alias("strength"), F.lit(0.9).alias("confidence"))
    involved = entities.select("episode_id", "entity_id").join(facts.select("episode_id", "fact_id", "t_valid"), "episode_id").select(
        F.col("entity_id").alias("in_id"), F.lit("involved_in").alias("relation"), F.col("fact_id").alias("out_id"), "t_valid", F.lit(0.8).alias("strength"), F.lit(0.85).alias("confidence"))
    return mentioned.unionByName(involved).distinct().withColumn("edge_id", ids.edge_id("in_id", "relation", "out_id", "t_valid"))
