"""assemble_context: lexical, community, semantic and graph legs fused into one ranked context."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import temporal, text
from ..operators import fusion, graphs, lexical, relational, semantic

CANDIDATES, FALLBACK_CONFIDENCE = 10, 0.4


@dataclasses.dataclass
class ContextRequest:
    query: str
    scope: str
    as_of: dt.datetime | str
    budget: int = 5
    view: str = "relevance"  # or "timeline"
    window_start: dt.datetime | str | None = None
    window_end: dt.datetime | str | None = None
    allowed_scopes: list[str] | None = None
    allowed_tags: list[str] | None = None
    cross_scope: list[dict] | None = None
    embedding: list[float] | None = None
    threshold: float = semantic.THRESHOLD


@dataclasses.dataclass
class MemoryTables:
    facts: DataFrame
    episodes: DataFrame | None = None
    entities: DataFrame | None = None
    edges: DataFrame | None = None
    communities: DataFrame | None = None
    content_index: object = None  # FullTextIndex of the facts' content, and of their index keys
    keys_index: object = None


_ROW = "place int, fact_id string, content string, source_episode string, t_valid timestamp_ntz, score double, confidence double, rationale string"


def _recency():
    return [F.col("t_valid").desc(), F.col("fact_id").asc()]


def lexical_leg(facts: DataFrame, active, query: str, budget: int, tables: MemoryTables | None = None) -> DataFrame:
    """The best facts that hold every term; if none does, those that hold single terms. Without a query, the newest
    facts; a query without letters or digits matches nothing. With indexes in tables, texts are not read for it."""
    order = [F.col("ft_score").desc(), *_recency()]
    if not query.strip():
        return facts.where(active).withColumn("ft_score", F.lit(0.0)).orderBy(*_recency()).limit(budget)
    most = max(CANDIDATES * budget, 50)
    if tables is not None and tables.content_index is not None:
        return lexical.search_facts_indexed(facts, active, query, most, tables.content_index, tables.keys_index).orderBy(*order).limit(budget)
    return lexical.search_facts(facts, active, query, most).orderBy(*order).limit(budget)


def rewrites(query: str, as_of: dt.datetime, entities: DataFrame | None) -> list[str]:
    """The query with its spans of time named, and with names replaced by the other names of their entities."""
    found = set(text.temporal_expansions(query, as_of))
    if entities is not None:
        found |= {r["expansion"] for r in relational.alias_expansions(query, entities).collect()}  # names of the entities that the query names
    return sorted(found - {query})


def community_leg(facts: DataFrame, communities: DataFrame, query: str, used: DataFrame, budget: int) -> DataFrame:
    """Facts that link to members of communities whose summary matches: each by its best-ranked community, then
    newest first."""
    hit = lexical.bm25(communities, F.col("summary"), lexical.query_terms(query), False).orderBy(F.col("ft_score").desc(), "community_id").limit(25)
    rank = F.row_number().over(Window.orderBy(F.col("ft_score").desc(), "community_id"))  # over 25 rows
    members = hit.withColumn("_rank", rank).select("community_id", "summary", "_rank", F.explode("member_entities").alias("entity_id"))
    best = (facts.select("fact_id", F.explode("entity_links").alias("entity_id")).join(members, "entity_id")
            .groupBy("fact_id").agg(F.min(F.struct("_rank", "community_id", "summary")).alias("_best")))
    order = [F.col("_best._rank").asc(), *_recency()]
    top = facts.join(best, "fact_id").join(used, "fact_id", "left_anti").orderBy(*order).limit(budget)
    why = F.format_string("matched community summary for query=\"%s\" via %s: %s", F.lit(query), "_best.community_id", "_best.summary")
    return fusion.leg(top.withColumn("ft_score", F.lit(0.0)), "community", order, why).drop("_best")


def semantic_leg(facts: DataFrame, used: DataFrame, tables: "MemoryTables", r: ContextRequest, query: str, budget: int) -> DataFrame | None:
    """Facts near the query's vector, then facts linked to entities that the query names or that lie next to them:
    one list with one rank, each fact once."""
    free = facts.join(used, "fact_id", "left_anti")
    parts = []
    if r.embedding is not None and "embedding" in facts.columns:
        near = semantic.top_k(free, r.embedding, budget, "fact_id", r.threshold, "t_valid")
        parts.append(near.withColumns({"_part": F.lit(0), "_why": F.format_string("semantic similarity %.3f", "sem_score")}))
    if tables.entities is not None:
        spark = facts.sparkSession
        names = spark.createDataFrame([(g,) for g in text.query_ngrams(query)] or [("",)], "name string")
        seeds = relational.resolve_names(names, tables.entities).select("entity_id").distinct()
        if tables.edges is not None:
            seeds = graphs.expand_entities(tables.edges, seeds, text.is_relationship_query(query), r.as_of)
        linked = relational.facts_by_links(free, seeds, r.scope, r.as_of, 3 * budget)
        parts.append(linked.withColumns({"sem_score": F.lit(None).cast("double"), "_part": F.lit(1), "_why": F.lit("linked to an entity of the query")}))
    if not parts:
        return None
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    once = F.row_number().over(Window.partitionBy("fact_id").orderBy("_part"))
    both = both.withColumn("_rn", once).where("_rn = 1").drop("_rn").withColumn("ft_score", F.lit(0.0))
    order = [F.col("_part").asc(), F.col("sem_score").desc_nulls_last(), *_recency()]
    return fusion.leg(both, "semantic", order, F.col("_why")).drop("sem_score", "_part", "_why")


def assemble_context(tables: MemoryTables, r: ContextRequest) -> DataFrame:
    """Rows of the context in order: place, fact_id, content, source_episode, t_valid, score, confidence,
    rationale. A scope that the caller may not see gives no rows, whatever the leg. All legs and the fallback see
    only rows of the scope that the caller's tags allow, and that comes before every limit."""
    budget = max(r.budget, 1)
    facts = tables.facts
    if not relational.scope_allowed(r.scope, r.allowed_scopes, r.cross_scope):
        return facts.sparkSession.createDataFrame([], _ROW)
    for name, kind in (("index_keys", "array<string>"), ("entity_links", "array<string>"), ("policy_tags", "array<string>")):
        if name not in facts.columns:
            facts = facts.withColumn(name, F.array().cast(kind))
    active = temporal.active_in_scope(r.scope, r.as_of) & relational.allowed_by_tags(r.allowed_tags)
    as_of = r.as_of if isinstance(r.as_of, dt.datetime) else dt.datetime.fromisoformat(r.as_of)
    query = text.search_query_text(r.query)
    core = ["fact_id", "fact_type", "content", "source_episode", "t_valid", "confidence", "ft_score"]
    ranks = ["rank", "weight", "source_priority", "rationale"]
    order = [F.col("ft_score").desc(), *_recency()]
    if query or not r.query.strip():
        direct = lexical_leg(facts, active, query, budget, tables).select(*core)
    else:
        direct = facts.withColumn("ft_score", F.lit(0.0)).select(*core).limit(0)  # nothing of the query is left
    legs = fusion.leg(direct, "lexical", order)
    if query:
        used = direct.select("fact_id")
        first = used
        for rewrite in rewrites(query, as_of, tables.entities):
            more = lexical_leg(facts, active, rewrite, budget, tables).select(*core).join(first, "fact_id", "left_anti")
            legs = legs.unionByName(fusion.leg(more, "lexical", order, F.lit(f"matched rewrite {rewrite}")))
            used = used.unionByName(more.select("fact_id"))
        seen = facts.where(active)
        if tables.communities is not None:
            own = community_leg(seen, tables.communities, query, used, budget).select(*core, *ranks)
            legs, used = legs.unionByName(own), used.unionByName(own.select("fact_id"))
        further = semantic_leg(seen, used, tables, r, query, budget)
        if further is not None:
            legs = legs.unionByName(further.select(*core, *ranks))
    ranked = fusion.time_window(fusion.reciprocal_ranks(legs, r.as_of), r.window_start, r.window_end)
    final = fusion.timeline_order() if r.view == "timeline" else fusion.relevance_order()
    kept = fusion.diversify(ranked, final).orderBy(*final).limit(budget)
    out = kept.withColumn("place", F.row_number().over(Window.orderBy(*final))).select(
        "place", "fact_id", "content", "source_episode", "t_valid", F.round(fusion.composite_score(), 6).alias("score"), F.col("decayed_confidence").alias("confidence"), "rationale")
    if tables.episodes is None:
        return out
    return out.unionByName(episode_fallback(tables, r, out, budget, query))


def episode_fallback(tables: MemoryTables, r: ContextRequest, taken: DataFrame, budget: int, query: str) -> DataFrame:
    """Episodes matched by content that have no fact, for the places that facts left open. Scope, time, tags and
    window hold for them as for facts; their fact_id is the episode's id."""
    if not query:
        return taken.limit(0)
    terms = lexical.query_terms(query)
    e = tables.episodes.where((F.col("scope") == r.scope) & (F.col("t_ref") <= temporal.ts(r.as_of)))
    if "policy_tags" in e.columns:
        e = e.withColumn("policy_tags", F.coalesce("policy_tags", F.array().cast("array<string>"))).where(relational.allowed_by_tags(r.allowed_tags))
    hits = fusion.time_window(lexical.bm25(e, F.col("content"), terms).withColumn("t_valid", F.col("t_ref")), r.window_start, r.window_end)
    hits = relational.episodes_without_facts(hits, tables.facts).orderBy(F.col("ft_score").desc(), F.col("t_ref").desc(), "episode_id").limit(budget)
    n = taken.agg(F.count("*").alias("_n"))  # one row, at most budget facts
    place = F.row_number().over(Window.orderBy(F.col("ft_score").desc(), F.col("t_ref").desc(), "episode_id"))
    rows = hits.withColumn("place", place).join(F.broadcast(n)).withColumn("place", F.col("place") + F.col("_n").cast("int")).where(F.col("place") <= budget)
    why = F.lit(f"matched lexical query=\"{query}\" via episode content fallback in scope={r.scope}")
    return rows.select("place", F.col("episode_id").alias("fact_id"), "content", F.col("episode_id").alias("source_episode"), F.col("t_ref").alias("t_valid"),
                       F.round("ft_score", 6).alias("score"), F.lit(FALLBACK_CONFIDENCE).alias("confidence"), why.alias("rationale"))
