"""Diff, decay, archival, heat, provenance and drafts: set-based, one pass each, writes as plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import temporal

RETRIEVE_BOOST, EXPLAIN_BOOST = 1, 3
DIFF_FIELDS = ("content", "confidence", "t_invalid")


# -- diff -------------------------------------------------------------------------------------------------
def temporal_diff(facts: DataFrame, at_from, at_to, axis: str = "valid", scope: str | None = None, entity: str | None = None, fact_type: str | None = None,
                  later_versions: DataFrame | None = None) -> DataFrame:
    """Facts added, removed or changed between two times. Membership of both snapshots is decided in one scan;
    later_versions (fact_id and the fields as of at_to) makes changed rows possible."""
    f = facts
    if scope is not None:
        f = f.where(F.col("scope") == scope)
    if entity is not None:
        f = f.where(F.array_contains("entity_links", entity)) if "entity_links" in facts.columns else f.where(F.col("entity") == entity)
    if fact_type is not None:
        f = f.where(F.col("fact_type") == fact_type)
    seen = f.withColumns({"_a": temporal.in_snapshot(axis, at_from), "_b": temporal.in_snapshot(axis, at_to)}).where("_a OR _b")
    changed = F.lit(False)
    if later_versions is not None:
        fields = [c for c in DIFF_FIELDS if c in later_versions.columns]
        seen = seen.join(later_versions.select("fact_id", *[F.col(c).alias(f"_{c}") for c in fields]), "fact_id", "left")
        for c in fields:
            changed = changed | (F.col(f"_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")))
    kind = F.when(~F.col("_a"), "added").when(~F.col("_b"), "removed").when(changed, "changed")
    return seen.withColumn("change", kind).where("change IS NOT NULL").select("fact_id", "fact_type", "content", "change")


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("n"))


# -- lifecycle --------------------------------------------------------------------------------------------
def decay_pass(facts: DataFrame, now, threshold: float, half_life: float) -> DataFrame:
    """New versions of open facts whose decayed confidence is below threshold and that are not hot."""
    decayed = temporal.lifecycle_confidence(now, half_life)
    return (facts.where(temporal.open_interval()).withColumn("decayed_confidence", decayed).where((F.col("decayed_confidence") < threshold) & ~temporal.is_hot(now, half_life))
            .withColumns({"t_invalid": temporal.ts(now), "t_invalid_ingested": temporal.ts(now)}))


def archival_candidates(episodes: DataFrame, facts: DataFrame, now, age_days: float) -> DataFrame:
    """Old episodes that are not archived, have no fact still valid and no fact read lately."""
    old = episodes.where(~F.col("status").eqNullSafe(F.lit("archived")) & (F.col("t_ref") < temporal.ts(now) - F.make_dt_interval(F.lit(int(age_days)))))
    keeping = facts.where(temporal.not_yet_invalid(now) | temporal.is_hot(now, age_days)).select(F.col("source_episode").alias("episode_id"))
    return old.join(keeping, "episode_id", "left_anti")


def archive(episodes: DataFrame, now) -> DataFrame:
    return episodes.withColumns({"status": F.lit("archived"), "archived_at": temporal.ts(now)})


def restore(episodes: DataFrame) -> DataFrame:
    return episodes.withColumns({"status": F.lit("active"), "archived_at": F.lit(None).cast("timestamp_ntz")})


def low_confidence(facts: DataFrame, now, half_life: float, below: float = 0.5, least: float | None = None, limit: int | None = None) -> DataFrame:
    d = facts.where(temporal.open_interval()).withColumn("decayed_confidence", temporal.lifecycle_confidence(now, half_life)).where(F.col("decayed_confidence") < below)
    if least is not None:
        d = d.where(F.col("decayed_confidence") >= least)
    d = d.withColumn("state", temporal.decayed_state(F.col("decayed_confidence")))
    return d.orderBy("decayed_confidence", "fact_id").limit(limit) if limit else d


def heat(log: DataFrame) -> DataFrame:
    """Access log (fact_id, boost, ts) summed per fact."""
    return log.groupBy("fact_id").agg(F.sum("boost").alias("access_count"), F.max("ts").alias("last_accessed"))


def apply_heat(facts: DataFrame, log: DataFrame) -> DataFrame:
    h = heat(log).select("fact_id", F.col("access_count").alias("_n"), F.col("last_accessed").alias("_t"))
    return facts.join(h, "fact_id", "left").withColumns({"access_count": F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0)),
                                                         "last_accessed": F.coalesce("_t", "last_accessed")}).drop("_n", "_t")


def invalidate(facts: DataFrame, requests: DataFrame, now) -> DataFrame:
    """New versions for requests (fact_id, reason, t_invalid); facts that are already closed stay. The reason is
    kept in provenance."""
    r = requests.select("fact_id", "reason", F.col("t_invalid").alias("_at"))
    out = facts.where(temporal.open_interval()).join(r, "fact_id")
    if "provenance" in facts.columns:
        out = out.withColumn("provenance", F.map_concat(F.coalesce("provenance", F.create_map().cast("map<string,string>")), F.create_map(F.lit("invalidation_reason"), "reason")))
    return out.withColumns({"t_invalid": F.col("_at"), "t_invalid_ingested": temporal.ts(now)}).drop("_at", "reason")


def active_facts(facts: DataFrame, limit: int | None = None) -> DataFrame:
    """Open facts, oldest first."""
    out = facts.where(temporal.open_interval()).orderBy("t_valid", "fact_id")
    return out.limit(limit) if limit else out


def archived(episodes: DataFrame, limit: int | None = 100) -> DataFrame:
    """Archived episodes, the last ones first."""
    out = episodes.where("status = 'archived'").orderBy(F.col("archived_at").desc(), "episode_id")
    return out.limit(limit) if limit else out


def dashboard(facts: DataFrame, episodes: DataFrame, communities: DataFrame, edges: DataFrame, now, half_life: float = 100.0, below: float = 0.5, least: float | None = None,
              age_days: float = 90, facts_limit: int | None = 500, episodes_limit: int | None = 200, archived_limit: int | None = 100) -> dict[str, DataFrame]:
    """The four lists of the lifecycle console: open facts that are weak and not hot, episodes to archive (oldest
    first), archived ones (last first) and stale communities."""
    from .graphs import stale_communities

    weak = low_confidence(facts.where(~temporal.is_hot(now, half_life)), now, half_life, below, least, facts_limit)
    old = archival_candidates(episodes, facts, now, age_days).orderBy("t_ref", "episode_id")
    return {"low_confidence": weak, "archival_candidates": old.limit(episodes_limit) if episodes_limit else old,
            "archived": archived(episodes, archived_limit), "stale_communities": stale_communities(communities, edges.where(temporal.active_at(now)))}


# -- provenance -------------------------------------------------------------------------------------------
def provenance(facts: DataFrame, episodes: DataFrame, edges: DataFrame, newest: int = 10) -> DataFrame:
    """Sources of each fact: its own episode (direct) and, for every linked entity, the newest episodes of other
    facts the entity is involved in. Rows (fact_id, episode_id, kind, entity_id, t_ref), direct first."""
    from .relational import newest_per_group

    own = facts.select("fact_id", F.col("source_episode").alias("episode_id"), "entity_links")
    when = episodes.select("episode_id", "t_ref")
    direct = own.select("fact_id", "episode_id", F.lit("direct").alias("kind"), F.lit(None).cast("string").alias("entity_id"))
    links = own.select("fact_id", F.col("episode_id").alias("own_episode"), F.explode("entity_links").alias("entity_id"))
    involved = edges.where("relation = 'involved_in'").select(F.col("in_id").alias("entity_id"), F.col("out_id").alias("other"))
    of_entity = involved.join(own.select(F.col("fact_id").alias("other"), "episode_id"), "other").select("entity_id", "episode_id").distinct().join(when, "episode_id")
    of_entity = newest_per_group(of_entity, "entity_id", "t_ref", "episode_id", newest).select("entity_id", "episode_id")
    linked = links.join(of_entity, "entity_id").where("episode_id <> own_episode").select("fact_id", "episode_id", F.lit("linked").alias("kind"), "entity_id").distinct()
    return direct.unionByName(linked).join(when, "episode_id", "left").select("fact_id", "episode_id", "kind", "entity_id", "t_ref")


def sources_array(sources: DataFrame) -> DataFrame:
    """Per fact: direct first, then newest first."""
    item = F.struct((F.col("kind") != "direct").alias("o"), (-F.unix_micros(F.col("t_ref").cast("timestamp"))).alias("t"), "episode_id", "entity_id", "kind", "t_ref")
    return sources.groupBy("fact_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["episode_id"].alias("episode_id"), x["kind"].alias("kind"), x["entity_id"].alias("entity_id"), x["t_ref"].alias("t_ref"))).alias("all_sources"))


# -- drafts -----------------------------------------------------------------------------------------------
def draft_summary(items: DataFrame) -> DataFrame:
    """Counts of draft items by type and status; other values are ignored."""
    count = lambda c, v: F.count_if(F.col(c) == v)
    return items.groupBy("draft_id").agg(count("item_type", "entity").alias("entities"), count("item_type", "fact").alias("facts"), count("item_type", "edge").alias("edges"),
                                         count("status", "pending").alias("pending"), count("status", "approved").alias("approved"), count("status", "rejected").alias("rejected"), count("status", "edited").alias("edited"))


def live_drafts(drafts: DataFrame, now) -> DataFrame:
    return drafts.where((F.col("status") == "open") & (F.col("expires_at") >= temporal.ts(now)))


def review(items: DataFrame, item_ids: list[str], status: str) -> DataFrame:
    """New versions of the chosen items: approved or rejected."""
    return items.where(F.col("item_id").isin(*item_ids)).withColumn("status", F.lit(status))


def edit(items: DataFrame, item_id: str, payload: str) -> DataFrame:
    return items.where(F.col("item_id") == item_id).withColumns({"original_payload": F.coalesce("original_payload", "payload"), "payload": F.lit(payload), "status": F.lit("edited")})


def draft_commit_plan(items: DataFrame) -> DataFrame:
    """What a commit writes, in order: entities, facts, edges of approved and edited items. Edge ends named by
    an item id or a name are resolved to that item; ids stay."""
    live = items.where(F.col("status").isin("approved", "edited"))
    get = lambda *names: F.coalesce(*[F.get_json_object("payload", f"$.{n}") for n in names])
    p = live.select("draft_id", "item_id", "item_type", get("canonical_name", "name", "content").alias("name"), F.coalesce(get("entity_type"), F.lit("concept")).alias("entity_type"),
                    get("content").alias("content"), get("from_id", "from", "in").alias("src"), get("to_id", "to", "out").alias("dst"), F.coalesce(get("relation"), F.lit("related_to")).alias("relation"))
    names = p.where("item_type = 'entity'").groupBy("draft_id", F.lower("name").alias("n")).agg(F.min("item_id").alias("by_name"))
    own = p.where("item_type <> 'edge'").select("draft_id", F.col("item_id").alias("ref")).distinct()

    def resolved(df: DataFrame, c: str) -> DataFrame:
        a = names.select(F.col("draft_id").alias("_d"), F.col("n").alias("_n"), F.col("by_name").alias("_by"))
        b = own.select(F.col("draft_id").alias("_e"), F.col("ref").alias("_ref"))
        out = df.join(a, (F.col("draft_id") == F.col("_d")) & (F.lower(c) == F.col("_n")), "left").join(b, (F.col("draft_id") == F.col("_e")) & (F.col(c) == F.col("_ref")), "left")
        is_id = F.col(c).rlike("^(entity|fact|episode):")
        return out.withColumn(c, F.when(is_id, F.col(c)).otherwise(F.coalesce("_ref", "_by", c))).drop("_d", "_n", "_by", "_e", "_ref")

    edges = resolved(resolved(p.where("item_type = 'edge'"), "src"), "dst")
    stage = F.when(F.col("item_type") == "entity", 1).when(F.col("item_type") == "fact", 2).otherwise(3)
    return p.where("item_type <> 'edge'").unionByName(edges).select("draft_id", stage.alias("stage"), "item_id", "name", "src", "relation", "dst")


def draft_rows(items: DataFrame, entities: DataFrame, now, ingested=None) -> dict[str, DataFrame]:
    """What a commit stores of approved and edited items (with columns scope and source_episode): entities, facts
    and edges as rows of their tables.

    An entity that is known by name or alias keeps its id. A fact links to the entities that its payload lists
    (entity_links: names, ids or item ids) and each of them gets an edge involved_in. Ends of explicit edges are
    resolved in the same way; an edge with an end that names nothing of the draft keeps the text as it is. A fact
    without text, or without an episode to come from, is left out: see incomplete_items(). now: valid time of what names
    none, which ids hold; ingested: transaction time, now if it is not given."""
    ingested = now if ingested is None else ingested
    from ..functions import ids, text
    from .relational import resolve_names

    live = items.where(F.col("status").isin("approved", "edited"))
    get = lambda *names: F.coalesce(*[F.when(F.trim(F.get_json_object("payload", f"$.{n}")) != "", F.get_json_object("payload", f"$.{n}")) for n in names])
    own = live.where("item_type = 'entity'").select("draft_id", "item_id", get("canonical_name", "name", "content").alias("canonical_name"), F.coalesce(get("entity_type"), F.lit("concept")).alias("entity_type"),
                                                    F.coalesce(F.from_json(F.get_json_object("payload", "$.aliases"), "array<string>"), F.array().cast("array<string>")).alias("aliases")).where("canonical_name IS NOT NULL")
    known = resolve_names(own.select(F.col("canonical_name").alias("name")).distinct(), entities).select("name", F.col("entity_id").alias("_known"))
    own = own.join(known, F.col("canonical_name") == F.col("name"), "left").withColumn("entity_id", F.coalesce("_known", ids.entity_id("entity_type", "canonical_name")))
    fresh = own.where("_known IS NULL").dropDuplicates(["entity_id"]).select("entity_id", "entity_type", "canonical_name", text.normalize("canonical_name").alias("canonical_name_normalized"), "aliases")
    named = (own.select("draft_id", F.col("item_id").alias("ref"), "entity_id").unionByName(own.select("draft_id", text.normalize("canonical_name").alias("ref"), "entity_id"))
             .groupBy("draft_id", "ref").agg(F.min("entity_id").alias("id")))
    content = F.coalesce(get("content", "source_text"), F.when(F.trim("source_snippet") != "", F.col("source_snippet")))
    facts = (live.where("item_type = 'fact'").withColumn("content", content).withColumn("source_episode", F.coalesce(get("draft_episode_id", "source_episode"), "source_episode")).where("content IS NOT NULL AND source_episode IS NOT NULL")
             .select("draft_id", "item_id", "scope", "content", F.coalesce(get("quote"), F.col("content")).alias("quote"), F.coalesce(get("fact_type"), F.lit("note")).alias("fact_type"), "source_episode",
                     F.coalesce(F.try_to_timestamp(get("t_valid")).cast("timestamp_ntz"), temporal.ts(now)).alias("t_valid"), temporal.ts(ingested).alias("t_ingested"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
                     F.coalesce(F.from_json(F.coalesce(F.get_json_object("payload", "$.entity_links"), F.get_json_object("payload", "$.entities")), "array<string>"), F.array().cast("array<string>")).alias("refs"))
             .withColumn("fact_id", ids.fact_id("fact_type", "content", "source_episode", F.col("t_valid"))))
    facts_named = facts.select("draft_id", F.col("item_id").alias("ref"), F.col("fact_id").alias("id"))
    every = named.unionByName(facts_named)

    def resolved(df: DataFrame, c: str) -> DataFrame:
        exact, loose = every.toDF("_d", "_ref", "_exact"), every.toDF("_e", "_norm", "_loose")
        out = df.join(exact, (F.col("draft_id") == F.col("_d")) & (F.col(c) == F.col("_ref")), "left").join(loose, (F.col("draft_id") == F.col("_e")) & (text.normalize(c) == F.col("_norm")), "left")
        return out.withColumn(c, F.when(F.col(c).rlike("^(entity|fact|episode):"), F.col(c)).otherwise(F.coalesce("_exact", "_loose", c))).drop("_d", "_ref", "_exact", "_e", "_norm", "_loose")

    links = resolved(facts.select("draft_id", "fact_id", F.explode("refs").alias("entity_id")), "entity_id").where(F.col("entity_id").startswith("entity:")).select("fact_id", "entity_id").distinct()
    gathered = links.groupBy("fact_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_links"))
    stored = (facts.dropDuplicates(["fact_id"]).join(gathered, "fact_id", "left").withColumn("entity_links", F.coalesce("entity_links", F.array().cast("array<string>")))
              .withColumn("provenance", F.create_map(F.lit("draft_id"), "draft_id", F.lit("draft_item_id"), "item_id", F.lit("source_episode"), "source_episode")))
    at = [temporal.ts(now).alias("t_valid"), temporal.ts(ingested).alias("t_ingested")]
    involved = stored.select("fact_id", "draft_id", "item_id", "confidence", F.explode("entity_links").alias("in_id")).select(
        "in_id", F.lit("involved_in").alias("relation"), F.col("fact_id").alias("out_id"), F.lit(0.8).alias("strength"), F.greatest("confidence", F.lit(0.0)).alias("confidence"), "draft_id", "item_id", *at)
    explicit = live.where("item_type = 'edge'").select("draft_id", "item_id", "confidence", get("from_id", "from", "in").alias("in_id"), get("to_id", "to", "out").alias("out_id"), F.coalesce(get("relation"), F.lit("related_to")).alias("relation"))
    explicit = resolved(resolved(explicit.where("in_id IS NOT NULL AND out_id IS NOT NULL"), "in_id"), "out_id").select(
        "in_id", "relation", "out_id", F.lit(1.0).alias("strength"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "draft_id", "item_id", *at)
    edges = (involved.unionByName(explicit).withColumn("edge_id", ids.edge_id("in_id", "relation", "out_id", F.col("t_valid"))).dropDuplicates(["edge_id"])
             .withColumn("provenance", F.create_map(F.lit("draft_id"), "draft_id", F.lit("draft_item_id"), "item_id")).drop("draft_id", "item_id"))
    return {"entity": fresh, "fact": stored.drop("refs", "draft_id", "item_id"), "edge": edges}


def incomplete_items(items: DataFrame) -> DataFrame:
    """Approved and edited facts without text: a commit refuses a draft that has one."""
    get = lambda n: F.coalesce(F.trim(F.get_json_object("payload", f"$.{n}")), F.lit(""))
    text_of = F.concat(get("content"), get("source_text"), F.coalesce(F.trim("source_snippet"), F.lit("")))
    return items.where(F.col("status").isin("approved", "edited") & (F.col("item_type") == "fact") & (text_of == "")).select("draft_id", "item_id")


# -- embeddings -------------------------------------------------------------------------------------------
def pending_reembed(facts: DataFrame) -> DataFrame:
    return facts.where("embedding_next IS NULL")


def cutover(facts: DataFrame) -> DataFrame:
    """The staged vector becomes the vector where there is one."""
    return facts.withColumns({"embedding": F.coalesce("embedding_next", "embedding"), "embedding_next": F.lit(None).cast("array<double>")})
