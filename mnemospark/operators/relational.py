"""Filters, joins, aggregates and ranked reads over memory tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, temporal, text


# -- policy -----------------------------------------------------------------------------------------------
def allowed_by_tags(tags: list[str] | None, column: str = "policy_tags") -> Column:
    """Rows without tags, and those with one of the caller's; no list: every row."""
    if tags is None:
        return F.lit(True)
    return (F.size(column) == 0) | F.arrays_overlap(column, F.array(*[F.lit(t) for t in tags]).cast("array<string>"))


def scope_allowed(scope: str, allowed: list[str] | None, cross: list[dict] | None = None) -> bool:
    """By the caller's list, or a cross-scope rule from "*"."""
    return allowed is None or scope in allowed or any(c.get("from") == "*" and c.get("to") == scope for c in cross or [])


def resolve_scope(scope: str, namespaces: list[str]) -> str:
    """The namespace of a scope: by name in any case, "org" for the first; otherwise an error."""
    for n in namespaces:
        if n.lower() == scope.lower():
            return n
    if scope.lower() == "org" and namespaces:
        return namespaces[0]
    raise ValueError(f"unknown scope: {scope}")


def find_in_namespaces(df: DataFrame, key: str, value: str, namespaces: list[str]) -> DataFrame:
    """The row of a key in the first namespace that has it."""
    rank = F.array_position(F.array(*[F.lit(n) for n in namespaces]), F.col("scope"))
    return df.where((F.col(key) == value) & (rank > 0)).orderBy(rank).limit(1)


def cross_scope(df: DataFrame, allowed: list[str] | None, cross: list[dict] | None = None) -> DataFrame:
    """Rows of the scopes that the caller may see."""
    if allowed is None:
        return df
    open_to = [c["to"] for c in cross or [] if c.get("from") == "*"]
    return df.where(F.col("scope").isin(*allowed, *open_to))


# -- lookups ----------------------------------------------------------------------------------------------
def facts_by_links(facts: DataFrame, wanted: DataFrame, scope: str, cutoff, limit: int | None = None) -> DataFrame:
    """Active facts that link to any of the wanted entity_ids; newest first, ties by fact_id."""
    active = facts.where(temporal.active_in_scope(scope, cutoff))
    hit = active.select("fact_id", F.explode("entity_links").alias("entity_id")).join(wanted.select("entity_id"), "entity_id", "left_semi").select("fact_id").distinct()
    out = active.join(hit, "fact_id", "left_semi").orderBy(F.col("t_valid").desc(), "fact_id")
    return out.limit(limit) if limit else out


def newest_per_group(df: DataFrame, group: str, time: str, key: str, n: int) -> DataFrame:
    """The n newest rows of each group. Rank windows stop early in each task (WindowGroupLimit), so only n
    rows per group and task cross the shuffle."""
    w = Window.partitionBy(group).orderBy(F.col(time).desc(), F.col(key))
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def episodes_of_entity(edges: DataFrame, facts: DataFrame, episodes: DataFrame, entities: DataFrame, limit: int = 10) -> DataFrame:
    """Per entity the newest episodes of facts it is involved in."""
    involved = edges.where("relation = 'involved_in'").join(entities, F.col("in_id") == F.col("entity_id"), "left_semi").select(F.col("in_id").alias("entity_id"), F.col("out_id").alias("fact_id"))
    pairs = involved.join(facts.select("fact_id", F.col("source_episode").alias("episode_id")), "fact_id").select("entity_id", "episode_id").distinct()
    return newest_per_group(pairs.join(episodes, "episode_id"), "entity_id", "t_ref", "episode_id", limit)


def episodes_without_facts(episodes: DataFrame, facts: DataFrame) -> DataFrame:
    return episodes.join(facts.select(F.col("source_episode").alias("episode_id")), "episode_id", "left_anti")


def fact_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("source_episode").agg(F.count("*").alias("n_facts"))


# -- entities ---------------------------------------------------------------------------------------------
def resolve_names(names: DataFrame, entities: DataFrame) -> DataFrame:
    """names (name) with entity_id: canonical match first, alias only if there is none; ties by entity_id.
    Both sides meet on normalised names, one equi-join each."""
    asked = names.select("name", text.normalize("name").alias("n"))
    canonical = entities.select("entity_id", F.col("canonical_name_normalized").alias("n"), F.lit(0).alias("prio"))
    alias = entities.select("entity_id", F.explode("aliases").alias("a")).select("entity_id", text.normalize("a").alias("n"), F.lit(1).alias("prio"))
    hit = asked.join(canonical.unionByName(alias), "n")
    return hit.groupBy("name").agg(F.min(F.struct("prio", "entity_id")).alias("m")).select("name", "m.entity_id", F.when(F.col("m.prio") == 0, "canonical").otherwise("alias").alias("matched"))


def new_entities(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates (entity_type, canonical_name, aliases) that no entity has by name or alias, with ids."""
    c = candidates.withColumn("entity_id", ids.entity_id("entity_type", "canonical_name")).dropDuplicates(["entity_id"])
    known = resolve_names(c.select(F.col("canonical_name").alias("name")).distinct(), entities)
    fresh = c.join(known, c.canonical_name == known.name, "left_anti")
    return fresh.select("entity_id", "entity_type", "canonical_name", text.normalize("canonical_name").alias("canonical_name_normalized"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def entities_by_ids(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entities whose entity_id is among the wanted ones."""
    return entities.join(wanted.select("entity_id").distinct(), "entity_id", "left_semi")


def entity_keys(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Per fact (fact_id, names) the normalised names and aliases of the entities it links to, distinct and sorted."""
    named = entities.select("entity_id", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    links = facts.select("fact_id", F.explode("entity_links").alias("entity_id"))
    names = links.join(named, "entity_id").select("fact_id", text.normalize("name").alias("name")).where("name <> ''")
    return names.groupBy("fact_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def alias_expansions(query: str, entities: DataFrame) -> DataFrame:
    """Rewrites of a query with a matched name replaced by each other name of its entity: distinct, sorted. Every
    span of words is looked up, single capitalised words among them."""
    words = query.split()
    spans = [(a, n, " ".join(words[a:a + n])) for n in range(len(words), 0, -1) for a in range(len(words) - n + 1)]
    spans = [s for s in spans if len(s[2].encode()) >= 2]
    spark = entities.sparkSession
    grams = spark.createDataFrame(spans or [(0, 0, "")], "at int, n int, gram string").withColumn("g", text.normalize("gram"))
    names = entities.select("entity_id", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("name"))
    hit = names.withColumn("g", text.normalize("name")).join(F.broadcast(grams), "g").select("entity_id", "at", "n", "g")  # grams: the query's words squared
    other = names.join(hit, "entity_id").where(text.normalize("name") != F.col("g"))
    whole = F.split(F.lit(query.strip()), r"\s+")
    parts = F.concat(F.slice(whole, 1, F.col("at")), F.array("name"), F.slice(whole, F.col("at") + F.col("n") + 1, F.lit(len(words))))
    return other.select(F.array_join(parts, " ").alias("expansion")).where(F.col("expansion") != query).distinct()


# -- as-of join -------------------------------------------------------------------------------------------
def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """left with the value of the latest right row of its key at or before its time. Both sides are one
    sorted stream per key: a union and last_value, so one shuffle and no range join."""
    cols = left.columns
    l = left.select(*cols, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    r = right.select(*[(F.col(key) if c == key else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in cols], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return l.unionByName(r).withColumn(f"{value}_asof", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_t", "_side", "_v")


def page(df: DataFrame, order: list, size: int, cursor: int = 0) -> DataFrame:
    """One page of an ordered read, with has_more on every row: one row more than the page is looked at."""
    rows = df.orderBy(*order).offset(cursor).limit(size + 1)
    rn = F.row_number().over(Window.orderBy(*order))  # over size + 1 rows
    return rows.withColumn("_rn", rn).withColumn("has_more", F.max("_rn").over(Window.partitionBy()) > size).where(F.col("_rn") <= size).drop("_rn")
