"""Memory tables derived from star-schema and text tables, so every operator runs on any input of that shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scope(x: str):
    return F.element_at(F.array(F.lit("org"), F.lit("personal"), F.lit("private")), (F.col(x) % 3 + 1).cast("int"))


def _hours(n):
    return F.make_dt_interval(F.lit(0), n.cast("int"), F.lit(0), F.lit(0))


def _days(n):
    return F.make_dt_interval(n.cast("int"), F.lit(0), F.lit(0), F.lit(0))


def _minutes(n):
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"), F.lit(0))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts from events: versions of (user, type), each closed by the next."""
    e = _read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    e = e.withColumn("t_ingested", F.col("ts") + _hours(F.col("event_id") % 48))
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    user = F.col("user_id").cast("string")
    return e.select(
        F.concat(F.lit("fact:"), F.col("event_id").cast("string")).alias("fact_id"), F.col("event_type").alias("fact_type"),
        F.concat(F.col("event_type"), F.lit(" by user "), user).alias("content"), F.concat(F.lit("entity:user:"), user).alias("entity"),
        _scope("user_id").alias("scope"), F.concat(F.lit("episode:"), user, F.lit(":"), F.date_format("ts", "yyyy-MM-dd")).alias("source_episode"),
        F.col("ts").alias("t_valid"), "t_ingested", F.lead("ts").over(w).alias("t_invalid"), F.lead("t_ingested").over(w).alias("t_invalid_ingested"),
        (F.lit(0.3) + (F.col("event_id") % 70).cast("double") / F.lit(100.0)).alias("confidence"), (F.col("event_id") % 4).alias("access_count"),
        F.when(F.col("event_id") % 4 > 0, F.col("ts") + _days(F.col("event_id") % 30)).alias("last_accessed"),
        F.when(F.col("event_id") % 5 > 0, F.array(F.concat(F.lit("tag"), (F.col("event_id") % 5).cast("string")))).otherwise(F.array().cast("array<string>")).alias("policy_tags"),
    )


FACT_SQL = """fact AS (
  SELECT 'fact:' || event_id AS fact_id, event_type AS fact_type, event_type || ' by user ' || user_id AS content, 'entity:user:' || user_id AS entity,
    CASE user_id % 3 WHEN 0 THEN 'org' WHEN 1 THEN 'personal' ELSE 'private' END AS scope,
    'episode:' || user_id || ':' || strftime(ts, '%Y-%m-%d') AS source_episode, ts AS t_valid, ts + INTERVAL 1 HOUR * (event_id % 48) AS t_ingested,
    lead(ts) OVER w AS t_invalid, lead(ts + INTERVAL 1 HOUR * (event_id % 48)) OVER w AS t_invalid_ingested,
    CAST(0.3 AS DOUBLE) + CAST(event_id % 70 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence, event_id % 4 AS access_count,
    CASE WHEN event_id % 4 > 0 THEN ts + INTERVAL 1 DAY * (event_id % 30) END AS last_accessed,
    CASE WHEN event_id % 5 > 0 THEN ['tag' || (event_id % 5)] ELSE CAST([] AS VARCHAR[]) END AS policy_tags
  FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"""


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes from documents, one a minute."""
    d = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return d.select(
        F.concat(F.lit("episode:doc:"), F.col("doc_id").cast("string")).alias("episode_id"), F.lit("document").alias("source_type"),
        F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("content"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + _minutes(F.col("doc_id"))).alias("t_ref"), _scope("doc_id").alias("scope"),
        F.when(F.col("doc_id") % 7 == 0, "archived").alias("status"), "doc_id",
    )


EPISODE_SQL = """episode AS (
  SELECT 'episode:doc:' || doc_id AS episode_id, 'document' AS source_type, CAST(doc_id AS VARCHAR) AS source_id, text AS content,
    TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * doc_id AS t_ref, CASE doc_id % 3 WHEN 0 THEN 'org' WHEN 1 THEN 'personal' ELSE 'private' END AS scope,
    CASE WHEN doc_id % 7 = 0 THEN 'archived' END AS status, doc_id FROM documents)"""


def text_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose content is text: one per document, four to an episode."""
    e = episodes(spark, sf_dir)
    return e.select(
        F.concat(F.lit("fact:doc:"), F.col("doc_id").cast("string")).alias("fact_id"), F.when(F.col("doc_id") % 3 == 0, "metric").otherwise("note").alias("fact_type"),
        "content", F.concat(F.lit("episode:group:"), F.floor(F.col("doc_id") / 4).cast("string")).alias("source_episode"), F.lit("org").alias("scope"),
        F.col("t_ref").alias("t_valid"), F.col("t_ref").alias("t_ingested"),
        F.when(F.col("doc_id") % 11 == 0, F.col("t_ref") + _days(F.lit(1))).alias("t_invalid"), F.when(F.col("doc_id") % 11 == 0, F.col("t_ref") + _days(F.lit(2))).alias("t_invalid_ingested"),
        (F.lit(0.3) + (F.col("doc_id") % 70).cast("double") / F.lit(100.0)).alias("confidence"),
        F.array(F.concat(F.lit("entity:g:"), (F.col("doc_id") % 40).cast("string"))).alias("entity_links"), F.array().cast("array<string>").alias("policy_tags"),
        F.array(F.lower(F.date_format("t_ref", "MMMM yyyy"))).alias("index_keys"), "doc_id",
    )


TEXT_FACT_SQL = EPISODE_SQL + """, tfact AS (
  SELECT 'fact:doc:' || doc_id AS fact_id, CASE WHEN doc_id % 3 = 0 THEN 'metric' ELSE 'note' END AS fact_type, content,
    'episode:group:' || (doc_id // 4) AS source_episode, 'org' AS scope, t_ref AS t_valid, t_ref AS t_ingested,
    CASE WHEN doc_id % 11 = 0 THEN t_ref + INTERVAL 1 DAY END AS t_invalid, CASE WHEN doc_id % 11 = 0 THEN t_ref + INTERVAL 2 DAY END AS t_invalid_ingested,
    CAST(0.3 AS DOUBLE) + CAST(doc_id % 70 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence, ['entity:g:' || (doc_id % 40)] AS entity_links,
    CAST([] AS VARCHAR[]) AS policy_tags, [lower(strftime(t_ref, '%B %Y'))] AS index_keys, doc_id FROM episode)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities from customers, suppliers and nations, each with a lower-case alias and a short one."""
    parts = (("customer", "c_name", "person"), ("supplier", "s_name", "company"), ("nation", "n_name", "location"))
    out = None
    for table, name, kind in parts:
        one = _read(spark, sf_dir, table).select(F.concat(F.lit(f"entity:{table}:"), F.col(name)).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(name).alias("canonical_name"),
                                                 F.lower(name).alias("canonical_name_normalized"), F.array(F.concat(F.lower(name), F.lit(" inc")), F.concat(F.lit("the "), F.lower(name))).alias("aliases"))
        out = one if out is None else out.unionByName(one)
    return out


ENTITY_SQL = "entity AS (" + " UNION ALL ".join(
    f"SELECT 'entity:{t}:' || {n} AS entity_id, '{k}' AS entity_type, {n} AS canonical_name, lower({n}) AS canonical_name_normalized, "
    f"[lower({n}) || ' inc', 'the ' || lower({n})] AS aliases FROM {t}"
    for t, n, k in (("customer", "c_name", "person"), ("supplier", "s_name", "company"), ("nation", "n_name", "location"))) + ")"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers, versions by (customer, priority): each closes the one before."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        F.concat(F.lit("edge:"), F.col("o_orderkey").cast("string")).alias("edge_id"), F.concat(F.lit("entity:c:"), F.col("o_custkey").cast("string")).alias("in_id"),
        F.lit("ordered").alias("relation"), F.concat(F.lit("entity:p:"), F.col("o_orderpriority")).alias("out_id"), F.col("o_orderdate").alias("t_valid"),
        (F.col("o_orderdate") + _days(F.col("o_orderkey") % 3)).alias("t_ingested"), F.lead("o_orderdate").over(w).alias("t_invalid"), F.lit(None).cast("timestamp_ntz").alias("t_invalid_ingested"),
    )


EDGE_SQL = """edge AS (
  SELECT 'edge:' || o_orderkey AS edge_id, 'entity:c:' || o_custkey AS in_id, 'ordered' AS relation, 'entity:p:' || o_orderpriority AS out_id, o_orderdate AS t_valid,
    o_orderdate + INTERVAL 1 DAY * (o_orderkey % 3) AS t_ingested, lead(o_orderdate) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS t_invalid,
    CAST(NULL AS TIMESTAMP) AS t_invalid_ingested FROM orders)"""


def graph(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """The graph of orders and parts: an edge for every distinct pair, or, where repeats do no harm, for every line."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").where("l_orderkey IS NOT NULL AND l_partkey IS NOT NULL")
    li = li.distinct() if once else li
    return li.select(F.concat(F.lit("entity:o:"), F.col("l_orderkey").cast("string")).alias("in_id"), F.lit("has_part").alias("relation"), F.concat(F.lit("entity:pt:"), F.col("l_partkey").cast("string")).alias("out_id"))


GRAPH_SQL = """graph AS (SELECT DISTINCT 'entity:o:' || l_orderkey AS in_id, 'has_part' AS relation, 'entity:pt:' || l_partkey AS out_id
  FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL)"""


def nation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers linked to their nations: components of a known, small diameter. part and n tell rows apart."""
    out = None
    for table, c in (("supplier", "s"), ("customer", "c")):
        key = F.col(f"{c}_{'supp' if c == 's' else 'cust'}key")
        one = _read(spark, sf_dir, table).select(F.concat(F.lit(f"entity:{c}:"), key.cast("string")).alias("in_id"), F.lit("lives_in").alias("relation"),
                                                 F.concat(F.lit("entity:n:"), F.col(f"{c}_nationkey").cast("string")).alias("out_id"), F.lit(c).alias("part"), key.cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


NATION_GRAPH_SQL = """ngraph AS (SELECT 'entity:s:' || s_suppkey AS in_id, 'entity:n:' || s_nationkey AS out_id, 's' AS part, s_suppkey AS n FROM supplier
  UNION ALL SELECT 'entity:c:' || c_custkey, 'entity:n:' || c_nationkey, 'c', c_custkey FROM customer)"""
