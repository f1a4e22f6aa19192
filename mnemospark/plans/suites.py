"""Evaluation suites from JSON cases: retrieval, extraction, latency."""

from __future__ import annotations

import dataclasses
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import evals, extraction
from ..operators.postings import FullTextIndex
from ..runtime import cut, shared_folder
from ..schemas import EXTRACTION_CASE, RETRIEVAL_CASE
from ..sources.store import check_retrieval_cases, read_json_cases
from .batch import assemble_contexts
from .retrieval import ContextRequest, MemoryTables, assemble_context

NEVER = "9999-12-31 00:00:00"


def _time(c: str):
    return F.coalesce(F.to_timestamp_ntz(F.regexp_replace(c, r"T(.*?)(?:Z|[+-]\d\d:?\d\d)?$", " $1")), F.lit(NEVER).cast("timestamp_ntz"))


def case_tables(cases: DataFrame) -> tuple[MemoryTables, DataFrame]:
    """The memory of all cases at once, and their requests. A case sees its own episodes alone: its scopes carry its id."""
    spark = cases.sparkSession
    own = lambda scope: F.concat("id", F.lit("|"), scope)
    e = cases.select("id", F.explode("episodes").alias("e")).select("id", "e.*")
    e = e.select("source_type", F.concat("id", F.lit("|"), "source_id").alias("source_id"), "content", _time("t_ref").alias("t_ref"), own(F.col("scope")).alias("scope"))
    e = cut(e.withColumn("episode_id", ids.episode_id("source_type", "source_id", "t_ref", "scope")).dropDuplicates(["episode_id"]))
    found = cut(extraction.entities_of(e))
    entities = found.dropDuplicates(["entity_id"]).select("entity_id", "entity_type", "canonical_name", text.normalize("canonical_name").alias("canonical_name_normalized"), F.array().cast("array<string>").alias("aliases"))
    links = found.groupBy("episode_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_links"))  # names of one text
    none = F.lit(None).cast("timestamp_ntz")
    facts = extraction.facts_of(e).join(links, "episode_id", "left").withColumns({"entity_links": F.coalesce("entity_links", F.array().cast("array<string>")), "policy_tags": F.array().cast("array<string>"), "t_ingested": F.col("t_valid"), "t_invalid": none, "t_invalid_ingested": none})
    facts = cut(facts)
    path = f"{shared_folder(spark)}/suite-{uuid.uuid4().hex}"
    content, keys = FullTextIndex(spark, f"{path}/content"), FullTextIndex(spark, f"{path}/keys")
    content.add(facts, "fact_id", "content")
    keys.add(facts.withColumn("index_keys", F.array_join("index_keys", " ")), "fact_id", "index_keys")
    requests = cases.select(F.col("id").alias("request_id"), "query.query", own(F.col("query.scope")).alias("scope"), _time("query.as_of").alias("as_of"), "query.budget")
    return MemoryTables(facts, entities=entities, content_index=content, keys_index=keys), requests


def run_retrieval(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cases (RETRIEVAL_CASE): their contexts, and the metrics of each tier. Cases that break the contract are an error."""
    broken = check_retrieval_cases(cases).limit(5).collect()
    if broken:
        raise ValueError("; ".join(f"{r['id']}: {r['reason']}" for r in broken))
    tables, requests = case_tables(cases)
    contexts = cut(assemble_contexts(tables, requests))
    empty = F.array().cast("array<string>")
    expected = cases.select("id", F.coalesce("expected.tier", F.lit("direct")).alias("tier"), F.coalesce("expected.must_contain", empty).alias("must_contain"), F.coalesce("expected.must_not_contain", empty).alias("must_not_contain"), F.coalesce("expected.expect_empty", F.lit(False)).alias("expect_empty"))
    return contexts, evals.retrieval_metrics(expected, contexts.select(F.col("request_id").alias("id"), F.col("place").alias("rank"), "content"), by_tier=False)


def run_extraction(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cases (EXTRACTION_CASE): metrics of the entities, and the share of expected fact types that were found."""
    e = cut(cases.select(F.col("id").alias("episode_id"), "content", _time("t_ref").alias("t_ref"), "scope"))
    expected = cases.select("id", F.explode("expected.entities").alias("x")).select("id", "x.entity_type", "x.canonical_name")
    actual = extraction.entities_of(e).select(F.col("episode_id").alias("id"), "entity_type", "canonical_name")
    types = cases.select("id", F.explode("expected.fact_types").alias("fact_type"))
    return evals.extraction_metrics(expected, actual), evals.fact_type_accuracy(types, extraction.facts_of(e).select(F.col("episode_id").alias("id"), "fact_type"))


def run_latency(tables: MemoryTables, request: ContextRequest, warmup: int = 1, measured: int = 5) -> DataFrame:
    """p50, p95 and p99 in milliseconds of one request asked again and again."""
    took = []
    for n in range(warmup + measured):
        began = time.perf_counter()
        assemble_context(tables, dataclasses.replace(request)).collect()  # a context has as many rows as its budget
        if n >= warmup:
            took.append((request.query, (time.perf_counter() - began) * 1000))
    return evals.latency_percentiles(tables.facts.sparkSession.createDataFrame(took, "query string, ms double"), "query", "ms")


def retrieval_suite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return run_retrieval(read_json_cases(spark, path, RETRIEVAL_CASE))


def extraction_suite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return run_extraction(read_json_cases(spark, path, EXTRACTION_CASE))
