"""Memory tables as append-only Parquet, partitioned by scope where there is one.

A write appends full rows with a version; readers see the newest version of a key. Deletes append a
tombstone. So every verb that changes rows is a plan: a DataFrame of new versions, which a dry run returns
and a real run appends.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, MapType, StructField, StructType

from ..schemas import KEYS, TABLES

VERSION, GONE = "_version", "_deleted"


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of schema in order and type; those that df lacks are null, others are left out."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def decode_facts(df: DataFrame, fact: StructType = TABLES["fact"]) -> DataFrame:
    """Typed facts: t_ingested defaults to t_valid, confidence to 0, arrays to empty; rows without id, type,
    content, source or t_valid are left out."""
    empty = F.array().cast("array<string>")
    return (conform(df, fact).na.drop(subset=["fact_id", "fact_type", "content", "source_episode", "t_valid"])
            .withColumns({"t_ingested": F.coalesce("t_ingested", "t_valid"), "confidence": F.coalesce("confidence", F.lit(0.0)),
                          "access_count": F.coalesce("access_count", F.lit(0))} | {c: F.coalesce(c, empty) for c in ("entity_links", "policy_tags", "index_keys")}))


def decode_episodes(df: DataFrame) -> DataFrame:
    """Typed episodes: t_ingested defaults to t_ref, visibility to the scope, tags to none; rows without id, content, scope or
    t_ref are left out."""
    empty = F.array().cast("array<string>")
    return (conform(df, TABLES["episode"]).na.drop(subset=["episode_id", "content", "scope", "t_ref"])
            .withColumns({"t_ingested": F.coalesce("t_ingested", "t_ref"), "visibility_scope": F.coalesce("visibility_scope", "scope"), "policy_tags": F.coalesce("policy_tags", empty)}))


def decode_communities(df: DataFrame) -> DataFrame:
    """Typed communities; those without a summary or without members are left out."""
    return conform(df, TABLES["community"]).na.drop(subset=["community_id", "summary"]).where((F.trim("summary") != "") & (F.coalesce(F.size("member_entities"), F.lit(0)) > 0))


def decode_edges(df: DataFrame) -> DataFrame:
    """Typed edges: strength and confidence default to 0; rows without id, ends or relation are left out."""
    return (conform(df, TABLES["edge"]).na.drop(subset=["edge_id", "in_id", "out_id", "relation"])
            .withColumns({"strength": F.coalesce("strength", F.lit(0.0)), "confidence": F.coalesce("confidence", F.lit(0.0))}))


def latest_versions(df: DataFrame, key: str, version: str = VERSION) -> DataFrame:
    """The newest version of each key, without keys whose newest version is a tombstone. An aggregation with
    map-side combine, not a window, so a key with many versions is no hot task.

    A row never moves to another scope, so scope is part of the grouping key: a filter on it (or on the key) passes
    the aggregation and prunes folders. Of equal versions a tombstone wins, then the larger hash of the row."""
    keys = [key, *(c for c in ("scope",) if c in df.columns and c != key)]
    cols = [c for c in df.columns if c not in keys]
    hashed = F.xxhash64(*[c for c in cols if not isinstance(df.schema[c].dataType, MapType)])
    gone = F.coalesce(F.col(GONE), F.lit(False)) if GONE in cols else F.lit(False)
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(F.col(version), gone, hashed)).alias("row")).select(*keys, "row.*").select(*df.columns)
    return newest.where(~F.coalesce(F.col(GONE), F.lit(False))) if GONE in cols else newest


def keep_new(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key is neither in old nor earlier in new: an idempotent insert."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")


class MemoryStore:
    """Tables under one folder that every executor reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, table: str) -> str:
        if table not in TABLES:
            raise ValueError(f"unknown table: {table}")
        return f"{self.path}/{table}"

    def _schema(self, table: str) -> StructType:
        return StructType([*TABLES[table].fields, StructField(VERSION, LongType()), StructField(GONE, BooleanType())])

    def versions(self, table: str) -> DataFrame:
        """All versions; a table that was never written is empty."""
        path, schema = self._path(table), self._schema(table)
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def read(self, table: str, scope: str | None = None) -> DataFrame:
        """The newest rows; with a scope, those of its folder alone. Of equal versions a tombstone wins, then what was
        written last."""
        df = self.versions(table)
        if scope is not None and "scope" in df.columns:
            df = df.where(F.col("scope") == scope)
        if table == "access_log":
            return df.drop(VERSION, GONE)
        if not df.inputFiles():
            return df.select(*TABLES[table].names)
        # which row is the newest is decided on narrow columns; only then are the others read, and only those asked for
        own = [KEYS[table], *(c for c in ("scope",) if c in df.columns)]
        at = df.withColumns({"_file": F.xxhash64("_metadata.file_path"), "_row": F.col("_metadata.row_index"), "_time": F.col("_metadata.file_modification_time")})
        newest = at.groupBy(*own).agg(F.max(F.struct(F.col(VERSION), F.coalesce(GONE, F.lit(False)).alias(GONE), F.col("_time"), F.col("_file"), F.col("_row"))).alias("m"))
        place = newest.where(~F.col(f"m.{GONE}")).select(*[F.col(c).alias(f"_{c}") for c in own], F.col("m._file").alias("_f"), F.col("m._row").alias("_r"))
        same = (F.col("_file") == F.col("_f")) & (F.col("_row") == F.col("_r"))
        for c in own:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return at.join(place, same, "left_semi").select(*TABLES[table].names)

    def find(self, table: str, record_id: str) -> DataFrame:
        return self.read(table).where(F.col(KEYS[table]) == record_id).limit(1)

    def append(self, table: str, rows: DataFrame, version: int, deleted: bool = False) -> None:
        out = conform(rows, TABLES[table]).withColumns({VERSION: F.lit(version).cast("long"), GONE: F.lit(deleted)})
        writer = out.write.mode("append")
        (writer.partitionBy("scope") if "scope" in TABLES[table].names else writer).parquet(self._path(table))

    def insert(self, table: str, rows: DataFrame, version: int) -> None:
        """Rows whose key is new; running it again changes nothing."""
        self.append(table, keep_new(conform(rows, TABLES[table]), self.read(table), KEYS[table]), version)

    def delete(self, table: str, keys: DataFrame, version: int) -> None:
        self.append(table, keys, version, deleted=True)

    def migrate(self, scripts: list[tuple[str, str, str]], version: int) -> list[str]:
        """Applies scripts (name, table, SQL of rows to append to it) in order, each once; returns the names of those
        it applied. A script that was applied with another text is an error, before anything is run."""
        path, schema = f"{self.path}/_migrations", "name string, checksum string, version long"
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        found = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        known = {r["name"]: r["checksum"] for r in self.spark.read.schema(schema).parquet(path).collect()} if found else {}  # a row per script
        sums = {name: hashlib.sha256(f"{table}\n{sql}".encode()).hexdigest() for name, table, sql in scripts}
        changed = [name for name, checksum in sums.items() if known.get(name, checksum) != checksum]
        if changed:
            raise ValueError(f"migrations were modified after they ran: {', '.join(changed)}")
        done = []
        for name, table, sql in scripts:
            if name not in known:
                self.append(table, self.query(sql), version)
                self.spark.createDataFrame([(name, sums[name], version)], schema).write.mode("append").parquet(path)
                done.append(name)
        return done

    def query(self, sql: str, **args) -> DataFrame:
        """Free SQL over the tables, with named parameters."""
        for table in TABLES:
            self.read(table).createOrReplaceTempView(table)
        return self.spark.sql(sql, args=args)


def read_json_cases(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Evaluation cases: one JSON array in a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def check_retrieval_cases(cases: DataFrame) -> DataFrame:
    """Cases that break the contract, with the reason: ids unique, expect_empty excludes must_contain, budget
    above zero, a known tier."""
    twice = cases.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("reason"))
    e, q = "expected", "query"
    reasons = F.array_compact(F.array(
        F.when(F.col(f"{e}.expect_empty") & (F.size(f"{e}.must_contain") > 0), "expect_empty with must_contain"),
        F.when(F.coalesce(F.col(f"{q}.budget"), F.lit(0)) <= 0, "budget must be positive"),
        F.when(~F.coalesce(F.col(f"{e}.tier"), F.lit("direct")).isin("direct", "alias", "temporal", "graph", "reasoning"), "unknown tier")))
    return cases.select("id", F.explode(reasons).alias("reason")).unionByName(twice)


def write_diff(diff: DataFrame, path: str, kind: str = "json") -> None:
    """Export of a temporal diff: rows as JSON, the changed ones nested in their kind, or their counts as Markdown lines."""
    from ..operators.lifecycle import diff_counts

    if kind == "json":
        diff.select("change", F.struct(*[c for c in diff.columns if c != "change"]).alias("fact")).write.mode("overwrite").partitionBy("change").json(path)
        return
    diff_counts(diff).select(F.format_string("- %s: %d", "change", "n").alias("value")).write.mode("overwrite").text(path)
