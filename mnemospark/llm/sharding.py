"""Sharding: a two-pass external shuffle in DataFrame operations only.

Pass 1 scatters every row into a bucket that fits in memory: its shard by a seeded jump hash of doc_id and
the number of shards (law `key`), its bucket inside the shard by another seeded hash of the row. Pass 2
gathers one bucket per task, puts it in order with a Fisher-Yates shuffle (Spark's `shuffle`, seeded) and
writes it. A shard is the concatenation of its buckets, so every order of a shard is as likely as any other.

Nothing depends on the size of a source or of a group of copies: rows are dealt by hash one by one. The
number of buckets follows the bytes of the input, so a task holds about `bucket_bytes` at any scale.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import steps_for, table, without, written

ROW_OVERHEAD = 8
#: Buckets (16 bytes each) up to which their starts are broadcast; beyond, they are joined by a shuffle.
BROADCAST_BUCKETS = 200_000


def byte_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_OVERHEAD


def jump_shard(key: Column, n: int, seed: int) -> Column:
    """A jump consistent hash (Lamping and Veach, 2014) with xxhash64 as its generator.

    The jumps of a key do not depend on n, only where they stop does; one more shard therefore takes rows
    only into itself. A null key is a key like any other.
    """
    h = F.xxhash64(F.lit(seed), key)
    state = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def jump(acc: Column, k: Column) -> Column:
        u = (F.xxhash64(acc["h"], k).bitwiseAND(F.lit((1 << 53) - 1)) + 1).cast("double") / float(1 << 53)
        to = F.least(F.floor((acc["j"] + 1).cast("double") / u), F.lit(1 << 60)).cast("long")
        return F.when(acc["j"] < n, F.struct(acc["h"].alias("h"), acc["j"].alias("b"), to.alias("j"))).otherwise(acc)

    start = F.struct(h.alias("h"), *[state[c].alias(c) for c in ("b", "j")])
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps_for(n))), start, jump, lambda acc: acc["b"].cast("int"))


def shuffle_into_shards(docs: DataFrame, n_shards: int = 24, bucket_bytes: int = 32 << 20, seed: int = 20_240_229,
                        key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of docs, written to the shared folder in shuffled order, with law, shard,
    grown_shard (the shard if there were one more) and slot (the place in the shard, gapless from 0).

    Nulls: a null text has size 8, a null key is hashed as such. Rows with the same key lie in one shard
    but in any of its buckets and places. An empty table gives an empty result. Columns of docs named like
    a result column are left out. No row is dropped.
    """
    docs = without(docs, "law", "shard", "grown_shard", "slot", "bucket", "place")
    total = docs.select(F.sum(byte_size(text))).first()[0] or 0
    per_shard = max(1, math.ceil(total / (n_shards * bucket_bytes)))
    h = F.xxhash64(F.lit(seed + 1), F.col(key), F.monotonically_increasing_id())
    shard = jump_shard(F.col(key), n_shards, seed)
    dealt = docs.withColumns({"shard": shard, "grown_shard": jump_shard(F.col(key), n_shards + 1, seed), "place": h})
    dealt = dealt.withColumn("bucket", (F.col("shard") * per_shard + F.pmod("place", F.lit(per_shard))).cast("int"))
    rows = F.struct(*[F.col(f"`{c}`") for c in docs.columns], "grown_shard")
    shuffled = (
        dealt.repartitionById(n_shards * per_shard, "bucket")  # one bucket, one task
        .sortWithinPartitions("bucket", "place")  # the order that the seeded shuffle starts from
        .groupBy("bucket").agg(F.collect_list(rows).alias("rows"))
        .select("bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("place", "row"))
        .select("bucket", "place", "row.*")
    )
    files = written(shuffled, "shards")
    ends = files.groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(_in_shard(per_shard)) - F.col("n")
    starts = ends.withColumn("start", before).select("bucket", "start")
    if n_shards * per_shard <= BROADCAST_BUCKETS:
        starts = F.broadcast(starts)  # a checked size: the written rows are then not moved again
    return files.join(starts, "bucket").select(
        *[F.col(f"`{c}`") for c in docs.columns], F.lit("key").alias("law"),
        F.floor(F.col("bucket") / per_shard).cast("int").alias("shard"), "grown_shard",
        (F.col("start") + F.col("place")).cast("long").alias("slot"),
    )


def _in_shard(per_shard: int):
    from pyspark.sql import Window

    return Window.partitionBy(F.floor(F.col("bucket") / per_shard)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shuffle_into_shards(docs).select(
        "doc_id", byte_size().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        "law", "shard", "slot", "grown_shard",
    )
