"""What the operators share: reading, cutting lineage, streaming texts through Python, components."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# executors get this package's functions with the tasks; it need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: White space of the contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary
    one is taken, which only a local master can use."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"mnemospark-{uuid.uuid4().hex}")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: With it Spark removes an execution's shuffle files when it ends (since 4.1), not when the driver's garbage is collected.
_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, so a lost executor costs no recomputation. The shuffle files
    that led to it go at once; the session's setting stays as it was."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEANUP_CONF, None)
    spark.conf.set(_CLEANUP_CONF, "true")
    try:
        return df.select("*").checkpoint()  # a DataFrame of its own: the shuffles of df itself, if it has run, stay
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP_CONF)
        else:
            spark.conf.set(_CLEANUP_CONF, before)


def written(df: DataFrame, what: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a narrow table of keys is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """A narrow table behind a checkpoint, marked for broadcast if its counted rows allow it."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """names, each made longer until no column of df is called so (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that a result column of the same name (in any case) would clash with."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


#: Bytes of a batch of rows on its way to a Python worker. Spark's own bound is 64 MB, which a batch takes several
#: times over: while it is built, in transit and in the worker, for each running task.
BATCH_BYTES, _BYTES_CONF, _BYTES_DEFAULT = "4m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def short_batches(spark: SparkSession) -> None:
    """Bounds batches to Python workers by BATCH_BYTES, unless the session has a bound of its own."""
    if spark.conf.get(_BYTES_CONF) == _BYTES_DEFAULT:
        spark.conf.set(_BYTES_CONF, BATCH_BYTES)


def sliced(batches, rows: int = 256, size: int = 512 << 10):
    """Arrow batches in slices of at most `rows` rows and about `size` bytes of text (a longer row is a slice of
    its own), so the Python objects of one slice are bounded whatever the lengths of the texts."""
    for batch in batches:
        taken = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
                taken += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(taken), 0
        while at < batch.num_rows:
            full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            to = min(max(full, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def give_back() -> None:
    """What a task has freed goes back to the system: Python workers are reused and would only ever grow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def through_python(df: DataFrame, work, schema: str, rows: int = 256) -> DataFrame:
    """work: a function without arguments, called once per task, that returns a function from a slice of
    an Arrow batch to a dict of column values; schema: of the result."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        each = work()
        for part in sliced(batches, rows):
            out = each(part)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)
        del each
        give_back()

    short_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Keys that hold more than this share of all rows are hot; there are fewer than its inverse.
HOT_SHARE = 1 / 50_000


def join_by_class(rows: DataFrame, classes: DataFrame, key: str, members: str, n_rows: int) -> DataFrame:
    """rows joined (left) with classes, one row per key, whose column `members` counts the key's rows. A key that
    holds more than HOT_SHARE of all rows is joined by broadcast, where its rows lie; there are fewer than
    1 / HOT_SHARE such keys. All other rows meet their class in a shuffle that no key can overload."""
    limit = max(1_000, int(n_rows * HOT_SHARE))
    hot = F.broadcast(classes.where(F.col(members) > limit).withColumn("__hot", F.lit(True)))
    marked = rows.join(hot, key, "left")
    new = [c for c in classes.columns if c != key]
    names = [*rows.columns, *new]
    cold = marked.where("__hot IS NULL").select(*rows.columns).join(classes.where(F.col(members) <= limit), key, "left")
    return marked.where("__hot").select(*names).unionByName(cold.select(*names))


def held_out(doc_id: str = "doc_id"):
    """crc32 of doc_id as text, mod 5, is 0; a null doc_id counts as the empty text (crc32 0: held out)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def numbered(df: DataFrame, *order) -> DataFrame:
    """df with a column `rank`, its place (from 0) in the order of these columns (nulls last), counted without
    gathering it: a range partitioning, ranks within the parts, then the counts of the parts."""
    keys = [x for c in order for x in (F.col(c).isNull(), F.col(c))]
    dealt = cut(df.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy("part").orderBy(*keys)) - 1
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row per part
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("local", local).join(F.broadcast(counts.select("part", before.alias("before"))), "part").withColumn("rank", F.col("before") + F.col("local")).drop("part", "local", "before")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): rows (node, root), root the smallest node that is reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each needs one aggregation and one
    join on narrow rows, and the number of rounds grows with the logarithm of the longest chain. Every
    round is cut by a checkpoint; only a count and a checksum reach the driver. The nodes' minima are broadcast while
    they can be no more than BROADCAST_ROWS, so a round shuffles minima and new links, not the links under both ends.
    Nodes without links are not in the result. A link of a node to itself is ignored.
    """

    def both_of(x: tuple, y: tuple):
        return F.inline(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (x, y)]))

    def stars(pairs: DataFrame, large: bool, few: bool) -> DataFrame:
        if large:
            both = pairs.select(both_of(("a", "b"), ("b", "a")))
        else:
            both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(F.broadcast(least) if few else least, "a")
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(both_of(("b", "m"), ("a", "m")))
        out = out.where("a <> b")
        return out if large and few else out.distinct()  # a large star gives no more rows than it reads

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())

    pairs = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = mark(pairs)
    if not before[0]:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        few = 2 * before[0] <= BROADCAST_ROWS
        pairs = cut(stars(stars(pairs, True, few), False, few))
        now = mark(pairs)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def steps_for(n: int) -> int:
    """More jumps than a jump hash over n shards makes but with a chance below 1e-12."""
    x = math.log(max(n, 2))
    return math.ceil(x + 8 * math.sqrt(x) + 8)
