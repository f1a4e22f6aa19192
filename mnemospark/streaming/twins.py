"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shared_folder
from ..sources.store import keep_new


def dedup_ingest(stream: DataFrame, key: str = "episode_id", time: str = "t_ingested", delay: str = "1 day") -> DataFrame:
    """Each key once within the watermark; foreachBatch(insert_new) keeps it once for good."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def insert_new(spark, path: str, key: str):
    """A foreachBatch sink that appends rows with new keys only: replays change nothing."""

    def sink(batch: DataFrame, _: int) -> None:
        try:
            old = spark.read.schema(batch.schema).parquet(path)
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = batch.limit(0)
        keep_new(batch, old, key).write.mode("append").parquet(path)

    return sink


def heat(stream: DataFrame) -> DataFrame:
    """Running access heat per fact; update or complete mode."""
    return stream.groupBy("fact_id").agg(F.sum("boost").alias("access_count"), F.max("ts").alias("last_accessed"))


def windowed_counts(stream: DataFrame, time: str, by: str, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    return (stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"))
            .select(F.col("window.start").cast("timestamp_ntz").alias("start"), by, "n"))


def sessions(stream: DataFrame, time: str, by: str, ttl: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions that end after ttl without activity."""
    return (stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.session_window(time, ttl), by).agg(F.count("*").alias("n"))
            .select(by, F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n"))


def supersede(stream: DataFrame) -> DataFrame:
    """Keeps the newest version of each triple in state and emits the version that a newer one closes. A row
    that is later in transaction time but older in valid time closes nothing."""
    out = "in_id string, relation string, out_id string, edge_id string, t_invalid timestamp, t_invalid_ingested timestamp"
    state = "edge_id string, t_valid long, t_ingested long"

    def step(key, frames, held):
        import numpy as np
        import pandas as pd

        now = held.get if held.exists else None
        names = ["in_id", "relation", "out_id", "edge_id", "t_invalid", "t_invalid_ingested"]
        for rows in frames:  # one Arrow batch at a time; batches of a group come in any order, state joins them
            rows = rows.sort_values(["t_ingested", "t_valid", "edge_id"])
            v, i = (rows[c].astype("int64").to_numpy() for c in ("t_valid", "t_ingested"))
            most = np.maximum.accumulate(np.r_[now[1] if now else np.iinfo(np.int64).min, v])
            newer = np.flatnonzero(v >= most[:-1])  # each of these closes the one before it
            if not len(newer):
                continue
            own = rows.iloc[newer]
            closed = own["edge_id"].shift(fill_value=now[0] if now else "")
            first = 0 if now else 1
            yield pd.DataFrame({**dict(zip(names, key)), "edge_id": closed[first:], "t_invalid": own["t_valid"][first:], "t_invalid_ingested": own["t_ingested"][first:]}, columns=names)
            now = (str(own["edge_id"].iloc[-1]), int(v[newer[-1]]), int(i[newer[-1]]))
        if now:
            held.update(now)

    typed = stream.withColumns({c: F.col(c).cast("timestamp") for c in ("t_valid", "t_ingested")})
    return typed.groupBy("in_id", "relation", "out_id").applyInPandasWithState(step, out, state, "append", "NoTimeout")


def periodic(clock: DataFrame, engine, path: str, **settings):
    """Decay and archival at each batch of a stream with a column ts (a rate source, or ticks that a scheduler
    writes): the batch's latest ts is the time of the pass, so a replayed batch changes nothing more. path: of the
    stream's checkpoint, in the shared folder."""

    def step(batch: DataFrame, _: int) -> None:
        last = batch.agg(F.max(F.col("ts").cast("timestamp_ntz"))).first()[0]
        if last is not None:
            engine.maintain(last, **settings)

    return clock.writeStream.foreachBatch(step).option("checkpointLocation", path)


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is; its rows and its state go to the shared folder, and the rows are read from
    there: those of every batch (append), or those of the last (complete). A batch that is replayed replaces its own
    rows. A stream without input gives an empty result."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([], df.schema).write.parquet(f"{path}/rows/none")

    def step(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/{'all' if mode == 'complete' else k}")

    q = df.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")
