"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import os
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def travels(name: str) -> None:
    """Executors get the functions of this module with the tasks; the package need not be installed there. For modules whose
    Arrow functions use names and not other modules of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, which only a local master can use."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"mnemospark-{uuid.uuid4().hex}")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


#: With it Spark removes an execution's shuffle files when it ends (since 4.1), not when the driver's garbage is collected.
_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def short_shuffles(spark: SparkSession):
    """What runs within leaves no shuffle files; the session's setting is put back."""
    before = spark.conf.get(_CLEANUP_CONF, None)
    spark.conf.set(_CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP_CONF)
        else:
            spark.conf.set(_CLEANUP_CONF, before)


def cut(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint; loops over frontiers use it once per round. The shuffle files that led to it go."""
    shared_folder(df.sparkSession)
    with short_shuffles(df.sparkSession):
        return df.select("*").checkpoint()  # a DataFrame of its own: the shuffles of df itself, if it has run, stay


#: Rows up to which a narrow table of keys is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 250_000


def small(df: DataFrame) -> DataFrame:
    """A narrow table behind a checkpoint, marked for broadcast if its counted rows allow it."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
