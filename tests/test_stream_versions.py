"""Stateful supersession: any split and order of the input gives the batch result, and state ends."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import graphs
from mnemospark.streaming import twins, versions

T = dt.datetime(2026, 1, 1)
SCHEMA = "edge_id string, in_id string, relation string, out_id string, t_valid timestamp_ntz, t_ingested timestamp_ntz"


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get(versions.STORE[0])
    spark.conf.set(*versions.STORE)
    yield
    spark.conf.set(versions.STORE[0], before)


def run(spark, path, rows, files, last, **more):
    """Rows over so many files, each a batch; the last row comes after all of them and moves the watermark."""
    for part in [*(rows[k::files] for k in range(files)), [last]]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return twins.run_available(versions.supersede(stream, **more), "versions")


def test_order_and_split_do_not_matter(spark, rocks, tmp_path):
    pytest.importorskip("pandas")
    rng = random.Random(3)
    rows = [(f"e{k:02}", rng.choice("ab"), "r", "x", T + dt.timedelta(days=rng.randrange(25)), T + dt.timedelta(days=k, seconds=rng.randrange(100))) for k in range(40)]
    none = F.lit(None).cast("timestamp_ntz")
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"t_invalid": none, "t_invalid_ingested": none})
    want = sorted((r["edge_id"], r["t_invalid"], r["t_invalid_ingested"]) for r in graphs.close_superseded(df).where("t_invalid IS NOT NULL").collect())
    rng.shuffle(rows)
    end = ("end", "z", "r", "z", T, T + dt.timedelta(days=5000))
    for n in (1, 4):
        got = run(spark, f"file://{tmp_path}/{n}", rows, n, end, delay="4000 days")
        assert sorted((r["edge_id"], r["t_invalid"], r["t_invalid_ingested"]) for r in got.collect()) == want


def test_state_ends(spark, rocks, tmp_path):
    rows = [("old", "a", "r", "x", T, T), ("new", "a", "r", "x", T + dt.timedelta(days=9), T + dt.timedelta(days=9)), ("last", "a", "r", "x", T + dt.timedelta(days=10), T + dt.timedelta(days=10))]
    end = ("end", "z", "r", "z", T, T + dt.timedelta(days=100))
    got = run(spark, f"file://{tmp_path}/s", rows, 3, end, delay="0 seconds", ttl_seconds=3 * 86_400)
    assert [r["edge_id"] for r in got.collect()] == ["new"]  # the old one was forgotten before its closer came
