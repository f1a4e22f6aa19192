"""What checkpoints hold needs no shuffle files; components in rounds give the same by broadcast and by shuffle."""

import random
import time

import pytest

from mnemospark.llm import common

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def links_and_roots():
    r = random.Random(11)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 - i) for i in range(1, 90)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(170)]
    links += links[:20] + [(b, a) for a, b in links[20:40]] + [(5, 5), (3000, 3000)]
    up = {x: x for link in links for x in link if link[0] != link[1]}
    for a, b in links:
        if a != b and up[a] != up[b]:
            old, new = max(up[a], up[b]), min(up[a], up[b])
            up = {x: new if y == old else y for x, y in up.items()}
    return links, up


@pytest.mark.parametrize("value", ["false", "true"])
def test_a_cut_leaves_no_shuffle_files(spark, value):
    spark.conf.set(CLEANUP, value)
    try:
        df = spark.range(10_000).selectExpr("id % 97 AS k").groupBy("k").count()
        before = shuffle_files(spark)
        got = common.cut(df)
        until = time.time() + 10  # files go in the background
        while (left := shuffle_files(spark) - before) and time.time() < until:
            time.sleep(0.1)
        assert not left
        assert spark.conf.get(CLEANUP) == value
        assert got.count() == df.count() == common.cut(df).count() == 97
    finally:
        spark.conf.unset(CLEANUP)


@pytest.mark.parametrize("rows", [common.BROADCAST_ROWS, 600, 0])
def test_components_by_broadcast_and_by_shuffle(spark, monkeypatch, rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    links, up = links_and_roots()
    df = spark.createDataFrame(links, "a long, b long")
    got = [tuple(x) for x in common.components(df).collect()]
    assert sorted(got) == sorted(up.items())
