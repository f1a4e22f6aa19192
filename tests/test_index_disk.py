"""Building an index writes the index and little else; batches of queries are scored where the blocks lie."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.functions import analyzer
from mnemospark.operators import postings
from mnemospark.operators.postings import FullTextIndex

POOL = [f"w{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in ("ning", "ned", "tion", "ly", "s")]


def corpus(n, words, seed=3):
    rng = random.Random(seed)
    return [(f"key:{k}", " ".join(rng.choices(POOL, [1 / (i + 1) for i in range(len(POOL))], k=rng.randrange(words)))) for k in range(n)]


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)


def test_an_index_needs_no_copies_of_its_postings(spark, tmp_path):
    rows = corpus(2_000, 300)
    text = sum(len(t) for _, t in rows)
    df = spark.createDataFrame(rows, "id string, text string")
    df.write.parquet(f"{tmp_path}/text")
    spark.range(1).checkpoint()
    checkpoints = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = size(checkpoints)
    ix = FullTextIndex(spark, f"file://{tmp_path}/ix", buckets=4)
    ix.add(spark.read.parquet(f"{tmp_path}/text"), "id", "text")
    assert size(checkpoints) - before < text / 10  # a checkpoint of the postings is several times the text
    assert size(tmp_path / "ix") < text
    docs = ix.table("docs")
    assert docs.count() == 2_000 and docs.select("slice", "place").distinct().count() == 2_000
    joined = ix.table("postings").select("slice", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("at").alias("place"), F.col("dls").alias("dl"))))
    assert joined.join(docs, ["slice", "key", "place", "dl"], "left_anti").count() == 0


def test_stems_of_words_outside_the_jvm(spark):
    rng = random.Random(1)
    ends = [*analyzer.STEP2, *analyzer.STEP3, *analyzer.STEP4, "ing", "ed", "eed", "eedly", "ingly", "s", "ies", "sses", "us", "y", "e", "ll", "gener", "commun", "log", "at", "bb", "ow", "run", "é", "ß", "1", "я"]
    words = sorted({"".join(rng.choices(ends, k=rng.choice([1, 2, 3]))) for _ in range(3_000)} | set(analyzer.SPECIAL) | set(analyzer.KEPT) | {"", "a", "yy"})
    got = spark.createDataFrame([(w,) for w in words], "word string").select("word", analyzer.stem_of("word").alias("stem")).collect()
    assert [(r["word"], r["stem"]) for r in got if analyzer.stem_word(r["word"]) != r["stem"]] == []


def test_ticks_round_as_spark_does(spark):
    rng = random.Random(2)
    x = [round(rng.random() * 20, 9) + d for _ in range(300) for d in (0.0, 5e-10, 4.999e-10, 5.001e-10)] + [0.0, 2.5e-9, 1.0000000005]
    want = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(F.round("v", 9)).collect()]
    assert (postings.ticks(np.array(x)) / 1e9).tolist() == want


@pytest.mark.parametrize("at_once", [2, 256])
def test_batches_over_slices_updates_and_ties(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(postings, "QUERIES_AT_ONCE", at_once)
    ix = FullTextIndex(spark, f"file://{tmp_path}/ix", buckets=2, slice_docs=16, english=False)
    rows = corpus(120, 12) + [(f"tie:{k:02d}", "same text") for k in range(30)]
    ix.add(spark.createDataFrame(rows, "id string, text string"), "id", "text", 1)
    ix.delete(spark.createDataFrame([("tie:00",), ("tie:02",), ("key:5",)], "id string"), "id")
    ix.add(spark.createDataFrame([("tie:01", "other text"), ("key:7", "same")], "id string, text string"), "id", "text", 3)
    queries = {1: "same", 2: "text same", 3: POOL[0], 4: f"{POOL[0]} {POOL[1]} text", 5: "other", 6: "nowhere", 7: ""}
    q = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    got = ix.search_batch(q, 4, False)
    assert dict(got.dtypes)["query_id"] == "bigint"
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" not in plan.lower()  # no row for a posting
    got = got.collect()
    for k, text in queries.items():
        want = [r["key"] for r in ix.search(text, 4, False).collect()]
        assert [r["key"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == k] == want
