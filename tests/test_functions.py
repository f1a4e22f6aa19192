"""Golden behaviours of text, time and vector functions on small fixtures."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import ids, temporal, text, vector


def one(spark, expr, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} {t}" for n, t in zip(names, types(cols.values())))).select(expr.alias("x")).first()["x"]


def types(values):
    return ["timestamp_ntz" if isinstance(v, dt.datetime) else "double" if isinstance(v, float) else "bigint" if isinstance(v, int) else "array<double>" if isinstance(v, list) else "string" for v in values]


@pytest.mark.parametrize("content, want", [
    ("ARR grew to $3M. I will send the update by Friday.", {"metric", "promise", "status"}),
    ("We decided to move", {"decision"}), ("Решено:запускаем", {"decision"}), ("Задача:написать отчет", {"task"}),
    ("Revenue alone", set()), ("order 12345", {"requirement"}), ("barrel and narrative", set()),
    ("A plain remark that is certainly longer than fifty characters here", {"observation"})])
def test_fact_types(spark, content, want):
    got = set(one(spark, text.fact_types("c"), c=content))
    assert got == want


def test_names_and_types(spark):
    names = one(spark, text.name_candidates("c"), c="Alice Smith met Иван Петров at OpenAI in New York with Acme Corp")
    assert names == sorted({"Alice Smith", "Иван Петров", "OpenAI", "New York", "Acme Corp"})
    kinds = {n: one(spark, text.classify_entity(F.col("c")), c=n) for n in [*names, "Tech Summit"]}
    assert kinds == {"Alice Smith": "person", "Иван Петров": "person", "OpenAI": "technology", "New York": "location", "Acme Corp": "company", "Tech Summit": "event"}


def test_search_query_and_rewrites(spark):
    raw = 'episode:ab_1 "atlas launch" AND x or plan'
    assert text.search_query_text(raw) == "atlas launch plan"
    assert one(spark, text.search_query("c"), c=raw) == "atlas launch plan"
    assert text.temporal_expansions("sales last month", dt.datetime(2026, 3, 31)) == ["sales last month", "sales February 2026"]
    assert one(spark, text.tokens("c"), c="atlas_launch V2") == ["atlas", "launch", "v", "2"]
    assert text.is_relationship_query("Who knows Bob?") and not text.is_relationship_query("revenue")


def test_index_keys(spark):
    got = one(spark, text.index_keys("c", "t"), c="Due March  2026 and 2025-01-02", t=dt.datetime(2026, 3, 15))
    assert got == ["2025-01-02", "2026-03", "march 2026"]


def test_ids(spark):
    t = dt.datetime(2026, 3, 1, 10, 0, 0, 120_000)
    assert one(spark, ids.rfc3339("t"), t=t) == "2026-03-01T10:00:00.120+00:00"
    got = one(spark, ids.fact_id("a", "b", "c", "t"), a=" Note ", b="Hello   World", c="Episode:1", t=dt.datetime(2026, 3, 1))
    assert got == "fact:" + hashlib.sha256(b"note|hello world|episode:1|2026-03-01T00:00:00+00:00").hexdigest()[:24]


def test_decay(spark):
    now = dt.datetime(2026, 4, 11)
    assert one(spark, F.round(temporal.lifecycle_confidence(now, 100.0), 9), confidence=0.5, t_valid=dt.datetime(2026, 1, 1)) == 0.25
    assert one(spark, temporal.retrieval_confidence(dt.datetime(2025, 1, 1)), confidence=0.8, fact_type="note", t_valid=dt.datetime(2026, 1, 1)) == 0.8
    assert one(spark, temporal.retrieval_confidence(dt.datetime(2026, 6, 30)), confidence=0.8, fact_type="note", t_valid=dt.datetime(2026, 1, 1)) == 0.4


def test_transaction_time_keeps_an_unknown_invalidation_visible(spark):
    schema = "fact_id string, t_valid timestamp_ntz, t_ingested timestamp_ntz, t_invalid timestamp_ntz, t_invalid_ingested timestamp_ntz"
    d = lambda n: dt.datetime(2026, 1, n)
    df = spark.createDataFrame([("known", d(1), d(1), d(3), d(3)), ("unknown", d(1), d(1), d(3), d(9)), ("future", d(7), d(7), None, None), ("late", d(1), d(8), None, None)], schema)
    seen = {r[0] for r in df.where(temporal.active_at(d(5))).select("fact_id").collect()}
    assert seen == {"unknown"}


def test_vectors(spark):
    assert one(spark, vector.cosine(F.col("a"), F.col("b")), a=[3.0, 4.0], b=[6.0, 8.0]) == pytest.approx(1.0)
    assert one(spark, vector.dot(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 2.0]) == 0.0
    words = F.array(*[F.lit(str(i)) for i in range(10)])
    assert [w[0] for w in one(spark, vector.token_windows(words, 4, 1), a=1.0)] == ["0", "3", "6"]
