import datetime as dt

import pytest

from mnemospark.functions import cases
from mnemospark.operators.relational import page
from mnemospark.plans.retrieval import ContextRequest
from mnemospark.plans.sessions import ContextCache, Sessions, TokenBucket

T = dt.datetime(2026, 1, 1)


def test_cases(spark):
    df = spark.createDataFrame([("How many days before the trip?", ["a"], "2023/05/30 (Tue) 22:10", '["episode:1", {"factId": "f", "content": "c", "id": "e"}, 7]'),
                                ("Who knows Bob?", ["a", "b", "c"], "2024-01-01T00:00:00Z", "[]"), ("Who knows Bob?", ["a"], "soon", "[]")], "q string, s array<string>, d string, j string")
    rows = df.select(cases.question_tier("q", "s").alias("t"), cases.case_date("d").alias("d"), cases.context_items("j").alias("j")).collect()
    assert [r["t"] for r in rows] == ["temporal", "graph", "direct"]
    assert [r["d"] for r in rows] == ["2023-05-30T22:10:00Z", "2024-01-01T00:00:00Z", cases.DEFAULT_DATE]
    assert [(x["fact_id"], x["content"], x["source_episode"]) for x in rows[0]["j"]] == [(None, "", "episode:1"), ("f", "c", "e"), (None, "", "")]


def test_page(spark):
    df = spark.range(5)
    assert [(r["id"], r["has_more"]) for r in page(df, ["id"], 2, 2).collect()] == [(2, True), (3, True)]
    assert [(r["id"], r["has_more"]) for r in page(df, ["id"], 2, 4).collect()] == [(4, False)]


def test_sessions():
    s = Sessions(limit=2, ttl_seconds=60)
    a = s.create("diff", "org", {}, T)
    s.create("graph", "org", {}, T)
    with pytest.raises(RuntimeError):
        s.create("graph", "org", {}, T)
    later = T + dt.timedelta(seconds=61)
    with pytest.raises(TimeoutError):
        s.get(a.session_id, later)
    assert s.sweep(later) == 2 and s.create("diff", "org", {}, later)


def test_bucket():
    b = TokenBucket(rate=1, burst=2)
    assert [b.allow(T) for _ in range(3)] == [True, True, False] and b.allow(T + dt.timedelta(seconds=1))


def test_cache(spark):
    calls = []
    cache = ContextCache(size=2)
    ask = lambda q, scope="org": cache.get(ContextRequest(q, scope, T), lambda r: calls.append(r.query) or spark.range(1))
    ask("a  b"), ask("A b"), ask("c"), ask("d")
    assert calls == ["a  b", "c", "d"]
    cache.clear_scope("org")
    ask("d")
    assert calls[-1] == "d" and len(calls) == 4
