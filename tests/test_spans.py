"""Decoding and suppression of spans."""

import random
import time

import numpy as np

from mnemospark.operators import spans


def test_golden_logits_give_the_golden_names(spark):
    text = "New York City is big, said Al Gore"
    offsets, at = [], 0
    for w in text.split(" "):
        offsets.append((at, at + len(w)))
        at += len(w) + 1
    win = spans.windows(spark.createDataFrame([(1, offsets), (2, [])], "id int, offsets array<struct<start:int,end:int>>"), 6).collect()
    assert [(r["first"], len(r["offsets"])) for r in win] == [(0, 6), (6, 2)]
    rows = []
    for r in win:
        n, first, logits = len(r["offsets"]), r["first"], []
        for a in range(n):
            for b in range(a, min(a + 12, n)):
                x = (first + a, first + b)
                logits.append([3.0 if x == (6, 7) else -5.0, {(0, 1): 1.0, (0, 2): 4.0, (2, 2): 2.0}.get(x, -5.0), 9.0])
        rows.append((1, text, r["offsets"], logits))
    scored = spark.createDataFrame(rows, "id int, text string, offsets array<struct<start:int,end:int>>, logits array<array<double>>")
    got = {(r["entity_type"], r["canonical_name"]) for r in spans.names_of(scored, ["person", "place"]).collect()}
    assert got == {("place", "New York City"), ("place", "City"), ("person", "Al Gore")}  # New York overlaps the better one by more than half


def plain(items, most):
    kept = []
    for a, b, s in sorted(items, key=lambda x: (-x[2], x[0], x[1])):
        if all(not ((i := min(b, y) - max(a, x)) > 0 and i / (b - a + y - x - i) > most) for x, y, _ in kept):
            kept.append((a, b, s))
    return sorted(kept)


def test_suppression_equals_greedy(spark):
    rng = random.Random(1)
    rows = [(d, rng.choice("pq"), (a := rng.randrange(300)), a + rng.choice([0, 1, 2, 3, 5, 9, 30, 200]), rng.randrange(20) / 20) for d in range(3) for _ in range(250)]
    df = spark.createDataFrame(rows, "doc int, label string, start int, end int, score double")
    for most in (0.5, 0.2, 0.8):
        got = {}
        for r in spans.suppress_overlaps(df, ["doc"], most).collect():
            got.setdefault((r["doc"], r["label"]), []).append((r["start"], r["end"], r["score"]))
        for d in range(3):
            for label in "pq":
                assert sorted(got[d, label]) == plain([r[2:] for r in rows if r[:2] == (d, label)], most)
    assert spans.suppress_overlaps(df.limit(0), ["doc"]).count() == 0


def test_many_spans_take_linear_time():
    rng = np.random.default_rng(0)

    def took(n):
        a = rng.integers(0, 2 * n, n)
        began = time.perf_counter()
        spans.greedy(a, a + rng.integers(1, 12, n), rng.random(n), 0.5)
        return time.perf_counter() - began

    took(1_000)
    assert took(80_000) < 12 * max(took(20_000), 0.02)
