"""The pipeline's near-copy stage goes by SimHash first; bands add what fingerprints miss."""

import random

import corpus_pipeline
import pytest

from mnemospark.llm import near_copies, simhash
from mnemospark.llm.common import components


@pytest.mark.parametrize("parts", [simhash.PARTS, 3])
def test_class_links_connect_what_is_within_three_bits(spark, monkeypatch, parts):
    monkeypatch.setattr(simhash, "PARTS", parts)
    r = random.Random(7)
    fps = []
    for base in (r.getrandbits(64) for _ in range(20)):
        fps += [base] * r.randint(1, 6) + [base ^ sum(1 << bit for bit in r.sample(range(64), d)) for d in (1, 2, 3, 4, 5)]
    up = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "cls long, fp long")
    root = {x["node"]: x["root"] for x in components(simhash.class_links(df)).collect()}
    assert [root.get(i, i) for i in range(len(fps))] == up


def test_the_stage_finds_close_copies_by_simhash_alone(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{k}" for k in range(5000)]
    base = [" ".join(r.choices(words, k=900)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " end") for i, t in enumerate(base)]
    rows += [(200, base[0] + " " + base[1])]  # no copy: a Jaccard similarity of about a half
    print_of = lambda t: simhash.majority(near_copies.np.unique(simhash.shingle_hashes(t, 5)))
    close = {100 + i for i, t in enumerate(base) if (print_of(t) ^ print_of(t + " end")).bit_count() <= 3}
    assert len(close) > 8
    met = near_copies.met_in_bands
    monkeypatch.setattr(near_copies, "met_in_bands", lambda classes: met(classes).limit(0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {x["doc_id"] for x in corpus_pipeline.simhash(spark, docs, "").collect()}
    assert {i for i, _ in rows} - left == close
