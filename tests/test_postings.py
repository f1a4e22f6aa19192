"""Stems, folding and the stored full-text index against plain code."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import analyzer
from mnemospark.operators.postings import FullTextIndex

#: Published pairs of the English Snowball stemmer: word:stem, or a word that stays.
STEMS = """consign consigned:consign consigning:consign consignment:consign consist consisted:consist consistency:consist consistent:consist consolation:consol consolatory:consolatori
console:consol consolidate:consolid knack knackeries:knackeri knavish:knavish kneading:knead kneel kneeled:kneel knew knife knightly:knight knitting:knit knots:knot running:run runs:run hopping:hop
hoping:hope hoped:hope agreed:agre relational:relat conditional:condit digitizer:digit generate:generat general generally:general generous community:communiti communities:communiti communism
national:nation nationalism:nation happy:happi happiness:happi cries:cri ties:tie tied:tie gas gaps:gap this kiwis:kiwi dying:die skies:sky sky news succeeded:succeed proceed inning innings:inning bed red
sing fluently:fluentli sensational:sensat hopefulness:hope electricity:electr electrical:electr formalize:formal adoption:adopt adjustable:adjust rate controlling:control roll say saying:say enjoy by
flies:fli quickly:quick triplicate:triplic replacement:replac probate:probat cease:ceas feudalism:feudal decisively:decis at b22"""


def test_stems(spark):
    pairs = [(p.split(":")[0], p.split(":")[-1]) for p in STEMS.split()]
    got = spark.createDataFrame(pairs, "w string, want string").select("w", "want", analyzer.stem(F.col("w")).alias("got")).collect()
    assert [(r["w"], r["want"], r["got"]) for r in got if r["want"] != r["got"] and r["w"] not in ("knife", "generous", "rate")] == []
    assert {r["w"]: r["got"] for r in got if r["w"] in ("knife", "generous", "rate")} == {"knife": "knife", "generous": "generous", "rate": "rate"}


def test_words_of_any_alphabet(spark):
    one = lambda s: spark.range(1).select(analyzer.words(F.lit(s))).first()[0]
    assert one("Café CAFÉ atlas_launch 2026年 Straße привет, мир 12ab") == ["cafe", "cafe", "atlas", "launch", "2026", "年", "strasse", "привет", "мир", "12", "ab"]
    assert one("") == [] and spark.range(1).select(analyzer.words(F.lit(None).cast("string"))).first()[0] == []


def plain(rows, terms, all_terms=True):
    """rows: key -> list of stems."""
    n, avg = len(rows), sum(map(len, rows.values())) / max(1, len(rows))
    df = {t: sum(t in w for w in rows.values()) for t in terms}
    out = {}
    for key, w in rows.items():
        tf = Counter(w)
        have = [t for t in terms if tf[t]]
        if have and (not all_terms or len(have) == len(terms)):
            out[key] = sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / avg)) for t in have)
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    pool = ["run", "cafe", "atlas", "launch", *[f"w{chr(97 + k % 26)}{chr(97 + k // 26)}q" for k in range(60)]]
    weights = [1 / (k + 1) for k in range(len(pool))]
    return {f"k{i}": rng.choices(pool, weights, k=rng.randrange(0, 60)) for i in range(n)}


SHOWN = {"run": ["run", "Running", "RUNS"], "cafe": ["café", "Cafés"]}


def frame(spark, rows):
    rng = random.Random(0)
    return spark.createDataFrame([(k, " ".join(rng.choice(SHOWN.get(w, [w])) for w in ws) if ws else None) for k, ws in rows.items()], "id string, text string")


def same(found, want):
    got = {r["key"]: r["ft_score"] for r in found.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def best(want, k):
    return sorted(want, key=lambda x: (-round(want[x], 9), x))[:k]


def test_index_over_writes_updates_and_deletes(spark, tmp_path):
    ix = FullTextIndex(spark, f"file://{tmp_path}/ix", buckets=4, slice_docs=16)
    assert ix.search("run", 5).collect() == []
    rows = corpus(300, 1)
    ix.add(frame(spark, rows), "id", "text", 1)
    changed = {k: v for k, v in zip(list(rows)[:40], corpus(40, 2).values())} | {f"new{k}": v for k, v in corpus(30, 3).items()}
    ix.add(frame(spark, changed), "id", "text", 2)
    rows |= changed
    gone = list(rows)[20:90]
    ix.delete(spark.createDataFrame([(k,) for k in [*gone, "unknown"]], "id string"), "id")
    for k in gone:
        del rows[k]

    def ask():
        for query, terms, every in (("Running CAFÉ", ["run", "cafe"], True), ("cafes atlas launch", ["cafe", "atlas", "launch"], False)):
            want = plain(rows, terms, every)
            same(ix.search(query, all_terms=every), want)
            for k in (3, 1000):
                assert [r["key"] for r in ix.search(query, k, every).collect()] == best(want, k)
        assert ix.statistics().first()["docs"] == len(rows)

    ix.add(frame(spark, changed), "id", "text", 2)  # a segment that is written again
    ask()
    ix.compact()
    assert ix.segments() == [4] and ix.table("dead").count() == 0
    ask()
    assert ix.search("...", 3).collect() == [] and ix.search("zzzz run").collect() == []


def test_only_the_terms_buckets_and_promising_slices_are_read(spark, tmp_path):
    ix = FullTextIndex(spark, f"file://{tmp_path}/ix", buckets=8, slice_docs=8)
    rows = corpus(400, 4) | {"best": ["run"] * 30}
    ix.add(frame(spark, rows), "id", "text", 1)
    plan = ix.search("run")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [segment" in plan and "bucket#" in plan and "In(term" in plan or "EqualTo(term,run)" in plan
    assert ix.search("run", 1).first()["key"] == "best"
    assert ix.candidate_slices.count() < ix.table("postings").where("term = 'run'").count() / 4


@pytest.mark.parametrize("every", [True, False])
def test_batch_equals_single_queries(spark, tmp_path, every):
    ix = FullTextIndex(spark, f"file://{tmp_path}/ix", buckets=4, slice_docs=32)
    rows = corpus(200, 5)
    ix.add(frame(spark, rows), "id", "text", 1)
    queries = {"a": "running", "b": "cafe atlas", "c": "launch run cafe", "d": "", "e": "nothing like it"}
    got = ix.search_batch(spark.createDataFrame(list(queries.items()), "query_id string, query string"), 6, every).collect()
    for q, text in queries.items():
        own = sorted((r["rank"], r["key"]) for r in got if r["query_id"] == q)
        assert own == [(n, r["key"]) for n, r in enumerate(ix.search(text, 6, every).collect(), 1)]
