"""Clustering, line dedup and the filter audit against brute force, SQL and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from mnemospark.llm import clustering, filter_audit, line_dedup
from mnemospark.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_clustering", "op12_line_dedup", "op13_filter_audit"])
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), c.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    rows = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(object).values.tolist()))
    assert rows(got) == rows(want)


# -- clustering -------------------------------------------------------------------------------------------
def lloyd(rows, k, rounds, dims):
    limit = clustering.component_limit(dims)
    kept = [(i, [min(max(math.floor(max(min(256.0 * x, 2.0**60), -2.0**60)), -limit), limit) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n])] if own[n] else c for n, c in enumerate(centroids)]
    label = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in label:
        inertia[n] += d
    return sorted((str(i), n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in label)


def clustered(spark, rows, k, dims, kind="vec_id long, embedding array<double>, cluster string, distance int, Inertia int"):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], kind).repartition(3)
    got = clustering.centroid_clusters(df, k, 5, dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in got.collect())


def test_clusters_equal_plain_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 3, (5, 8))
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.02, 8)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # a third are copies
    rows += [(7, rows[3][1]), (7, rows[4][1]), (None, rows[5][1]), (None, rows[5][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 7), (2003, [float("nan")] + [0.0] * 7), (2004, [float("inf")] + [0.0] * 7), (2005, [None] + [0.0] * 7)]
    assert clustered(spark, rows, 9, 8) == lloyd(rows, 9, 5, 8)


def test_clusters_large_components_few_rows_and_none(spark):
    rows = [(1, [1e300, -1e300]), (2, [3e5, 1.5]), (3, [-2.5, 0.001])]
    limit = clustering.component_limit(2)
    assert 2 * (2 * limit) ** 2 < 2**63
    got = clustered(spark, rows, 40, 2)
    assert [g[:2] for g in got] == [g[:2] for g in lloyd(rows, 40, 5, 2)] and all(g[2] == 0 for g in got)
    assert clustered(spark, [(1, None), (2, [1.0])], 3, 2) == []
    assert clustering.centroid_clusters(spark.createDataFrame([], "vec_id string, embedding array<float>")).collect() == []


def test_balls_go_as_a_whole_and_distances_are_exact():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-5, 5, (500, 6)) + 1000 * k for k in range(4)]).astype(np.int64)
    tree = clustering.BallTree(points)
    centroids = np.array([[1000 * k] * 6 for k in range(4)], np.int64)
    whole, loose, _ = tree.assign(centroids)
    assert whole and len(loose) < len(points) / 10  # most are never compared
    label, distance = clustering.BallTree.load(tree.dump(), 6).labels(centroids)
    plain = ((tree.points[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (label == plain.argmin(1)).all() and (distance == plain.min(1)).all()
    ties = np.zeros((100, 6), np.int64)
    assert (clustering.BallTree(ties).labels(np.array([[1] * 6, [-1] * 6]))[0] == 0).all()
    big = np.array([[2**27] * 64, [-(2**27)] * 64], np.int64)
    assert clustering.squared_distances(big, big)[0, 1] == 64 * 2**56


# -- lines ------------------------------------------------------------------------------------------------
def plain_lines(rows, least_docs=3, least_chars=20):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    order = lambda d: (d is not None, d if d is not None else 0)
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars:
                holders[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [len(h := holders.get(key(x), set())) >= least_docs and d != max(h, key=order) for x in lines]
        out.append((str(d), len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out)


def line_result(spark, rows, parts=5, **more):
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, pos int, Keep string").repartition(parts)
    return sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.drop_lines(df, **more).collect())


def line_corpus(n, seed):
    rng = random.Random(seed)
    pool = [f"{'Line' if k % 2 else 'LINE'} number {k} of the shared ones é" for k in range(30)] + ["short", "", "   ", "ÀÉ" * 10, "İ" * 20]
    rows = []
    for d in range(n):
        lines = [rng.choice(pool) for _ in range(rng.randrange(1, 8))] + [f"own line of document {d} here"]
        if rng.random() < 0.4:
            lines += ["a banner which very many documents hold  "] * rng.randrange(1, 4)
        rows.append((d, rng.choice(["", " ", "\t"]) + "\n".join(lines) + rng.choice(["", "\n", "\r"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_brute_force(spark, seed):
    rows = line_corpus(300, seed)
    rows += [(None, rows[0][1]), (None, "another text without an id, long enough"), (5, rows[6][1]), (5, rows[5][1]), (1000, None), (1001, ""), (1002, "\n\n"), rows[9]]
    rows += [(2000, "\n".join(["one line in a very long text"] * 20_000)), (2001, "one line in a very long text"), (2002, "x" * 300_000 + "\nONE line in a very long text ")]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "11")  # the hot line is cut into several tasks
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert line_result(spark, rows) == plain_lines(rows)
        assert line_result(spark, rows[:60], least_docs=2, least_chars=5) == plain_lines(rows[:60], 2, 5)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_lines_of_nothing(spark):
    assert line_result(spark, []) == [] and line_result(spark, [(1, None)]) == [("1", 1, 0, "")]


def test_runs_do_not_depend_on_batches():
    rng = np.random.default_rng(7)
    n = 3_000
    h1 = np.sort(rng.choice([1, 2, 2, 2, 3, 4, 5, 6, 7], n))
    doc = rng.integers(0, 400, n)
    order = np.lexsort((-doc, h1))
    whole = pa.RecordBatch.from_arrays([pa.array(h1[order]), pa.array(np.zeros(n, np.int64)), pa.array(doc[order]), pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n, dtype=np.int32))], names=["h1", "h2", "doc_id", "text_key", "pos"])

    def result(step):
        runs = line_dedup._Runs(3)
        out = [x for at in range(0, n, step) for x in runs.push(whole.slice(at, step))] + list(runs.close())
        rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
        return sorted((x[4], x[5] is None) for x in rows)

    first = result(n)
    assert all(result(step) == first for step in (1, 2, 7, 100, 999))
    assert sum(not gone for _, gone in first) < 60  # only the ends stay open


def test_bitmaps():
    for dropped, n in (([0], 1), ([7], 8), ([8], 9), ([3, 5, 40], 100)):
        keep = line_dedup.unpack_bitmap(line_dedup.pack_bitmap(dropped), n)
        assert np.flatnonzero(~keep).tolist() == dropped and len(keep) == n
    assert line_dedup.unpack_bitmap(None, 3).all()


# -- filters ----------------------------------------------------------------------------------------------
def plain_audit(docs, labels):
    order = lambda d: (d is None, d if d is not None else 0)
    least = {}
    for d, t, _ in docs:
        least[t or ""] = min(least.get(t or "", d), d, key=order)
    tell = lambda d, k: d is not None and any(x[0] == d and x[k] == 1 for x in labels)
    each = []
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t), order(d) > order(least[t]))) if x}
        each.append((lang or "", bad, tell(d, 1), tell(d, 2)))
    out = []
    for part in {e[0] for e in each}:
        own = [e for e in each if e[0] == part]
        shap = Counter()
        for o in permutations("ABCDE"):
            for _, bad, _, _ in own:
                shap[next((f for f in o if f in bad), None)] += 1
        for o in permutations("ABCDE"):
            for s, f in enumerate(o, 1):
                gone = [e for e in own if f in e[1] and not e[1] & set(o[:s - 1])]
                out.append((part, "".join(o), s, sum(not e[1] & set(o[:s]) for e in own), len(gone), sum(f in e[1] and bool(e[1] & set(o[:s - 1])) for e in own), sum(e[1] == {f} for e in own), sum(e[2] for e in gone), sum(e[3] for e in gone), shap[f]))
    return sorted(out)


def test_audit_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_BYTES", 5_000)  # chains are sent on several times
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Word", "word", "x", f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(1, 500))) + rng.choice(["", " #", " $ "]) for _ in range(40)]
    docs = [(d, rng.choice(texts), rng.choice(["en", "de", None, "", "fr"])) for d in range(200)] + [(300 + d, "the hot text", "en") for d in range(100)]
    docs += [(None, texts[0], "en"), (None, "only without an id", None), (7, texts[1], "en"), (7, texts[2], "de"), docs[11], docs[11], (900, None, "en"), (901, "", "en"), (902, "word " * 100_000, "en")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in range(0, 250, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (99999, 1, 1)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], "doc_id long, text string, lang string, mask int, fp string, part int").repartition(6)
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(docs, labels)


def test_audit_of_nothing_and_string_ids(spark):
    labels = spark.createDataFrame([], "doc_id string, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], "doc_id string, text string, lang string"), labels).collect() == []
    few = filter_audit.later_copies(spark.createDataFrame([("b", "t"), ("a", "t"), ("c", "u"), (None, "t"), ("b", "t")], "doc_id string, text string"))
    assert sorted(str(r[0]) for r in few.collect()) == ["None", "b"]


def test_chains_keep_texts_of_one_fingerprint_apart():
    c = filter_audit.Chains()
    assert [c.add(1, b"a", 5), c.add(1, b"b", 9), c.add(1, b"a", 3), c.add(1, b"b", 9), c.add(1, b"b", 10), c.add(1, b"a", None)] == [(), (), (5,), (), (10,), (None,)]
    assert sorted(c.empty()) == [(1, b"a", 3), (1, b"b", 9)] and not c.chains


def test_many_filters_merge_in_a_tree():
    import time

    from mnemospark.llm.exact_dedup import CountingQuotientFilter, merged

    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 1 << 60, 200, np.uint64) for _ in range(2_000)]
    parts[7][:5] = parts[1_500][:5]
    began = time.perf_counter()
    whole = merged(CountingQuotientFilter.of(x) for x in parts)
    assert time.perf_counter() - began < 5  # 8.6 s one after another
    fps, n = np.unique(np.concatenate(parts), return_counts=True)
    assert (whole.fingerprints() == fps).all() and (whole.counts == n).all()


def test_draws_of_a_mix_decide_its_shards(spark, monkeypatch):
    from mnemospark.llm import mixing

    monkeypatch.setattr(mixing, "SHARD_SLOTS", 40)
    docs = spark.createDataFrame([(i, " ".join(["w"] * (20 + i % 50)), "ab"[i % 3 == 0], 0) for i in range(300)] + [(900, None, "a", 0)], "doc_id long, text string, source string, slots int")
    mix = mixing.Mix(docs)
    drawn = {(r["shard"], r["source"]): r["slots"] for r in mix.drawn().collect()}
    wanted = {r["source"]: r["n_slots"] for r in mix.sources.collect()}
    n_shards = max(s for s, _ in drawn) + 1
    assert n_shards > 5 and {s: sum(v for (_, x), v in drawn.items() if x == s) for s in wanted} == wanted
    assert len({v for (_, x), v in drawn.items() if x == "a"}) > 3  # as chance has it, not all alike
    assert {(r["shard"], r["source"]): r["slots"] for r in mixing.Mix(docs).drawn().collect()} == drawn
    rows = mix.taken().collect()
    assert all((r["first_shard"] is None) == (r["slots"] == 0) for r in rows) and len(rows) == 301
    held = mix.mixture().groupBy("shard", "sid").agg({"block": "count"}).count()
    assert held == len(drawn) and all(0 <= r["first_shard"] + r["shard_spread"] < n_shards for r in rows if r["slots"])
