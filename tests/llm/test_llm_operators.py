"""The ten operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty
tables and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mnemospark.llm import exact_dedup, html_pages, html_text, lang_id, licenses, mixing, packing, sharding, simhash, topk, toxicity
from mnemospark.llm.common import components

WORDS = "the of and ship license mit apache general public mountain river stone bird loud quiet green".split()


def some_docs(seed=0, n=60):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randint(1, 60))), r.choice(["en", "fr", None]), r.choice(["s1", "s2", None])) for i in range(n)]
    rows += [(n, None, None, None), (n + 1, "", "en", "s1"), (n + 2, " \t\n", "en", "s2"), (n + 3, rows[3][1], "en", "s1"), (n + 4, rows[3][1].replace(" ", "\n", 1), "en", "s1"),
             (3, rows[3][1], "en", "s1"), (n + 5, "word " * 3000, "en", "s2"), (None, "no id here", "en", "s1"), (n + 6, rows[5][1] + " tail", "en", "s1")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    clash = ["shard", "slot", "fingerprint", "kept", "score", "piece"]
    df = spark.createDataFrame(some_docs(), SCHEMA).repartition(3)
    return df.select("*", *[F.lit("x").alias(c) for c in clash])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_sharding(docs, none):
    got = sharding.shuffle_into_shards(docs, 5, bucket_bytes=2000).toPandas()
    assert Counter(got.text.fillna("-")) == Counter((t if t is not None else "-") for _, t, *_ in some_docs())
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    moved = got[got.shard != got.grown_shard]
    assert set(moved.grown_shard) <= {5} and set(got.shard) <= set(range(5))
    per_id = defaultdict(set)
    for i, s in zip(got.doc_id, got.shard):
        per_id[i].add(s)
    assert all(len(s) == 1 for s in per_id.values())
    again = sharding.shuffle_into_shards(docs.select("doc_id", "text"), 5).toPandas()
    of = lambda df: {i: x for i, x in zip(df.doc_id, df.shard) if i == i}
    assert of(again) == of(got)
    assert sharding.shuffle_into_shards(none, 5).count() == 0


def test_sharding_is_even(spark):
    got = spark.range(20_000).select(sharding.jump_shard(F.col("id"), 24, 1).alias("s")).groupBy("s").count().toPandas()
    assert len(got) == 24 and got["count"].min() > 700 and got["count"].max() < 970


def test_exact_groups(docs, none):
    got = exact_dedup.exact_groups(docs).toPandas()
    groups = defaultdict(list)
    for i, t, *_ in some_docs():
        groups[norm(t)].append(i)
    by_hash = {sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    assert len(got) == len(some_docs())
    for h, g in got.groupby("text_sha256"):
        ids = [i for i in by_hash[h] if i is not None]
        assert set(g.group_size) == {len(by_hash[h])} and g.kept.sum() == 1
        if ids:
            assert set(g.keep_id) == {min(ids)}
    assert exact_dedup.exact_groups(none).count() == 0
    left = exact_dedup.drop_copies(docs.select("doc_id", "text", "lang", "source")).toPandas()
    assert len(left) == len(groups) and set(left.text.map(norm)) == set(groups)


def test_quotient_filters_merge_without_loss():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 1 << 50, 500, dtype=np.uint64), r.integers(0, 1 << 50, 500, dtype=np.uint64)
    b[:100] = a[:100]
    one = exact_dedup.CountingQuotientFilter.of(np.r_[a, a[:7]])
    two = exact_dedup.CountingQuotientFilter.load(exact_dedup.CountingQuotientFilter.of(b).dump())
    both = exact_dedup.CountingQuotientFilter.load(one.merge(two).dump())
    assert dict(zip(both.fingerprints().tolist(), both.counts.tolist())) == dict(Counter(np.r_[a, a[:7], b].tolist()))


def plain_fingerprint(t, k=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, near):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def test_simhash(docs, none):
    got = simhash.near_groups(docs).toPandas()
    rows = some_docs()
    want = {(i, t): plain_fingerprint(t) for i, t, *_ in rows}
    fps = sorted(set(want.values()))
    root = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(lambda: 1 << 62)
    for (i, t), f in want.items():
        if i is not None:
            least[root[f]] = min(least[root[f]], i)
    expect = Counter((i, f, least[root[f]] if root[f] in least else None) for (i, t), f in [((i, t), want[i, t]) for i, t, *_ in rows])
    have = Counter((None if np.isnan(i) else int(i), f & (1 << 64) - 1, None if np.isnan(c) else int(c)) for i, f, c in zip(got.doc_id, got.fp.tolist(), got.component_id))
    assert have == expect
    assert simhash.near_groups(none).count() == 0


@pytest.mark.parametrize("heavy", [simhash.HEAVY, 2])
def test_simhash_links_planted_distances(spark, heavy):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        for d in (1, 2, 3, 4, 5):
            x = b
            for bit in r.sample(range(64), d):
                x ^= 1 << bit
            fps.add(x)
        fps |= {b & ~0xFFFFFFFF | r.getrandbits(32) for _ in range(6)} | {b & ~0xFFFFFFFF | b & 0xFFFF | r.getrandbits(3) << 28 for _ in range(6)}  # full buckets
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f, 0, f) for f in signed], "fp long, family long, node long")
    got = {r["node"]: r["root"] for r in components(simhash.links(df, heavy=heavy)).collect()}
    root = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    groups, mine = defaultdict(set), defaultdict(set)
    for f, s in zip(fps, signed):
        groups[root[f]].add(s)
        mine[got.get(s, s)].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_near_copies_leave_one(spark):
    r = random.Random(5)
    text = " ".join(r.choices([f"w{i}" for i in range(500)], k=900))
    copies = [(10 + k, text.replace(text.split()[50 + k], f"edit{k}", 1)) for k in range(6)]
    other = [(100 + k, " ".join(r.choices([f"w{i}" for i in range(500)], k=300))) for k in range(5)]
    df = spark.createDataFrame([(5, text), *copies, *other], "doc_id long, text string")
    left = sorted(x["doc_id"] for x in simhash.drop_near_copies(df).collect())
    assert left == [5, 100, 101, 102, 103, 104]


def test_packing(docs, none):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    got = packing.pack_documents(docs, with_ids=True).toPandas()
    want = Counter()
    for i, text, *_ in some_docs():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            own = ids[a:a + 4096]
            want[(i, k, a, len(own), zlib.crc32(own.tobytes()))] += 1
    have = Counter((None if np.isnan(i) else int(i), k, s, n, c) for i, k, s, n, c in zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32))
    assert have == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.length.cumsum() - g.length == g.offset).all() and g.length.sum() <= 4096
    assert got.sequence_id.nunique() == -(-got.length.sum() // 4096)
    assert packing.pack_documents(none).count() == 0


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer
    import public_tokenizers

    path = public_tokenizers.path(packing.TOKENIZER)
    t, mine = Tokenizer.from_file(path), packing.Ids(path)
    for x in ["", "Don't STOP 3.5² ¼ a_b ÀÉÎ ½x 's'tt <|endoftext|>", "İstanbul Σας ﬁ", "a\x1cb\x85c", "日本語 text", "L'été… “q”", "x" * 500, "😀 oḱ", "ß\xadq ªº µ", "\t a \n"]:
        assert mine.of(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_best_two_fit_replaces():
    out = packing.best_two_fit([6, 3, 2, 2], 10)  # 6 and 3 leave a gap of 1; 2 and 2 fill 3's place exactly
    assert sorted(map(sorted, out)) == [[2, 2, 6], [3]]
    r = random.Random(0)
    lengths = [r.randint(1, 4096) for _ in range(500)]
    out = packing.best_two_fit(lengths)
    assert sorted(n for b in out for n in b) == sorted(lengths) and max(map(sum, out)) <= 4096
    assert packing.best_two_fit([]) == []


def plain_best_two_fit(lengths, capacity):
    left, out = Counter(lengths), []
    while left := +left:
        filled, gap = [], capacity
        while fits := [n for n in left if left[n] and n <= gap]:
            filled.append(max(fits))
            left[filled[-1]] -= 1
            gap -= filled[-1]
        if gap and +left:
            for total in range(gap + filled[-1], filled[-1], -1):
                pairs = [a for a in +left if left[total - a] > (a == total - a)]
                if pairs:
                    a = max(pairs)
                    left[filled.pop()] += 1
                    left.subtract((a, total - a))
                    filled += [a, total - a]
                    break
        out.append(filled)
    return out


def test_the_plan_is_best_two_fit_piece_by_piece():
    r = random.Random(0)
    for _ in range(200):
        capacity = r.choice([7, 10, 23, 40])
        lengths = [min(capacity, max(1, int(r.expovariate(4 / capacity)))) for _ in range(r.randint(0, 150))]
        assert packing.best_two_fit(lengths, capacity) == plain_best_two_fit(lengths, capacity)


def test_the_plan_does_not_grow_with_the_table():
    counts = {n: 10**9 // n for n in range(1, 4097)}
    plan = packing.plan_best_two_fit(counts)
    total = Counter()
    for filled, times in plan:
        assert sum(filled) <= 4096
        for n in filled:
            total[n] += times
    assert total == counts and len(plan) < 4096 * 9
    assert sum(times for _, times in plan) == -(-sum(n * c for n, c in counts.items()) // 4096)


def test_another_tokenizer_encodes_by_itself(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = str(tmp_path / "other.json")
    other = Tokenizer(models.WordLevel({"a": 5, "B": 6, "-": 7, "?": 0}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(path)
    got = packing.pack_documents(spark.createDataFrame([(1, "a B-b")], "doc_id long, text string"), path, with_ids=True).collect()
    assert np.frombuffer(got[0]["ids"], "<u4").tolist() == [5, 6, 7, 0, 1]


def test_top_k(spark, monkeypatch):
    r = np.random.default_rng(0)
    v = r.normal(size=(150, 6)).round(2)
    v[20:40] = v[20]  # ties
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [(150, None), (200, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (250, [float("nan")] * 6), (300, [float("inf")] + [0.0] * 5), (50, rows[50][1]), (350, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    good = [(i, np.floor(256 * np.array(x)).astype(int)) for i, x in rows if x is not None and all(y is not None and np.isfinite(y) for y in x)]
    want = Counter()
    for a, (i, q) in enumerate(good):
        if i % 50 == 0:
            s = sorted((-int(q @ x), j) for b, (j, x) in enumerate(good) if b != a and len(x) == len(q))
            want.update((i, k + 1, j, -n) for k, (n, j) in enumerate(s[:5]))
    for shard, least, boxes in ((1000, 1, None), (1000, 32, None), (9, 4, None), (30, 8, 0)):
        if boxes is not None:
            monkeypatch.setattr(topk, "BOX_BYTES", boxes)
        got = topk.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard, least_shards=least).collect()
        assert Counter(tuple(x) for x in got) == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_huge_components(spark):
    rows = [(k * 25, [1e300 * (-1) ** k, 3e16 * k, 5.0]) for k in range(9)] + [(7, []), (50, [])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, least_shards=4).collect()
    most = (1 << 63) - 1
    whole = lambda x: min(max(int(np.floor(256 * x)), -most - 1), most) if np.isfinite(256 * x) else (most if x > 0 else -most - 1)
    v = [(i, [whole(x) for x in xs]) for i, xs in rows]
    want = Counter()
    for a, (i, q) in enumerate(v):
        if i % 50 == 0:
            s = sorted((-min(max(sum(x * y for x, y in zip(q, w)), -most - 1), most), j) for b, (j, w) in enumerate(v) if b != a and len(w) == len(q))
            want.update((i, k + 1, j, -n) for k, (n, j) in enumerate(s[:5]))
    assert Counter(tuple(x) for x in got) == want


def test_mixing(docs, none):
    mix = mixing.Mix(docs, block=4)
    got = mix.taken().toPandas()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(got["size"]) == sorted(count(t) for _, t, *_ in some_docs())
    assert (got.taken <= 2 * got["size"]).all()
    for s, g in got.groupby(got.source.fillna("-")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 8
    assert mixing.Mix(docs, block=4).taken().toPandas().sort_values(["doc_id", "taken"]).taken.tolist() == got.sort_values(["doc_id", "taken"]).taken.tolist()
    slots = mix.slots().toPandas()
    assert len(slots) == mix.sources.agg(F.sum("n_slots")).first()[0]
    assert mixing.Mix(none).taken().count() == 0
    plain = docs.select("doc_id", "text", "lang", "source")
    mixed = mixing.mix_documents(plain).toPandas()
    assert list(mixed.columns) == plain.columns
    assert sum(map(count, mixed.text)) == mixing.Mix(docs).taken().agg(F.sum("taken")).first()[0]


def plain_targets(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    out, rest, free = {}, share * sum(sizes.values()), list(order)
    while free:
        one = rest / sum(weight[s] for s in free)
        above = [s for s in free if one * weight[s] > cap * sizes[s]]
        if not above:
            return out | {s: one * weight[s] for s in free}
        out |= {s: cap * sizes[s] for s in above}
        rest = share * sum(sizes.values()) - sum(out.values())
        free = [s for s in free if s not in out]
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1000, None: 10}, {"b": 1, "a": 1, None: 1}, {}, {"a": 0}, {f"s{k:03}": (k * 7919) % 997 for k in range(150)}])
def test_targets_stop_at_the_cap_and_reshare(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(3)
    got = mixing.with_targets(df).orderBy("sid").collect()
    assert [r["source"] for r in got] == sorted(sizes, key=lambda s: (s is None, s or "")) and [r["sid"] for r in got] == list(range(len(sizes)))
    assert {r["source"]: r["target"] for r in got} == pytest.approx(plain_targets(sizes))


def test_mixing_small_sources_meet_their_targets(spark):
    words = {"four": 4, "twenty": 20, "two hundred": 200, "big": 9_000, "none": 0}
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(words.items())]
    got = {r["source"]: r for r in mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).taken().collect()}
    for s, n in words.items():
        assert abs(got[s]["taken"] - got[s]["target"]) <= max(1, min(32, n // 64)) / 2, s
        assert got[s]["taken"] <= 2 * n
    assert got["four"]["taken"] == 8 and got["twenty"]["taken"] == 40


def test_mixing_joins_slots_and_blocks(spark):
    """taken, again: the blocks that the permutations pick, cut from each source's stream of documents."""
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.randint(0, 90)), r.choice("ab")) for i in range(200)]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    plan = {x["sid"]: x for x in mix.sources.collect()}
    stream = defaultdict(list)  # source: document of each word
    for x in sorted(mix.rows.collect(), key=lambda x: (x["sid"], x["first"])):
        assert len(stream[x["sid"]]) == x["first"] or not x["size"]
        stream[x["sid"]] += [x["doc_id"]] * x["size"]
    want = Counter()
    for s, p in plan.items():
        b, n = p["block_words"], p["n_blocks"]
        for j in range(p["n_slots"]):
            turn = j // n
            among = p["source_size"] // b if turn == p["n_slots"] // n else n  # the last turn takes full blocks
            at = int(mixing.permuted(np.array([j % n]), among, mix.seed + 1 + s * 1_000_003 + turn * 7_919)[0])
            want.update(stream[s][at * b:(at + 1) * b])
    assert {x["doc_id"]: x["taken"] for x in mix.taken().collect()} == {i: want[i] for i, *_ in rows}


def test_permutations():
    for n in (1, 2, 3, 17, 1000):
        p = mixing.permuted(np.arange(n), n, 5)
        assert sorted(p.tolist()) == list(range(n))
    assert (mixing.permuted(np.arange(1000), 1000, 5) != mixing.permuted(np.arange(1000), 1000, 6)).any()


def test_licenses(docs, none, spark):
    got = licenses.scan_licenses(docs).toPandas()
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = Counter()
    for i, t, *_ in some_docs():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = sorted((k, label) for p, label in phrases.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split())
        want[(i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))] += 1
    n = lambda x: None if x is None or np.isnan(x) else int(x)
    assert Counter((n(i), a, b, n(f), n(z), s) for i, a, b, f, z, s in zip(got.doc_id, got.n_words, got.n_base, got.first_word, got.last_word, got.base_labels)) == want
    assert licenses.scan_licenses(none).count() == 0
    scan = licenses.Scanner().scan
    assert scan("SPDX-License-Identifier: BSD-3-Clause")["labels"] == "bsd-3-clause"
    assert scan("Licensed under the Apache License, Version 2.0 (the ...)")["labels"] == "apache,apache-2.0"
    assert scan("GNU General Public License v3")["labels"] == "gpl,gpl-3.0"
    assert scan("a quiet river")["labels"] == "" and len(licenses.rules()) > 200
    spans = scan("see the MIT License. and all rights reserved")["spans"]
    assert all(a["end"] <= b["start"] or b["end"] <= a["start"] for k, a in enumerate(spans) for b in spans[:k])


def test_language_id(spark):
    r = random.Random(1)
    voc = {"xx": "ba bo bi lomba rambo tomba".split(), "yy": "shra kve tzin orkh ghal vekt".split()}
    rows = [(i, " ".join(r.choices(voc[k], k=40)), k) for i, k in enumerate(["xx", "yy"] * 60)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    content = lang_id.dictionaries(train)
    asked = spark.createDataFrame([(1, "lomba rambo bo tomba ba"), (2, "KVE orkh, ghal! vekt tzin"), (3, None), (4, "12 34 --"), (5, ""), (5, "")], "doc_id long, text string").withColumn("score", F.lit("x"))
    got = lang_id.identify(asked, content).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["xx", "yy", "und", "und", "und", "und"] and all(0 <= r["score"] <= 1 for r in got)
    assert lang_id.identify(asked.limit(0), content).count() == 0
    assert lang_id.dictionaries(train.limit(0)) == {} and lang_id.identify(asked, {}).where("lang_pred <> 'und'").count() == 0


def test_field_marginals_are_exact():
    import itertools

    r = np.random.default_rng(0)
    u, tr, st = r.normal(size=23), r.normal(size=(2, 2)), r.normal(size=2)
    first = np.zeros(23, bool)
    first[[0, 5, 6, 14]] = True
    p = toxicity.marginals(u, first, tr, st, 4)[0]
    for a, b in ((0, 5), (5, 6), (6, 14), (14, 23)):
        z, one = 0, np.zeros(b - a)
        for s in itertools.product((0, 1), repeat=b - a):
            e = np.exp(st[s[0]] + sum(x * y for x, y in zip(u[a:b], s)) + sum(tr[x, y] for x, y in zip(s, s[1:])))
            z, one = z + e, one + e * np.array(s)
        assert np.allclose(one / z, p[a:b])


def test_toxicity(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        w = r.choices([f"word{k}" for k in range(80)], k=r.randint(5, 60))
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["vilest!", "rotten", "scoundrel"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (0, rows[0][1])], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(5000, 1), (1000, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, lab)).collect()
    out = [x for x in got if x["doc_id"] < 400 and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0]
    right = sum((x["score"] >= 0.5) == (x["doc_id"] % 4 == 0) for x in out)
    assert right >= 0.95 * len(out) and len(got) == 403
    text = dict(rows)
    for x in got:
        if x["doc_id"] in text:
            assert all(re.search("vilest|rotten|scoundrel", text[x["doc_id"]][s["start"]:s["end"]]) for s in x["spans"])
    left = {x["doc_id"] for x in toxicity.drop_toxic(docs, lab).collect()}
    assert {1000, 1001} <= left and sum(i % 4 == 0 for i in left if i < 400) <= 5 and sum(i % 4 != 0 for i in left if i < 400) >= 285
    assert toxicity.score(docs.limit(0), toxicity.Model()).count() == 0
    untrained = toxicity.train(docs, lab.limit(0))
    assert toxicity.score(docs, untrained).where("score >= 0.5").count() == 0


@pytest.fixture(scope="module")
def trees():
    return html_text.train(250)


def test_html(spark, trees):
    page = ("<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class=ad>Buy now.</div>"
            "<article><h1>A  title &amp; more</h1><p><b>First\n line, of text.<br><p>Second line &eacute;, here.</p><p>Tiny.</article>"
            "<div class=\"comments\"><div class=comment><b>Bob</b><p>Nice words, really.</p></div></div><aside><h3>Related</h3><ul><li><a href=/x>One link</a></li></ul></aside><footer>&copy; us</footer>")
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (4, "u", "<div><p>unclosed <b>x</i></div></span>"), (5, "u", "<" * 50 + "p>" * 50)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")), trees).collect()
    want = "A title & more\nFirst line, of text.\nSecond line é, here.\nTiny."
    assert sorted(r["page_id"] for r in got) == [1, 1, 2, 3, 4, 5]
    assert all(r["text"] == want and r["n_chars"] == len(want) for r in got if r["page_id"] == 1)
    assert all(r["text"] == "" for r in got if r["page_id"] in (2, 3))


def test_html_on_unseen_pages(trees):
    flags, exact = html_text.Flags(), 0
    for page in html_pages.pages(60, seed=77):
        want = []

        def walk(node):
            for p in node.parts:
                if isinstance(p, str):
                    want.extend([p] * node.marked)
                else:
                    walk(p)

        walk(html_text.parse(page))
        exact += html_text.main_texts([page.replace("\x01", "")], trees, flags)[0].split("\n") == (want or [""])
    assert exact >= 51


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    rows = [(i, " ".join(r.choices([f"t{k}" for k in range(300)], k=80)), "en", f"s{i % 3}", 10) for i in range(80)]
    rows += [(200 + k, rows[k][1], "en", "s0", 10) for k in range(10)] + [(300, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(40)], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "packing"]
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, f"file://{tmp_path}")
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "exact_dedup":
            assert {x["doc_id"] for x in docs.collect()} <= set(range(80)) | {300}
        docs.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
