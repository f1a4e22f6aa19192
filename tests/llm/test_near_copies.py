"""The near-copy stage against brute force over all pairs, at similarities around 0.8."""

import random

from mnemospark.llm import simhash

SHINGLE = lambda t: {tuple(t.lower().split()[i:i + 5]) for i in range(len(t.split()) - 4)}


def planted(seed=3, n_groups=60):
    rnd, out = random.Random(seed), []
    word = lambda: f"w{rnd.randrange(50_000)}"
    for g in range(n_groups):
        base = [word() for _ in range(200)]
        out.append(base)
        for _ in range(2):
            copy = list(base)
            for at in rnd.sample(range(200), rnd.randrange(1, 9)):  # Jaccard of about 0.65 to 0.95
                copy[at] = word()
            out.append(copy)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_pairs_from_four_fifths_on_are_found_and_others_left(spark):
    docs = planted()
    sets = [SHINGLE(t) for _, t in docs]
    up, near = list(range(len(docs))), []
    for i in range(len(docs)):
        for j in range(i):
            s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if s >= 0.8:
                near.append(s)
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    assert sum(s < 0.85 for s in near) > 5 and sum(s > 0.9 for s in near) > 5
    left = [r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(left) == sorted(set(up)) and len(left) < len(docs)


def test_rows_go_by_text_and_not_by_doc_id(spark):
    base = planted(9, 1)[0][1]
    rows = [(1, base, 0), (5, base + " end", 1), (5, "another text altogether that nothing else in this table is like", 2), (None, base, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __text_key int")
    left = simhash.drop_near_copies(df)
    assert left.columns == df.columns and sorted(r["__text_key"] for r in left.collect()) == [0, 2, 3]
    assert simhash.drop_near_copies(df.limit(0)).count() == 0
