"""Near copies by SimHash, completed by MinHash bands, verified by the Jaccard similarity of word shingles.

Rows with the same set of shingles are one class. SimHash comes first: links of classes whose fingerprints differ
in at most 3 bits (simhash.class_links), each verified on the whole sets, make the components to begin with. A
fingerprint misses most pairs near 0.8, so bands search for the rest: classes that share one of 24 bands of 5 minima
meet, a pair of similarity s with chance 1 - (1 - s^5)^24, 0.9999 at 0.8. They work only where SimHash has left the
members of a bucket apart. There each class is first compared with leaders of its buckets. Buckets whose
members are then in more than one component are cut in blocks, and a task compares the members of two blocks with
each other and gives only links that join components, fewer than it has members. So the components are those of all
pairs that met, by either way, and no pair of a bucket is ever a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, join_by_class, small, through_python
from .simhash import SEED, class_links, majority, shingle_hashes

BANDS, ROWS, LEADERS = 24, 5, 4
#: Members and shingles of a block of a bucket, about: a task holds two blocks.
BLOCK_MEMBERS, BLOCK_SHINGLES = 128, 200_000
_RNG = np.random.default_rng(SEED)
_ADD, _TIMES = (_RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)


def minima(hashes: np.ndarray, block: int = 4096) -> np.ndarray:
    """The least value of hashes (uint64, one at least) under each of BANDS * ROWS functions."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), block):
        x = (hashes[at:at + block, None] ^ _ADD) * _TIMES
        out = np.minimum(out, ((x ^ (x >> np.uint64(32))) * _TIMES).min(axis=0))
    return out


def sketches(docs: DataFrame, words_in_shingle: int) -> DataFrame:
    """One row (doc_id, text_key, cls, n, fp, bands) per row of docs: a hash of the text, one of the set of shingles, its
    size, its fingerprint, and band keys."""

    def work():
        def each(part: pa.RecordBatch) -> dict:
            cls, sizes, fps, bands = [], [], [], []
            for x in part.column(1).to_pylist():
                h = np.unique(shingle_hashes(x, words_in_shingle))
                low = minima(h).reshape(BANDS, ROWS) if len(h) else np.zeros((BANDS, ROWS), np.uint64)
                cls.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                sizes.append(len(h))
                fps.append(majority(h) if len(h) else 0)
                bands.append(np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(low)], np.uint64).view(np.int64))
            return {"doc_id": part.column(0), "text_key": part.column(2), "cls": np.array(cls, np.uint64).view(np.int64), "n": sizes,
                    "fp": np.array(fps, np.uint64).view(np.int64), "bands": bands}

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return through_python(docs.select("doc_id", "text", text_key().alias("text_key")), work, f"doc_id {kind}, text_key long, cls long, n long, fp long, bands array<bigint>")


def text_key():
    """Tells rows of one doc_id with different texts apart; null counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sets_of(docs: DataFrame, needed: DataFrame, words_in_shingle: int) -> DataFrame:
    """One row (cls, hs) per needed class (cls, least): its distinct shingle hashes, read again from its texts."""

    def work():
        def each(part: pa.RecordBatch) -> dict:
            sets = [np.unique(shingle_hashes(x, words_in_shingle)) for x in part.column(0).to_pylist()]
            return {"cls": np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64), "hs": [h.view(np.int64) for h in sets]}

        return each

    named = small(needed.where("least IS NOT NULL").select(F.col("least").alias("doc_id")).distinct())
    texts = docs.join(named, "doc_id", "left_semi").select("text").union(docs.where("doc_id IS NULL").select("text"))
    return through_python(texts, work, "cls long, hs array<bigint>").join(small(needed.select("cls")), "cls", "left_semi").groupBy("cls").agg(F.first("hs").alias("hs"))


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose sets have a Jaccard similarity of at least that."""
    both = (pairs.join(sets.select(F.col("cls").alias("a"), F.col("hs").alias("x")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("hs").alias("y")), "b"))
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)).select("a", "b")


def similar(flat: np.ndarray, sizes: np.ndarray, similarity: float, columns: int = 8192) -> np.ndarray:
    """For sets laid end to end: whether each two have a Jaccard similarity of at least that. Sizes of intersections
    are products of the matrix of members and shared elements, taken some columns at a time."""
    n = len(sizes)
    kinds, of, held = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(held > 1) - 1  # what one member alone has is in no intersection
    keep = held[of] > 1
    member, at = np.repeat(np.arange(n), sizes)[keep], column[of[keep]]
    order = np.argsort(at, kind="stable")
    member, at = member[order], at[order]
    common = np.zeros((n, n), np.float32)
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        a, b = np.searchsorted(at, (first, first + columns))
        m = np.zeros((n, columns), np.float32)
        m[member[a:b], at[a:b] - first] = 1
        common += m @ m.T
    common = common.astype(float)
    return common >= similarity * (sizes[:, None] + sizes[None, :] - common)


def joining(key, rows: pa.Table, similarity: float) -> pa.Table:
    """Links between the members (cls, block, root, hs) of two blocks that join their components."""
    cls, block, root = (rows.column(c).to_numpy() for c in ("cls", "block", "root"))
    sets = rows.column("hs").combine_chunks()
    near = similar(sets.flatten().to_numpy(), sets.value_lengths().to_numpy(), similarity)
    if key[1].as_py() != key[2].as_py():
        near &= block[:, None] != block[None, :]  # each block meets itself once
    label, out = np.unique(root, return_inverse=True)[1].ravel(), []
    for i in range(len(cls)):
        j = np.flatnonzero(near[i])
        for other, x in zip(*np.unique(label[j], return_index=True)):
            if other != label[i]:
                out.append((cls[i], cls[j[x]]))
                label[label == other] = label[i]
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def met_in_bands(classes: DataFrame) -> DataFrame:
    """One row (key, cls, n, lead) per class and band that other classes share; lead: of the bucket's leaders."""
    entries = classes.select("cls", "n", F.explode("bands").alias("key"))
    lead = F.min(F.struct(F.xxhash64("cls", F.pmod("key", F.lit(LEADERS))).alias("h"), "cls", "n")).alias("lead")
    return entries.join(entries.groupBy("key").agg(F.count("*").alias("size"), lead).where("size > 1").drop("size"), "key")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one component (node, root) yet."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def links_of(roots: DataFrame) -> DataFrame:
    """Components (node, root) as links (a, b): what was linked before goes on as stars, not as all its links."""
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def similar_groups(docs: DataFrame, words_in_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row (doc_id, text_key, component_id) per row of docs; component_id is the smallest doc_id that pairs of at
    least that similarity reach. Texts without a word are alike, null ones among them. Repeated rows share a
    component; a component is null only if none of its rows has a doc_id; an empty table gives an empty result.
    Other columns of docs are not read."""
    each = cut(sketches(docs, words_in_shingle))
    classes = cut(each.groupBy("cls").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.count("*").alias("copies")))
    close = cut(class_links(classes.select("cls", "fp")))
    met = cut(met_in_bands(classes))
    wanted = met.select("cls").union(close.select("a")).union(close.select("b")).distinct()
    sets = cut(sets_of(docs, classes.join(wanted, "cls", "left_semi").select("cls", "least"), words_in_shingle))
    roots = cut(components(alike(close, sets, similarity)))
    near_size = F.least("n", "lead.n") >= F.lit(similarity) * F.greatest("n", "lead.n")
    stars = (met.where((F.col("cls") != F.col("lead.cls")) & near_size)
             .select(F.least("cls", "lead.cls").alias("a"), F.greatest("cls", "lead.cls").alias("b")).distinct())
    roots = cut(components(links_of(roots).union(alike(apart(stars, roots), sets, similarity))))
    known = met.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", "n", F.coalesce("root", "cls").alias("root"))
    blocks = F.ceil(F.greatest(F.count("*") / float(BLOCK_MEMBERS), F.sum("n") / float(BLOCK_SHINGLES))).cast("int")
    mixed = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), blocks.alias("blocks")).where("lo < hi").select("key", "blocks")
    open_ = cut(known.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "cls"), F.col("blocks")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x")
    dealt = (open_.select("key", "cls", "block", "root", other).join(sets, "cls")
             .select("key", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "cls", "block", "root", "hs"))
    more = dealt.groupBy("key", "i", "j").applyInArrow(lambda key, rows: joining(key, rows, similarity), "a long, b long")
    roots = components(links_of(roots).union(more))
    of = classes.select("cls", "least", "copies").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(of.join(least, "root").select("cls", "copies", "component_id"))
    n_rows = named.agg(F.sum("copies")).first()[0] or 0
    return join_by_class(each.select("doc_id", "text_key", "cls"), named, "cls", "copies", n_rows).select("doc_id", "text_key", "component_id")
