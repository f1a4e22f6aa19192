"""SimHash near-dedup with multi-index hashing.

A document's fingerprint is the bitwise majority of the hashes of its word shingles. Equal fingerprints are
one class (an aggregation with map-side combine, so a group of copies is one row). Classes at Hamming
distance up to 3 are found with multi-index hashing (Norouzi et al., 2012): the 64 bits are two segments of
32, and of two fingerprints within 3 bits at least one segment differs in at most one bit. Every class is
entered in a table under both segments and probes the Hamming ball of radius 1 around each; a pair at
segment distance 1 is probed from the side whose bit is set, which halves the ball. Probes and entries meet
by (segment, value); full distances verify them.

A bucket never emits its pairs: it links its verified members into a spanning forest, so a bucket of n
classes gives fewer than n links per bucket. Connected components join the forests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, give_back, join_by_class, small, table, through_python, unused

SEED = 42
SEGMENTS = ((32, 32), (0, 32))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)  # bits of a byte, high first


def majority(hashes: np.ndarray) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half of hashes (uint64, one at least)."""
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def shingle_hashes(text: str | None, words_in_shingle: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of a whole text, repeats included: A-Z lower-cased, words split at space
    and U+0009 to U+000D, joined by a space (fewer words: the whole sequence). No word: empty."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[min(words_in_shingle, len(words)) - 1:].tolist()
    hash_of = xxhash.xxh64_intdigest
    return np.fromiter((hash_of(line[a:b], SEED) for a, b in zip(starts, last)), np.uint64, len(last))


def fingerprint(text: str | None, words_in_shingle: int = 3) -> int:
    """The bitwise majority of a text's shingle hashes; no word: zero."""
    hashes = shingle_hashes(text, words_in_shingle)
    return majority(hashes) if len(hashes) else 0


def _remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of another family for each k; k = 0: as they are."""
    if not k:
        return hashes
    x = hashes ^ np.uint64((0x9E3779B97F4A7C15 * k) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, words_in_shingle: int = 3, prints: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, fp long, more array<long>) per row of docs; more: of prints - 1 further hash families.
    Null or empty text: zeros."""

    def work():
        def each(part: pa.RecordBatch) -> dict:
            rows = []
            for x in part.column(1).to_pylist():
                h = shingle_hashes(x, words_in_shingle)
                rows.append([majority(_remixed(h, k)) if len(h) else 0 for k in range(prints)])
            fps = np.array(rows, np.uint64).reshape(-1, prints).view(np.int64)
            return {"doc_id": part.column(0), "fp": fps[:, 0], "more": fps[:, 1:].tolist()}

        return each

    kind = docs.schema[doc_id].dataType.simpleString()
    return through_python(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), work, f"doc_id {kind}, fp long, more array<bigint>")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(fps: np.ndarray, probing: np.ndarray, radius: int, block: int = 512) -> list[tuple[int, int]]:
    """Links that span the components of a bucket under Hamming distance <= radius. fps: uint64, distinct
    within entries (probing 0) and within probes (1); two probes are not compared with each other, since
    the pair meets in another bucket if it is one. Memory is block x n; every pair is compared."""
    entries = np.flatnonzero(~probing)
    label, links = np.arange(len(fps)), []
    for at in range(0, len(entries), block):
        rows = entries[at:at + block]
        near = _popcount(fps[rows][:, None] ^ fps[None, :]) <= radius
        for k, i in enumerate(rows):
            j = np.flatnonzero(near[k])
            own, first = np.unique(label[j], return_index=True)
            for other, x in zip(own, j[first]):
                if other != label[i]:
                    links.append((int(i), int(x)))
                    label[label == other] = label[i]
    return links


#: Entries of a bucket beyond which it is split by the other segment, and rows of one that a task holds at once.
HEAVY, HELD = 4_096, 1 << 18


def links(classes: DataFrame, radius: int = 3, heavy: int = HEAVY) -> DataFrame:
    """classes: distinct fingerprints, columns fp (long), family (int) and node (long). Links (a, b) of nodes
    that connect the same components as all pairs of fingerprints of one family at Hamming distance <= radius;
    radius 3 at most (two segments, balls of 1).

    A bucket with more than `heavy` entries is split: its members meet again by the other segment, which is cut
    in two halves of 16 bits in the same way. A half leaves 65,536 values to the rest, so what one task compares
    is bounded whatever the table."""
    if radius > 3:
        raise ValueError("two segments with balls of radius 1 cover a radius of 3 at most")
    value = [_segment("fp", shift, width) for shift, width in SEGMENTS]

    def key(k: int, x):
        return (F.col("family") * 2 + k) * (1 << 32) + x

    def under(k: int):
        return F.transform(_meetings(value[k], SEGMENTS[k][1]), lambda x: F.struct(key(k, x["key"]).alias("key"), x["probe"].alias("probe"), F.lit(k).alias("seg")))

    met = classes.select("fp", "node", F.inline(F.concat(under(0), under(1))))
    entries = classes.select(F.explode(F.array(*[key(k, v) for k, v in enumerate(value)])).alias("key"))
    large = small(entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("key"))
    if large.limit(1).count():
        other = [_segment("fp", *SEGMENTS[1 - k]) for k in (0, 1)]
        rest = F.when(F.col("seg") == 0, other[0]).otherwise(other[1])

        def half(h: int):
            return F.transform(_meetings(_segment(rest, 16 * h, 16), 16), lambda x: F.struct(F.xxhash64("key", F.lit(h), x["key"]).alias("key"), x["probe"].alias("probe")))

        split = met.join(large, "key", "left_semi").select("fp", "node", F.inline(F.concat(half(0), half(1))))
        met = met.join(large, "key", "left_anti").select("fp", "node", "key", "probe").unionByName(split)
    dealt = met.select("fp", "node", "key", "probe").repartition("key").sortWithinPartitions("key", "probe")

    def link(batches):
        held: list[tuple] = []  # keys, fingerprints, probe or entry: of the buckets not yet solved

        def solve(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, node: np.ndarray):
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            size = np.diff(cuts)
            pairs: list[tuple[int, int]] = []
            first = cuts[:-1]
            two = first[(size == 2) & ~probe[first]]  # the usual bucket, all at once
            near = two[_popcount(fp[two] ^ fp[two + 1]) <= radius]
            a, b = node[near], node[near + 1]
            for at, n in zip(first[size > 2], size[size > 2]):
                if not probe[at]:
                    pairs += [(at + i, at + j) for i, j in forest(fp[at:at + n], probe[at:at + n], radius)]
            more = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, node[more[:, 0]]])),
                                               pa.array(np.concatenate([b, node[more[:, 1]]]))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fp, key, probe, node = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("fp", "key", "probe", "node"))
            held.append((key, fp.astype(np.int64).view(np.uint64), probe.astype(bool), node))
            one = key[-1] == held[0][0][0]  # one bucket goes on
            if one and sum(len(x[0]) for x in held) < HELD:
                continue
            key, fp, probe, node = (np.concatenate(x) for x in zip(*held))
            # the last bucket may go on in the next batch; entries come first, and probes need not wait for each other
            done = len(key) if one else int(np.searchsorted(key, key[-1], "left"))
            yield solve(key[:done], fp[:done], probe[:done], node[:done])
            stay = ~probe if one else np.arange(len(key)) >= done
            held = [(key[stay], fp[stay], probe[stay], node[stay])] if stay.any() else []
        if held:
            yield solve(*(np.concatenate(x) for x in zip(*held)))
        give_back()

    return dealt.mapInArrow(link, "a long, b long")


#: Classes of one fingerprint are linked in this many parts, and the parts with each other: no hub has all links.
PARTS = 1024


def class_links(classes: DataFrame, radius: int = 3) -> DataFrame:
    """classes: columns cls (long, distinct) and fp (long). Links (a, b), a < b, of classes that connect the same
    components as all pairs with fingerprints at Hamming distance <= radius."""
    dealt = classes.select("cls", "fp", F.pmod(F.xxhash64("cls"), F.lit(PARTS)).alias("part"))
    heads = cut(dealt.groupBy("fp", "part").agg(F.min("cls").alias("head")))
    first = cut(heads.groupBy("fp").agg(F.min("head").alias("node")))
    own = dealt.join(heads, ["fp", "part"]).select(F.col("head").alias("a"), F.col("cls").alias("b"))
    same = heads.join(first, "fp").select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = links(first.select("fp", F.lit(0).cast("long").alias("family"), "node"), radius)
    return own.union(same).union(near).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _segment(fp, shift: int, width: int):
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _meetings(value, width: int):
    """An array of (key, probe): the value itself as an entry, and as probes the values with one set bit cleared."""
    ball = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: value.bitwiseAND(_bit(j)) != 0)
    probes = F.transform(ball, lambda j: F.struct(value.bitwiseXOR(_bit(j)).alias("key"), F.lit(True).alias("probe")))
    return F.concat(F.array(F.struct(value.alias("key"), F.lit(False).alias("probe"))), probes)


def _bit(j):
    return F.expr("1L") * F.pow(F.lit(2.0), j).cast("long")


def near_groups(docs: DataFrame, words_in_shingle: int = 3, radius: int = 3, prints: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, fp, component_id) per row of docs; component_id is the smallest doc_id that links
    of fingerprints at distance <= radius reach (nulls last: null only if no row reached has a doc_id). With
    more than one print, documents link if the fingerprints of any hash family do.

    Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows share a
    component. An empty table gives an empty result. Extra columns are not read.
    """
    each = cut(fingerprints(docs, words_in_shingle, prints, doc_id, text))
    classes = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    table_ = classes.select("fp", F.lit(0).cast("long").alias("family"), F.col("fp").alias("node"))
    same = None
    if prints > 1:
        further = each.select(F.col("fp").alias("node"), F.posexplode("more").alias("pos", "fp")).select("node", (F.col("pos") + 1).cast("long").alias("family"), "fp").distinct()
        first = further.groupBy("family", "fp").agg(F.min("node").alias("rep"))
        same = further.join(first, ["family", "fp"]).where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
        table_ = table_.unionByName(first.select("fp", "family", F.col("rep").alias("node")))
    found = links(table_, radius)
    roots = components(found if same is None else found.union(same))
    linked = roots.join(classes.withColumnRenamed("fp", "node"), "node")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = cut(classes.join(linked.select(F.col("node").alias("fp"), "root"), "fp", "left").join(least, "root", "left")
                   .select("fp", "n", F.coalesce("component_id", "least").alias("component_id")))
    n_rows = of_class.agg(F.sum("n")).first()[0] or 0
    return join_by_class(each, of_class, "fp", "n", n_rows).select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, words_in_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near copies, the one with the smallest doc_id. Near copies have
    a Jaccard similarity of word shingles of at least similarity, or are joined by a chain of such pairs. Fingerprints
    within 3 bits (class_links, verified) give the groups; they miss most pairs near 0.8, and what is still apart
    then is searched by near_copies. Rows go one by one, by doc_id and text: another text under the doc_id of a copy stays. Rows that share the smallest doc_id all stay (exact
    deduplication comes before), and so do rows without a doc_id. An empty table stays empty."""
    from .near_copies import similar_groups, text_key

    theirs, key, own = unused(docs, "id", "text_key", "own_key")
    groups = similar_groups(docs, words_in_shingle, similarity)
    gone = small(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(theirs), F.col("text_key").alias(key)).distinct())
    kept = docs.withColumn(own, text_key()).join(gone, (F.col("doc_id") == F.col(theirs)) & (F.col(own) == F.col(key)), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
