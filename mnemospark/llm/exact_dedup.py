"""Exact deduplication with counting quotient filters.

Each task builds one counting quotient filter per block of fingerprints (64-bit xxhash64 of the normalised
text, split in quotient and remainder). A filter keeps quotients as run lengths, the remainders of a run in
ascending order and a counter for each remainder that occurs more than once, so a fingerprint held by a
third of all rows takes one slot. Filters of one block merge without loss by merging sorted remainders;
fingerprints with a count above one are candidates. Only the texts of candidates are moved: they are
grouped by their bytes, which verifies them, after a partial aggregation that leaves one row per text and
task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, join_by_class, small, table, unused

#: Bits of the remainder within a block.
REMAINDER_BITS = 40


class CountingQuotientFilter:
    """Fingerprints of one block with their counts. The fingerprint without the block's bits splits in a
    quotient (which run) and a remainder (sorted within the run)."""

    def __init__(self, quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.remainders, self.counts = quotients, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> "CountingQuotientFilter":
        """fingerprints: uint64, in any order, repeats included."""
        if counts is None:
            fps, n = np.unique(fingerprints, return_counts=True)
        else:
            fps, at = np.unique(fingerprints, return_inverse=True)
            n = np.bincount(at, weights=counts, minlength=len(fps))
        return cls(fps >> np.uint64(REMAINDER_BITS), fps & np.uint64((1 << REMAINDER_BITS) - 1), n.astype(np.int64))

    def dump(self) -> bytes:
        """Runs (quotient and length), 5-byte remainders in run order, then the counters above one."""
        starts = np.flatnonzero(np.r_[True, self.quotients[1:] != self.quotients[:-1]]) if len(self.quotients) else np.zeros(0, int)
        lengths = np.diff(np.r_[starts, len(self.quotients)])
        many = np.flatnonzero(self.counts > 1)
        head = np.array([len(starts), len(self.remainders), len(many)], "<u4").tobytes()
        low = np.ascontiguousarray(self.remainders.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
        return b"".join((head, self.quotients[starts].astype("<u4").tobytes(), lengths.astype("<u4").tobytes(),
                         low.tobytes(), many.astype("<u4").tobytes(), self.counts[many].astype("<u8").tobytes()))

    @classmethod
    def load(cls, data: bytes) -> "CountingQuotientFilter":
        runs, n, many = np.frombuffer(data, "<u4", 3)
        at = 12
        quotients = np.frombuffer(data, "<u4", runs, at)
        lengths = np.frombuffer(data, "<u4", runs, at := at + 4 * int(runs))
        low = np.frombuffer(data, np.uint8, 5 * int(n), at := at + 4 * int(runs)).reshape(-1, 5)
        where = np.frombuffer(data, "<u4", many, at := at + 5 * int(n))
        counters = np.frombuffer(data, "<u8", many, at + 4 * int(many))
        wide = np.zeros((int(n), 8), np.uint8)
        wide[:, :5] = low
        counts = np.ones(int(n), np.int64)
        counts[where] = counters
        return cls(np.repeat(quotients, lengths).astype(np.uint64), wide.view("<u8").ravel().astype(np.uint64), counts)

    def fingerprints(self) -> np.ndarray:
        return (self.quotients << np.uint64(REMAINDER_BITS)) | self.remainders

    def merge(self, other: "CountingQuotientFilter") -> "CountingQuotientFilter":
        """A filter of both multisets: a merge of two sorted sequences of remainders. Equal remainders of a run
        add their counters; nothing is lost."""
        a, b = self.fingerprints(), other.fingerprints()
        at = np.searchsorted(a, b)
        same = np.zeros(len(b), bool)
        inside = at < len(a)
        same[inside] = a[at[inside]] == b[inside]
        counts = self.counts.copy()
        counts[at[same]] += other.counts[same]  # fingerprints of a filter are distinct
        merged, counts = np.insert(a, at[~same], b[~same]), np.insert(counts, at[~same], other.counts[~same])
        return CountingQuotientFilter(merged >> np.uint64(REMAINDER_BITS), merged & np.uint64((1 << REMAINDER_BITS) - 1), counts)


def merged(filters) -> CountingQuotientFilter:
    """All filters in one, merged in pairs of like weight: each fingerprint is copied as often as there are levels, not
    as often as there are filters."""
    stack: list[tuple[int, CountingQuotientFilter]] = []
    for one in filters:
        level = 0
        while stack and stack[-1][0] == level:
            one, level = stack.pop()[1].merge(one), level + 1
        stack.append((level, one))
    whole = stack.pop()[1]
    while stack:
        whole = stack.pop()[1].merge(whole)
    return whole


def _blocks(n_rows: int, per_block: int) -> int:
    """Leading bits that name a block: about per_block fingerprints in each, 16 blocks at least."""
    return max(4, int(max(1, n_rows // per_block)).bit_length())


def repeated_fingerprints(fps: DataFrame, n_rows: int, per_block: int = 500_000) -> DataFrame:
    """fps: a column fp (long) with one row per document. Rows (fp, copies) with copies above one."""
    bits = _blocks(n_rows, per_block)

    def build(batches):
        pieces, held = [], 0
        filters = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def fold(filters, pieces):
            new, n = np.unique(np.concatenate(pieces), return_counts=True)
            fps, at = np.unique(np.concatenate([filters[0], new]), return_inverse=True)
            return fps, np.bincount(at, weights=np.concatenate([filters[1], n]), minlength=len(fps)).astype(np.int64)

        for batch in batches:
            pieces.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            held += len(pieces[-1])
            if held >= 1 << 20:
                filters, pieces, held = fold(filters, pieces), [], 0
        if pieces:
            filters = fold(filters, pieces)
        values, counts = filters
        block = (values >> np.uint64(64 - bits)).astype(np.int64)
        rest = values & np.uint64((1 << (64 - bits)) - 1)
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else np.zeros(1, int)
        out = [(int(block[a]), CountingQuotientFilter.of(rest[a:b], counts[a:b]).dump()) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())],
                                         names=["block", "filter"])

    def merge(key, rows):
        whole = merged(CountingQuotientFilter.load(data.as_py()) for data in rows.column("filter"))
        hot = whole.counts > 1
        fp = whole.fingerprints()[hot] | (np.uint64(key[0].as_py()) << np.uint64(64 - bits))
        return pa.table({"fp": pa.array(fp.view(np.int64)), "copies": pa.array(whole.counts[hot])})

    filters = fps.select("fp").mapInArrow(build, "block long, filter binary")
    return filters.groupBy("block").applyInArrow(merge, "fp long, copies long")


def normalised(text: str = "text"):
    """Null counts as empty; each run of space and U+0009 to U+000D becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 and twins (rows of the group
    that have keep_id as their doc_id; above one only if rows repeat whole).

    Null text: empty; all empty texts are one group. Null doc_id: sorts last, so it stays only in a group
    without any other. Of rows that repeat both text and doc_id one is kept. An empty table gives an empty
    result. Extra columns are not read.
    """
    norm = normalised(text)
    narrow = cut(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(norm).alias("fp"), F.sha2(norm, 256).alias("text_sha256"))
                 .withColumn("row", F.monotonically_increasing_id()))
    n_rows = narrow.count()
    repeated = small(repeated_fingerprints(narrow, n_rows).select("fp"))  # texts of other documents are then not moved
    # bytes are compared here: the texts themselves are the grouping key
    texts = docs.select(norm.alias("norm")).withColumn("fp", F.xxhash64("norm")).join(repeated, "fp", "left_semi")
    verified = (texts.groupBy("fp", "norm").agg(F.count("*").alias("n")).where("n > 1")
                .select("fp", F.sha2("norm", 256).alias("text_sha256"), F.col("n").alias("group_size")))
    by_id = narrow.join(repeated, "fp", "left_semi").groupBy("fp", "text_sha256", "doc_id").agg(F.min("row").alias("row"), F.count("*").alias("twins"))
    keepers = (by_id.groupBy("fp", "text_sha256")
               .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "twins")).alias("k"))
               .select("fp", "text_sha256", F.col("k.doc_id").alias("keep_id"), F.col("k.row").alias("keep_row"), F.col("k.twins").alias("twins")))
    classes = verified.join(keepers, ["fp", "text_sha256"]).drop("fp")
    alone = F.col("group_size").isNull()
    return join_by_class(narrow, cut(classes), "text_sha256", "group_size", n_rows).select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256",
        F.coalesce("twins", F.lit(1)).cast("long").alias("twins"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_groups drops; columns unchanged, whatever their names. Null texts are empty
    texts, of which one row stays; a row without doc_id stays if its group has no other; of rows that repeat
    doc_id and text one stays; an empty table stays empty."""
    theirs, sha, own = unused(docs, "id", "sha", "own_sha")
    groups = cut(exact_groups(docs).where("group_size > 1").select(F.col("doc_id").alias(theirs), "keep_id", "kept", F.col("text_sha256").alias(sha), "twins"))
    gone = small(groups.where(~F.col("kept") & ~F.col(theirs).eqNullSafe(F.col("keep_id"))).select(theirs, sha).distinct())
    again = small(groups.where("kept AND twins > 1").select(theirs, sha))
    keyed = docs.withColumn(own, F.sha2(normalised(), 256))
    same = F.col("doc_id").eqNullSafe(F.col(theirs)) & (F.col(own) == F.col(sha))
    left = keyed.join(gone, same, "left_anti")
    once = left.join(again, same, "left_anti")
    twins = left.join(again, same, "left_semi").dropDuplicates(["doc_id", own])
    return once.unionByName(twins).drop(own)


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
