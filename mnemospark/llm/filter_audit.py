"""Filter interaction audit: what each of five filters removes, in every order, by parts of the corpus.

Exact copies are found by a fingerprint-routed RDD: texts are partitioned by xxhash, and a partition stores collision
chains, for each fingerprint its distinct full texts with the smallest id seen; whatever is not the smallest id of its
text is emitted. Each task first does this for its own rows, so a text that a third of all rows hold leaves a task once,
and the ids that are settled there go on under a key of their own, not under the text's.

Everything the report needs follows from how many documents of a part fail which set of filters: a vector of 32 counts
for all documents, for good and for toxic ones. combineByKey adds these vectors, in the tasks first, so what is moved
is one vector for each part and task. The report of a part (120 orders of 5 steps) is made from its vector.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, table, through_python, unused, written

LETTERS = "ABCDE"
#: Bytes of texts that a task holds before it sends its chains on, and of a partition of chains, about.
HELD_BYTES, PARTITION_BYTES = 16 << 20, 32 << 20
CAPITALS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"


def text_mask(text: str | None) -> int:
    """Bits of the filters A to D that a text fails: under 200 words; under half of its words distinct; over 3 % of its
    code points capitals A-Z; one of the symbols. Null is empty: it fails A only."""
    text = text or ""
    data = text.encode()
    words = data.split()
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 3 * len(text)) << 2
            | (len(data.translate(None, SYMBOLS)) < len(data)) << 3)


class Chains:
    """fingerprint -> [text, smallest id] of its distinct texts. A null id comes after all others."""

    def __init__(self):
        self.chains, self.bytes = {}, 0

    def add(self, fp: int, text: bytes, doc_id):
        """The id that is now known not to be its text's smallest, in a tuple; empty if there is none."""
        chain = self.chains.setdefault(fp, [])
        for entry in chain:
            if entry[0] == text:
                least = entry[1]
                if doc_id == least:
                    return ()
                if least is None or (doc_id is not None and doc_id < least):
                    entry[1] = doc_id
                    return (least,)
                return (doc_id,)
        chain.append([text, doc_id])
        self.bytes += len(text) + 200
        return ()

    def empty(self):
        """All (fingerprint, text, smallest id), which are then forgotten."""
        for fp, chain in self.chains.items():
            for text, doc_id in chain:
                yield fp, text, doc_id
        self.chains, self.bytes = {}, 0


def fingerprint(text: str = "text"):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def later_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (doc_id, fp) of the rows whose text a row with a smaller doc_id has, too; fp: fingerprint(text).

    Null texts are empty texts. A null doc_id is larger than all others. Rows that repeat doc_id and text are no copies
    of each other. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), fingerprint(text).alias("fp"), F.coalesce(text, F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), total // PARTITION_BYTES + 1)

    def leave(part):
        """(key, (fp, id, text)): chains under their fingerprint; settled ids, without a text, under a hash of their own."""
        chains = Chains()
        for row in part:
            for gone in chains.add(row[1], row[2].encode(), row[0]):
                yield xxhash.xxh64_intdigest(repr(gone)), (row[1], gone, None)
            if chains.bytes > HELD_BYTES:
                for fp, data, least in chains.empty():
                    yield fp, (fp, least, data)
        for fp, data, least in chains.empty():
            yield fp, (fp, least, data)
        give_back()

    def meet(part):
        chains = Chains()
        for _, (fp, own, data) in part:
            if data is None:
                yield own, fp
                continue
            for gone in chains.add(fp, data, own):
                yield gone, fp
        del chains
        give_back()

    found = rows.rdd.mapPartitions(leave).partitionBy(n, lambda key: key).mapPartitions(meet)
    return written(spark.createDataFrame(found, f"doc_id {kind}, fp long").distinct(), "copies")


def failures(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row for each row of docs: part (null: empty string), mask (bit k: it fails filter k), good and toxic (a label
    of its doc_id says so; none: false)."""
    id_, fp_ = unused(docs, "id", "fp")
    narrow = docs.select(F.col(doc_id).alias("doc_id"), fingerprint(text).alias("fp"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def work():
        return lambda rows: {c: rows.column(c) for c in ("doc_id", "fp", "part")} | {"mask": [text_mask(x) for x in rows.column("text").to_pylist()]}

    masks = through_python(narrow, work, f"doc_id {kind}, fp long, part string, mask int")
    copies = later_copies(docs, doc_id, text).select(F.col("doc_id").alias(id_), F.col("fp").alias(fp_), F.lit(True).alias("copy"))
    told = labels.groupBy(F.col("doc_id").alias(id_)).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    e = F.when(F.col("copy"), 1 << LETTERS.index("E")).otherwise(0)
    return (masks.join(copies, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col("fp") == F.col(fp_)), "left").drop(id_, fp_)
            .join(told, F.col("doc_id") == F.col(id_), "left")
            .select("part", (F.col("mask") + e).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")))


def report(part: str, counts: np.ndarray):
    """The rows of one part from its counts: 32 masks of all, of good and of toxic documents."""
    n, good, toxic = counts.reshape(3, -1)
    masks = np.arange(len(n))
    failing = [(masks >> k & 1).astype(bool) for k in range(len(LETTERS))]
    alone = [int(n[1 << k]) for k in range(len(LETTERS))]
    size = sum(f.astype(int) for f in failing)
    # of the filters that a document fails each comes first in as many orders
    orders = list(permutations(range(len(LETTERS))))
    shapley = [int((n[f] * (len(orders) // size[f])).sum()) for f in failing]
    for order in orders:
        left = np.ones(len(n), bool)
        for step, k in enumerate(order, 1):
            here, before = failing[k] & left, failing[k] & ~left
            left = left & ~failing[k]
            yield (part, "".join(LETTERS[x] for x in order), step, int(n[left].sum()), int(n[here].sum()), int(n[before].sum()), alone[k],
                   int(good[here].sum()), int(toxic[here].sum()), shapley[k])


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley; rows of zeros, too.

    Nulls: a null text is empty, a null part is the empty string, a null doc_id has no label and is the largest. Rows
    that repeat whole count as often as they come. Several labels of one doc_id count as good (toxic) if one of them
    is. An empty table gives an empty result. Other columns are not read.
    """
    width = 1 << len(LETTERS)

    def places(row):
        at = [row["mask"]]
        if row["good"]:
            at.append(width + row["mask"])
        if row["toxic"]:
            at.append(2 * width + row["mask"])
        return at

    def add(counts, at):
        counts[at] += 1
        return counts

    rows = failures(docs, labels, doc_id, text, part).rdd.map(lambda r: (r["part"], places(r)))
    vectors = rows.combineByKey(lambda at: add(np.zeros(3 * width, np.int64), at), add, lambda a, b: a + b)
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda x: report(*x)), "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(d.doc_id > min(d.doc_id) OVER (PARTITION BY t) AS INT) AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT concat(a.f, b.f, c.f, d.f, e.f) AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT o, i AS step, 1 << (ascii(o[i]) - 65) AS bit, coalesce(list_sum(list_transform(range(1, i), lambda k: 1 << (ascii(o[k]) - 65))), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS i))
SELECT part, o AS filter_order, step, CAST(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit > 0), 0) AS BIGINT) AS shapley
FROM s, c GROUP BY part, o, step
"""
