"""Mixing sources to target weights.

The words of each source are one stream, cut in blocks of a fixed length (of its own, where a source is too
small for the usual one). The slots of the mix are dealt to output shards by multinomial draws: for each run of
a source's slots the counts over the shards are drawn, all shards alike. So a shard's count of a source is as
chance has it, and a source's total is what its target asks for, which a draw for each shard by itself would
miss. The k-th slot of a source takes the block that a pseudorandom permutation of its block indices, one for
each turn, maps k to; slots and blocks are joined by index. A source of which more than all is taken goes
through its blocks once and then through a part of another permutation, so no block comes more than
ceil(target / size) times.

Sources are a table like any other: their order, their targets and their slots are made by jobs over it, so a
source may be a host or an address. The driver gets sums only.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, numbered, short_batches, sliced, small, table, unused

BLOCK_WORDS, SHARD_SLOTS, SLOTS_PER_ROW = 32, 8192, 1 << 16
#: A source has this many blocks at least, or blocks of one word.
LEAST_BLOCKS = 64
SHARE, CAP, WEIGHTS = 1.5, 2.0, (3, 1, 2)
ROWS_PER_BUCKET = 2_000
_SPACE = "\\x20\\x09-\\x0D"


def with_targets(sources: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple = WEIGHTS) -> DataFrame:
    """sources (source, source_size, and other columns) with sid, the place of a source in the order of code
    points, null last, and target, the words to take of it. Sources weigh `weights`, repeating; together they
    take share times all words; none takes more than cap times its own, and what is above goes to the others by
    weight. Sizes of zero have target 0. Each round of resharing is one aggregation and caps one source at least
    (most of them in the first rounds); only its sums reach the driver."""
    rows = numbered(sources, "source").withColumnRenamed("rank", "sid")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    rows = cut(rows.withColumn("w", w).withColumn("most", cap * F.col("source_size").cast("double")))
    total, one = rows.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while True:
        above = F.col("most") < one * F.col("w")
        held, free = rows.agg(F.sum(F.when(above, F.col("most")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("w")))).first()
        if not free:  # no row, or every source is capped
            one = float("inf")
            break
        again = (share * total - held) / free
        if again <= one:
            break
        one = again
    return rows.withColumn("target", F.least("most", one * F.col("w"))).drop("w", "most")


def permuted(x: np.ndarray, n: np.ndarray | int, key: np.ndarray | int) -> np.ndarray:
    """A pseudorandom permutation of 0 to n - 1 for each key: a four-round Feistel network over the next even
    number of bits, walked until the value is below n."""
    x = np.asarray(x, np.uint64)
    n = np.broadcast_to(np.asarray(n, np.uint64), x.shape)
    key = np.broadcast_to(np.asarray(key, np.uint64), x.shape)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float) + 1)) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            f = right * np.uint64(0x9E3779B97F4A7C15) + k * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(r + 1) * np.uint64(0x165667B19E3779F9)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


class Mix:
    """The plan of one mix and its tables, all of them jobs.

    Null and empty texts have no words: they are in the plan, but nothing is taken of them. Null sources are one
    source. Rows that repeat doc_id and text lie side by side in the stream of their source and count as often
    as they come. A table without words gives a mix without slots. Other columns of docs are not read.
    """

    def __init__(self, docs: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple = WEIGHTS, block: int = BLOCK_WORDS, seed: int = 77):
        self.seed = seed
        size = F.coalesce(F.regexp_count("text", F.lit(f"[^{_SPACE}]+")), F.lit(0)).cast("long")
        words = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("text_hash")))
        sources = with_targets(words.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), share, cap, weights)
        length = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long")
        turns = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        plan = sources.withColumns({"block_words": length, "turns": turns.cast("long")}).withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
        # whole turns take every word; the last, partial one takes as many full blocks as come nearest to the rest, so
        # it is off by half a block at most (the short block at a source's end is in whole turns only)
        plan = plan.withColumn("n_full", F.floor(F.col("source_size") / F.col("block_words")))
        part = F.round((F.col("target") - F.col("turns") * F.col("source_size")) / F.col("block_words")).cast("long")
        plan = plan.withColumn("n_slots", F.col("turns") * F.col("n_blocks") + F.when(part > F.col("n_full"), F.col("n_blocks")).otherwise(part))
        self.sources = cut(plan.withColumn("n_buckets", F.greatest(F.lit(1), F.floor(F.col("n_rows") / ROWS_PER_BUCKET))))  # a hot source has more buckets, not larger ones
        named = small(self.sources.select(F.col("source").alias("s"), "sid", "source_size", "target", "block_words", "n_buckets"))
        keyed = (words.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
                 .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("n_buckets"))))
        # running sums in two steps: within buckets, then over the buckets of a source
        local = F.sum("size").over(Window.partitionBy("sid", "bucket").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0))
        ends = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
        before = F.sum("n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        starts = ends.select("sid", "bucket", before.alias("before"))
        self.rows = cut(keyed.withColumn("local", local).join(starts, ["sid", "bucket"])
                        .withColumn("first", F.col("before") + F.col("local") - F.col("size")).drop("bucket", "n_buckets", "local", "before"))

    def fragments(self) -> DataFrame:
        """Blocks as the parts of documents that they hold: sid, block, first (of the document in its
        source), from_word (in the document), n_words."""
        b = F.col("block_words")
        end = F.col("first") + F.col("size")
        cut_up = self.rows.where("size > 0").select("sid", "doc_id", "text_hash", "first", "size", "block_words", F.explode(F.sequence(F.floor(F.col("first") / b), F.floor((end - 1) / b))).alias("block"))
        lo, hi = F.greatest(F.col("first"), F.col("block") * b), F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * b)
        return cut_up.select("sid", "block", "first", "doc_id", "text_hash", (lo - F.col("first")).alias("from_word"), (hi - lo).alias("n_words"))

    def slots(self) -> DataFrame:
        """Every slot of the mix: shard (about SHARD_SLOTS slots each), sid, block and turn (the round through the
        source's blocks). A row of SLOTS_PER_ROW slots of one source draws its counts over all shards."""
        seed = self.seed
        shards = max(1, -(-(self.sources.agg(F.sum("n_slots")).first()[0] or 0) // SHARD_SLOTS))
        runs = self.sources.where("n_slots > 0").select("sid", "n_slots", "n_blocks", "n_full", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / SLOTS_PER_ROW))).alias("run"))
        dealt = runs.repartition("sid", "run")

        def run(batches):
            for batch in batches:
                out = [[], [], [], []]
                for s, n, blocks, full, k in zip(*(c.to_pylist() for c in batch.columns)):
                    j = np.arange(k * SLOTS_PER_ROW, min(n, (k + 1) * SLOTS_PER_ROW), dtype=np.int64)
                    turn = j // blocks
                    among = np.where((turn == n // blocks) & (n % blocks <= full), full, blocks)
                    # the sum of uniform multinomial draws: each slot's shard, sorted, has just these counts
                    shard = np.sort(np.random.default_rng([seed, s, k]).integers(0, shards, len(j)))
                    for x, part in zip(out, (shard, np.full(len(j), s), permuted(j % blocks, among, (seed + 1 + s * 1_000_003 + turn * 7_919).astype(np.uint64)), turn)):
                        x.append(part)
                    if sum(map(len, out[0])) >= SLOTS_PER_ROW:
                        yield _slots(out)
                        out = [[], [], [], []]
                if out[0]:
                    yield _slots(out)
            give_back()

        return dealt.mapInArrow(run, "shard long, sid long, block long, turn int")

    def mixture(self) -> DataFrame:
        """The mix: slots joined with blocks by index. Rows of a slot in from_word order of first are its text.
        The hint keeps the planner, which cannot know how many slots a row makes, from a broadcast."""
        return self.slots().hint("merge").join(self.fragments(), ["sid", "block"])

    def drawn(self) -> DataFrame:
        """The draws: (shard, source, slots), a row for each shard and source that it has a slot of."""
        named = self.sources.select("sid", "source")
        return self.slots().groupBy("shard", "sid").agg(F.count("*").alias("slots")).join(named, "sid").select("shard", "source", "slots")

    def taken(self) -> DataFrame:
        """One row per document row: doc_id, source, size, source_size, target, taken, slots (that hold words of it),
        first_shard (null: none) and shard_spread (the last shard less the first)."""
        got = self.mixture().groupBy("sid", "first").agg(F.sum("n_words").alias("taken"), F.count("*").alias("slots"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
        some = self.rows.where("size > 0").join(got, ["sid", "first"], "left")
        names = ["doc_id", "source", "size", "source_size", "target"]
        none = F.lit(None).cast("long")
        counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "slots")]
        return some.select(*names, *counts, "first_shard", (F.col("last_shard") - F.col("first_shard")).alias("shard_spread")).unionByName(
            self.rows.where("size = 0").select(*names, F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("slots"), none.alias("first_shard"), none.alias("shard_spread")))


def _slots(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    shard, sid, block, turn = map(np.concatenate, columns)
    return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(sid), pa.array(block), pa.array(turn.astype(np.int32))], names=["shard", "sid", "block", "turn"])


def word_runs(text: str, runs: list[tuple[int, int]]) -> str:
    """The parts of a text that hold words a to b - 1 of each run, white space inside kept, joined by \\n."""
    at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    return "\n".join(text[at[a][0]:at[b - 1][1]] for a, b in runs)


def mix_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix has them: for each document and turn one row with the columns of docs, whose text is
    what the mix takes of it (whole, or the runs of words of its blocks) and n_chars that text's length.

    Null and empty texts have no words and so no place in a mix. Null sources are a source. Rows that repeat
    doc_id and text count as often as they come and give one row per turn with the parts of all.
    """
    mix = Mix(docs)
    own_hash, their_id, their_hash, their_parts = unused(docs, "own_hash", "their_id", "their_hash", "their_parts")
    parts = mix.mixture().groupBy("doc_id", "text_hash", "first", "turn").agg(F.array_sort(F.collect_list(F.struct("from_word", "n_words"))).alias(their_parts))
    parts = cut(parts.select(F.col("doc_id").alias(their_id), F.col("text_hash").alias(their_hash), their_parts))
    keyed = docs.withColumn(own_hash, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(their_id)) & (F.col(own_hash) == F.col(their_hash))
    repeated = mix.rows.groupBy("doc_id", "text_hash").count().where("count > 1")
    if repeated.limit(1).count():
        keyed = keyed.dropDuplicates(["doc_id", own_hash])
    joined = keyed.join(parts, same)
    schema = docs.schema
    names = docs.columns

    def run(batches):
        for batch in sliced(batches):
            texts = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column(their_parts).to_pylist()):
                runs: list[list[int]] = []
                for p in found:
                    a, b = p["from_word"], p["from_word"] + p["n_words"]
                    if runs and runs[-1][1] == a:
                        runs[-1][1] = b
                    else:
                        runs.append([a, b])
                texts.append(word_runs(text, runs))
            cols = [pa.array(texts, pa.string()) if c == "text" else pa.array([len(t) for t in texts], batch.column(c).type) if c == "n_chars"
                    else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        give_back()

    short_batches(docs.sparkSession)
    return joined.select(*[F.col(f"`{c}`") for c in names], their_parts).mapInArrow(run, schema)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return Mix(docs).taken().select("doc_id", "size", "source_size", "target", "taken", "slots", "first_shard", "shard_spread")
