"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

A sequence is filled greedily with the longest pieces that fit; then its shortest piece gives way to two
unpacked pieces if those fill the widened gap more tightly. Only lengths matter, so one plan is made for the
whole table from the number of pieces of each length: `capacity` numbers, whatever the size of the table. The
plan says how often each kind of sequence comes; a piece finds its place by its rank among the pieces of its
length. Nothing is packed in groups, so no group leaves a partly filled end.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, short_batches, sliced, table

CAPACITY, END_ID = 4096, 1
TOKENIZER = "word_bpe_49k.json"
#: Ranks are counted within buckets of about this many pieces (64 buckets at least), then over the buckets.
PIECES_PER_BUCKET = 100_000

# Latin-1 texts without control characters are split here, if the tokenizer splits as _SPLITS says; any other
# text, and any text of another tokenizer, goes to the tokenizer as a whole.
_PLAIN = re.compile(r"[\t\n\v\f\r\x20-\x7e\xa1-\xff]*")
_LETTER, _NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
_SPLITS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def _byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow 255."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Ids(dict):
    """Token ids (little-endian unsigned 32-bit) of words, kept as they come up."""

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        self.splits = all(own.get(k) == v for k, v in _SPLITS.items()) and all(t["content"].startswith("<|") for t in own["added_tokens"])

    def __missing__(self, word: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(letters)]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self.most:  # the words met first are the frequent ones; rare ones need no place
            self[word] = out
        return out

    def chunk(self, chunk: str) -> bytes:
        """Ids of a lower-case plain chunk without white space that is no word on hand; its words are kept, it is not."""
        if chunk[-1:] in (",", ".") and chunk[-2:-1].isalpha() and chunk[:-1] in self:  # what most of these chunks are
            return self[chunk[:-1]] + self[chunk[-1]]
        return b"".join(map(self.__getitem__, _WORD.findall(chunk)))

    def of_all(self, texts: pa.Array):
        """Ids of each whole text, one after the other, without special tokens of the tokenizer's own; null: none.
        Each distinct chunk of the array is looked up once."""
        texts = pc.fill_null(texts, "")
        plain = [self.splits and _PLAIN.fullmatch(x) is not None and "<|" not in x for x in texts.to_pylist()]
        chunks = pc.ascii_split_whitespace(pc.utf8_lower(texts.filter(pa.array(plain, pa.bool_()))))
        coded = chunks.flatten().dictionary_encode()
        own = [self.get(c) or self.chunk(c) for c in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        sizes = np.fromiter(map(len, own), np.int32, len(own)) // 4
        first, ids, which = np.cumsum(sizes, dtype=np.int32) - sizes, np.frombuffer(b"".join(own), "<u4"), coded.indices.to_numpy()
        size = sizes[which]
        ends = np.r_[0, np.cumsum(size, dtype=np.int32)]
        ids = ids[np.arange(ends[-1], dtype=np.int32) + np.repeat(first[which] - ends[:-1], size)]
        cuts = iter(ends[np.cumsum(pc.list_value_length(chunks).to_numpy())].tolist())
        at = 0
        for k, here in enumerate(plain):
            if here:
                to = next(cuts)
                yield ids[at:to].tobytes()
                at = to
            else:
                yield np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str | None) -> bytes:
        return next(self.of_all(pa.array([text], pa.string())))


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                 with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids, little-endian, on
    demand), key (spreads pieces evenly). A document is its ids and end_id; only longer ones than capacity
    are cut. tokenizer_path: of the public tokenizer, None: where the package public_tokenizers has it.

    A null or empty text is one piece of end_id alone. Null doc_ids stay null. Rows that repeat give their
    pieces as often as they come. An empty table gives an empty result."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, key long" + ", ids binary" * with_ids

    def run(batches):
        from pyspark import TaskContext

        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        ids, end, step = Ids(path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        task = TaskContext.get()
        n = (task.partitionId() if task else 0) << 40
        for part in sliced(batches, 4096, 4 << 20):
            which, rows = [], []
            for k, data in enumerate(ids.of_all(part.column(1))):
                data += end
                for p, a in enumerate(range(0, len(data), step)):
                    own = data[a:a + step]
                    which.append(k)
                    rows.append((p, a // 4, len(own) // 4, zlib.crc32(own), n, own if with_ids else b""))
                    n += 1
            cols = list(zip(*rows)) if rows else [()] * 6
            out = [part.column(0).take(pa.array(which, pa.int32())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()),
                   pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "key"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(cols[5], pa.binary())] * with_ids, names=names + ["ids"] * with_ids)
        del ids
        give_back()

    short_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan_best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Kinds of sequences with their numbers, in the order in which they are made. counts: pieces of each length
    from 1 to capacity.

    Lengths on hand are bits of an integer, so the longest that fits is a mask and a bit length; with the
    mirrored integer, an AND tells whether two lengths on hand have a given sum. A sequence is made again at
    once, as often as the pieces that its making holds at a time are on hand: no choice can differ, since a
    length that has run out was not chosen at the places where it now lacks. Every kind so uses a length up to
    less than it takes, which bounds the number of kinds by about capacity * ln(capacity).
    """
    left = [0] * (capacity + 1)
    for n, c in counts.items():
        left[n] = c
    have = sum(1 << n for n in range(capacity + 1) if left[n])
    mirror = sum(1 << (capacity - n) for n in range(capacity + 1) if left[n])

    def change(n: int, by: int):
        nonlocal have, mirror
        before, left[n] = left[n], left[n] + by
        if bool(before) != bool(left[n]):
            have ^= 1 << n
            mirror ^= 1 << (capacity - n)

    out = []
    while have:
        filled, gap = [], capacity
        while (n := (have & ((1 << (gap + 1)) - 1)).bit_length() - 1) > 0:
            change(n, -1)
            filled.append(n)
            gap -= n
        held = Counter(filled)
        if gap and have:
            small = filled[-1]
            for total in range(gap + small, small, -1):
                pairs = have & (mirror >> (capacity - total))
                if total % 2 == 0 and left[total // 2] == 1:
                    pairs &= ~(1 << (total // 2))  # one piece is no pair
                if pairs:
                    a = pairs.bit_length() - 1
                    held.update((a, total - a))
                    filled.pop()
                    change(small, 1)
                    for n in (a, total - a):
                        change(n, -1)
                        filled.append(n)
                    break
        used = Counter(filled)
        again = max(0, min((left[n] + used[n] - held[n]) // c for n, c in used.items()))
        for n, c in used.items():
            change(n, -c * again)
        out.append((filled, 1 + again))
    return out


def best_two_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Sequences as lists of lengths whose sums are at most capacity. Every length is from 1 to capacity."""
    return [filled for filled, times in plan_best_two_fit(Counter(lengths), capacity) for _ in range(times)]


def places(plan: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, offset): ranks from there on lie at that offset of
    one sequence after the other."""
    lines: dict[int, list] = {}
    rank: Counter = Counter()
    first = 0
    for filled, times in plan:
        at = 0
        for n in filled:
            lines.setdefault(n, []).append((rank[n], first, at))
            rank[n] += times
            at += n
        first += times
    return {n: np.array(x, np.int64) for n, x in lines.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (behind a checkpoint) with sequence_id and offset. Ties among equal lengths go by bucket, doc_id,
    piece and start; repeated rows are pieces of their own. An empty table gives an empty result.

    The driver gets one count per length and hands out the places: both are bounded by capacity."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = pieces.sparkSession.sparkContext.broadcast(places(plan_best_two_fit(counts, capacity)))
    buckets = 64 + sum(counts.values()) // PIECES_PER_BUCKET
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    local = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start", "key"))
    sizes = dealt.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ranked = dealt.withColumn("local", local).join(sizes.select("bucket", "length", before.alias("before")), ["bucket", "length"])
    names = [c for c in pieces.columns if c != "key"]
    schema = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long"

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for own in np.split(order, cuts[1:]):
                if len(own):
                    lines = where.value[int(length[own[0]])]
                    hit = lines[np.searchsorted(lines[:, 0], rank[own], "right") - 1]
                    seq[own], off[own] = hit[:, 1] + rank[own] - hit[:, 0], hit[:, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, (F.col("before") + F.col("local") - 1).alias("rank")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every document of docs, null texts as empty, as pieces with their places: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset (and ids). Extra columns are not read."""
    return pack(cut(token_pieces(docs, tokenizer_path, capacity, with_ids=with_ids)), capacity)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
