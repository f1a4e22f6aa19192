"""Line dedup: hashes of lines are range-partitioned, sorted by document and position, and streamed.

A text's lines leave the scan as (128-bit hash of the key, document, position); no text is moved. The rows are
range-partitioned by hash and document, largest document first, so that a line which a third of all documents hold is
spread over as many tasks as its rows need, while the rows of one line in one document stay together. A task streams
its sorted rows: the first document of a hash keeps its lines, later ones lose theirs once enough have been seen; what
it holds is the lines of two documents (one less than are needed). Runs at the ends of a task may go on in another one,
so these documents stay open and are settled afterwards, with one summary for each such run (two for each task).

Dropped positions come back as one compressed keep bitmap for each document that loses lines.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, short_batches, sliced, table, through_python, written

BLANK = b" \t\n\x0b\x0c\r"
_LINE = ("h1", "h2", "doc_id", "text_key", "pos")


def text_key(text: str = "text"):
    """Tells rows of one doc_id with different texts apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_keys(text: str | None, least_chars: int) -> tuple[list[int], list[bytes]]:
    """Positions and 128-bit hashes of the lines whose key (blanks stripped at both ends, A-Z lower-cased) has
    least_chars code points or more."""
    at, hashes = [], []
    for k, line in enumerate((text or "").encode().lower().split(b"\n")):
        if len(line) < least_chars:
            continue
        line = line.strip(BLANK)
        if len(line) >= 4 * least_chars or len(line.decode()) >= least_chars:
            at.append(k)
            hashes.append(xxhash.xxh3_128_digest(line))
    return at, hashes


def line_rows(docs: DataFrame, least_chars: int) -> DataFrame:
    """docs: doc_id, text_key, text. One row (h1, h2, doc_id, text_key, pos) for each line that could be dropped."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part in sliced(batches):
            at, hashes, rows = [], [], []
            for row, text in enumerate(part.column("text").to_pylist()):
                own, h = line_keys(text, least_chars)
                at += own
                hashes += h
                rows += [row] * len(own)
            pair = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            rows = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), part.column("doc_id").take(rows), part.column("text_key").take(rows), pa.array(at, pa.int32())], names=list(_LINE))
        give_back()

    short_batches(docs.sparkSession)
    return docs.select("doc_id", "text_key", "text").mapInArrow(run, f"h1 long, h2 long, doc_id {kind}, text_key long, pos int")


def _changed(column: pa.Array, before) -> np.ndarray:
    """Whether each value differs from the one before it (null equals null); before: an array of one or none."""
    whole = pa.concat_arrays([before, column]) if before is not None else column
    a, b = whole.slice(0, len(whole) - 1), whole.slice(1)
    same = pc.fill_null(pc.equal(a, b), False)
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    differ = ~(same.to_numpy(zero_copy_only=False) | both.to_numpy(zero_copy_only=False))
    return differ if before is not None else np.r_[True, differ]


class _Runs:
    """Streams rows sorted by hash, document (largest first) and position. Of the current run it knows the documents so
    far and holds the rows of its first ones, up to the one that decides. Gives rows with `docs`: null for a row that
    is dropped for certain, else the documents that this task saw of the open run."""

    def __init__(self, least_docs: int):
        self.least, self.before, self.first = least_docs, None, True
        self.docs, self.held = 0, []  # of the current run: documents, (rows, places of their documents)

    def _out(self, rows: pa.RecordBatch, docs: int | None = None):
        if rows.num_rows:
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([docs] * rows.num_rows, pa.int64())], names=[*_LINE, "docs"])

    def _extend(self, rows: pa.RecordBatch, new_doc: np.ndarray):
        """More rows of the current run."""
        place = self.docs + np.cumsum(new_doc)
        early = place < self.least
        self.held.append((rows.filter(pa.array(early)), place[early]))
        yield from self._out(rows.filter(pa.array(~early)))
        self.docs = int(place[-1]) if len(place) else self.docs
        if self.docs >= self.least:  # decided: of what is held only the first document's rows are open
            for held, at in self.held:
                yield from self._out(held.filter(pa.array(at > 1)))
            self.held = [(held.filter(pa.array(at == 1)), at[at == 1]) for held, at in self.held if (at == 1).any()]

    def _finish(self, at_end: bool):
        if at_end or self.first:  # it may have begun or go on in another task
            for held, _ in self.held:
                yield from self._out(held, self.docs)
        self.first, self.docs, self.held = False, 0, []

    def push(self, batch: pa.RecordBatch):
        if not batch.num_rows:
            return
        before = self.before
        new_key = _changed(batch.column("h1"), before and before.column("h1")) | _changed(batch.column("h2"), before and before.column("h2"))
        new_doc = new_key | _changed(batch.column("doc_id"), before and before.column("doc_id"))
        starts = np.flatnonzero(new_key)
        if before is None:
            starts = starts[1:]  # the first run of the task counts as one that goes on
        self.before = batch.slice(batch.num_rows - 1, 1)
        head = starts[0] if len(starts) else batch.num_rows
        yield from self._extend(batch.slice(0, head), new_doc[:head])
        if not len(starts):
            return
        yield from self._finish(False)
        tail = starts[-1]
        if tail > head:  # whole runs, all at once
            run = np.cumsum(new_key[head:tail]) - 1
            so_far = np.cumsum(new_doc[head:tail])
            place = so_far - (so_far[starts[:-1] - head] - 1)[run]
            docs = np.zeros(len(starts) - 1, np.int64)
            np.maximum.at(docs, run, place)
            yield from self._out(batch.slice(head, tail - head).filter(pa.array((place > 1) & (docs[run] >= self.least))))
        yield from self._extend(batch.slice(tail), new_doc[tail:])

    def close(self):
        yield from self._finish(True)


def dropped_lines(docs: DataFrame, least_docs: int, least_chars: int) -> DataFrame:
    """docs: doc_id, text_key, text. Rows (doc_id, text_key, pos) of the lines that go; a line of rows that repeat whole
    may come twice."""
    lines = line_rows(docs, least_chars)
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last()]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order, "pos")

    def stream(batches):
        runs = _Runs(least_docs)
        for batch in batches:
            yield from runs.push(batch)
        yield from runs.close()
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = written(dealt.mapInArrow(stream, f"h1 long, h2 long, doc_id {kind}, text_key long, pos int, docs long").withColumn("task", F.spark_partition_id()), "lines")
    is_open = found.where("docs IS NOT NULL")
    # one row for each run at the end of a task, so at most two for each task
    whole = (is_open.groupBy("h1", "h2", "task").agg(F.max("docs").alias("docs"), F.max("doc_id").alias("largest"))
             .groupBy("h1", "h2").agg(F.sum("docs").alias("all"), F.max("largest").alias("largest")).where(F.col("all") >= least_docs))
    settled = is_open.join(whole, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("largest")))
    cols = ["doc_id", "text_key", "pos"]
    return found.where("docs IS NULL").select(*cols).unionByName(settled.select(*cols))


def pack_bitmap(dropped: list[int]) -> bytes:
    """Compressed bits, one for each line up to the last one dropped (and to a whole byte); 1: it stays, as do lines beyond."""
    keep = np.ones(max(dropped) // 8 * 8 + 8, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def unpack_bitmap(data: bytes | None, n_lines: int) -> np.ndarray:
    keep = np.ones(n_lines, bool)
    if data is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8)).astype(bool)[:n_lines]
        keep[:len(bits)] = bits
    return keep


def keep_bitmaps(docs: DataFrame, least_docs: int = 3, least_chars: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, keep) of every text that loses lines: lines whose key has least_chars code points or more and
    is found in least_docs documents or more go, except in the largest doc_id that holds them (nulls are smallest).

    Rows with one doc_id are one document, for counting and for keeping. Null and empty texts have one empty line. An
    empty table gives an empty result. Other columns are not read. Keys are equal if their 128-bit hashes are.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    by_text = dropped_lines(narrow, least_docs, least_chars).groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("dropped"))  # lines of one text

    def work():
        return lambda part: {"doc_id": part.column("doc_id"), "text_key": part.column("text_key"), "keep": [pack_bitmap(x) for x in part.column("dropped").to_pylist()]}

    return through_python(by_text, work, f"doc_id {kind}, text_key long, keep binary")


def drop_lines(docs: DataFrame, least_docs: int = 3, least_chars: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_dropped and kept_text. See keep_bitmaps."""
    keep = keep_bitmaps(docs, least_docs, least_chars, doc_id, text)
    keep = keep.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "keep")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("text_key", text_key("text"))
    joined = rows.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left").select("doc_id", "text", "keep")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work():
        def each(part: pa.RecordBatch) -> dict:
            total, gone, out = [], [], []
            for text, data in zip(part.column("text").to_pylist(), part.column("keep").to_pylist()):
                lines = (text or "").split("\n")
                keep = unpack_bitmap(data, len(lines))
                total.append(len(lines))
                gone.append(int((~keep).sum()))
                out.append("\n".join(x for x, k in zip(lines, keep) if k))
            return {"doc_id": part.column("doc_id"), "n_lines": total, "n_dropped": gone, "kept_text": out}

        return each

    return through_python(joined, work, f"doc_id {kind}, n_lines long, n_dropped long, kept_text string")


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.key IS NOT NULL AND doc_id <> largest AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
