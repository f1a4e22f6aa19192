"""A stored full-text index: posting lists in blocks, read by term and pruned by block bounds.

Writes come in segments. A task counts the terms of its documents as they stream by and deals them, sorted by length, to
slices of at most slice_docs; a block holds the postings of one term in one slice, with the highest frequency and the
smallest length in it, from which the highest score of any of its documents follows. Slices lie within a task, so blocks
are whole when they leave it and no posting is shuffled: a text is read once, and what is written is the index. Blocks of
one slice cover the same documents whatever the term, so a slice's bound for a query is the sum of its blocks' bounds, and
a slice that cannot reach the k-th best score is not read (block-max pruning over ranges of documents; Mallia et al.,
2024). Blocks lie in folders by a hash of their term, sorted by term within each task's file, so a query reads its terms'
folders and row groups alone.

A deletion writes the document's place among the dead and takes its terms off the counts; an update does both and adds
the new version. Counts of documents and terms are stored as changes, a row for each segment (and term), so scores equal
those over the rows alive. A segment counts once its row of statistics is written, which comes last; writing it again
replaces its files.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import analyzer
from ..functions.analyzer import stem_word
from ..runtime import BROADCAST_ROWS, cut, short_shuffles, small, travels
from .lexical import B, K1

travels(__name__)

#: Postings and documents lie in one folder, since one pass over the texts writes both; documents under bucket -1.
_FOLDERS = {"postings": "entries", "docs": "entries"}
_SCHEMAS = {
    "postings": "term string, slice string, keys array<string>, at array<int>, tfs array<int>, dls array<int>, n int, max_tf int, min_dl int, segment long, bucket int",
    "terms": "term string, df long, segment long, bucket int",
    "docs": "key string, slice string, place int, dl int, terms array<string>, segment long, bucket int",
    "dead": "key string, slice string, dl int, segment long",
    "stats": "docs long, tokens long, replaces array<long>, segment long",
}
_ENTRY = "term string, slice string, keys array<string>, at array<int>, tfs array<int>, dls array<int>, n int, max_tf int, min_dl int, key string, place int, dl int, terms array<string>"
#: Postings that a task holds at once, rows that it takes at once, postings of a batch that it gives, stems it remembers.
HELD, TAKEN, GIVEN, STEMS = 1 << 21, 512, 1 << 17, 1 << 19


class _Held:
    """Documents of a task on their way to slices: counts of terms by document, in arrays."""

    def __init__(self, stems: dict[str, str] | None):
        self.stems, self.terms, self.codes, self.tfs, self.keys, self.dls, self.docs, self.size = stems, {}, [], [], [], [], 0, 0

    def _term(self, word: str) -> int:
        if self.stems is not None:
            if (term := self.stems.get(word)) is None:
                if len(self.stems) >= STEMS:
                    self.stems.clear()
                term = self.stems[word] = stem_word(word)
            word = term
        return self.terms.setdefault(word, len(self.terms))

    def take(self, batch: pa.RecordBatch) -> None:
        """key, words and, where words are distinct already, their counts."""
        words = batch.column(1)
        lens = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(words.flatten())
        ids = np.fromiter(map(self._term, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        doc = np.repeat(np.arange(batch.num_rows), lens)
        code = ((doc + self.docs) << 32) | ids[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
        if batch.num_columns > 2:
            count = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            code, at = np.unique(code, return_inverse=True)
            tf = np.bincount(at, count, len(code)).astype(np.int64)
            lens = np.bincount(doc, count, batch.num_rows).astype(np.int64)
        else:
            code, tf = np.unique(code, return_counts=True)
        self.codes.append(code)
        self.tfs.append(tf)
        self.keys.append(batch.column(0).cast(pa.string()))
        self.dls.append(lens)
        self.docs, self.size = self.docs + batch.num_rows, self.size + len(code)

    def entries(self, name: str, slice_docs: int):
        """Rows of documents and of blocks. Slices are runs of documents in order of length."""
        dl = np.concatenate(self.dls)
        by = np.argsort(dl, kind="stable")
        rank = np.empty_like(by)
        rank[by] = np.arange(self.docs)
        parts = -(-self.docs // slice_docs)
        run = np.arange(self.docs) * parts // self.docs  # the slice of each document, in order of length
        place = np.arange(self.docs) - np.searchsorted(run, np.arange(parts))[run]  # and its place there
        names, keys, dl = pa.array([f"{name}-{k}" for k in range(parts)]), pa.concat_arrays(self.keys).take(pa.array(by)), dl[by]
        code, tf, terms = np.concatenate(self.codes), np.concatenate(self.tfs), pa.array(list(self.terms), pa.string())
        doc, term = rank[code >> 32], code & 0xFFFFFFFF
        o = np.lexsort((term, doc))
        ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=self.docs))]
        at = 0
        while at < self.docs:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + GIVEN, "right")) - 1)
            own = pa.ListArray.from_arrays(pa.array(ends[at:to + 1] - ends[at], pa.int32()), terms.take(pa.array(term[o[ends[at]:ends[to]]])))
            yield _entry(to - at, slice=names.take(pa.array(run[at:to])), key=keys.slice(at, to - at), place=pa.array(place[at:to], pa.int32()), dl=pa.array(dl[at:to], pa.int32()), terms=own)
            at = to
        if not len(code):
            return
        o = np.lexsort((doc, term))
        term, doc, tf = term[o], doc[o], tf[o]
        starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (run[doc[1:]] != run[doc[:-1]])])
        ends, most, least = np.r_[starts, len(term)], np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl[doc], starts)
        at = 0
        while at < len(starts):
            to = min(len(starts), max(at + 1, int(np.searchsorted(ends, ends[at] + GIVEN, "right")) - 1))
            a, b = ends[at], ends[to]
            offsets = pa.array(ends[at:to + 1] - a, pa.int32())
            lists = {c: pa.ListArray.from_arrays(offsets, x) for c, x in (("keys", keys.take(pa.array(doc[a:b]))), ("at", pa.array(place[doc[a:b]], pa.int32())), ("tfs", pa.array(tf[a:b], pa.int32())), ("dls", pa.array(dl[doc[a:b]], pa.int32())))}
            yield _entry(to - at, term=terms.take(pa.array(term[starts[at:to]])), slice=names.take(pa.array(run[doc[starts[at:to]]])), **lists,
                         n=pa.array(np.diff(ends[at:to + 1]), pa.int32()), max_tf=pa.array(most[at:to], pa.int32()), min_dl=pa.array(least[at:to], pa.int32()))
            at = to


_TYPES = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


def _entry(rows: int, **have) -> pa.RecordBatch:
    names = [x.split(" ") for x in _ENTRY.split(", ")]
    return pa.RecordBatch.from_arrays([have.get(c, pa.nulls(rows, _TYPES[t])) for c, t in names], names=[c for c, _ in names])


def _entries(segment: int, slice_docs: int, english: bool):
    def run(batches):
        part, n, stems = TaskContext.get().partitionId(), 0, {} if english else None
        held = _Held(stems)
        for batch in batches:
            for at in range(0, batch.num_rows, TAKEN):
                held.take(batch.slice(at, TAKEN))
                if held.docs >= 8 * slice_docs or held.size >= HELD:
                    yield from held.entries(f"{segment}-{part}-{n}", slice_docs)
                    held, n = _Held(stems), n + 1
        if held.docs:
            yield from held.entries(f"{segment}-{part}-{n}", slice_docs)

    return run


def query_terms(queries: DataFrame, query: str = "query", english: bool = True) -> DataFrame:
    """queries with their distinct stems (or words): column terms."""
    return queries.withColumn("terms", analyzer.query_stems(query) if english else F.array_sort(F.array_distinct(analyzer.words(query))))


class FullTextIndex:
    """Under a folder that every executor reaches. buckets: folders of terms; slice_docs: documents of a slice; english:
    terms are stems, not words."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, slice_docs: int = 1_024, english: bool = True):
        self.spark, self.path, self.buckets, self.slice_docs, self.english = spark, path.rstrip("/"), buckets, slice_docs, english

    # -- tables -------------------------------------------------------------------------------------------
    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def segments(self) -> list[int]:
        """Those that count: written to the end and not replaced. A row for each segment."""
        if not self._exists(f"{self.path}/stats"):
            return []
        rows = self.spark.read.schema(_SCHEMAS["stats"]).parquet(f"{self.path}/stats").select("segment", "replaces").collect()
        gone = {s for r in rows for s in r["replaces"] or []}
        return sorted(r["segment"] for r in rows if r["segment"] not in gone)

    def table(self, name: str, segments: list[int] | None = None) -> DataFrame:
        schema, live = _SCHEMAS[name], self.segments() if segments is None else segments
        path = f"{self.path}/{_FOLDERS.get(name, name)}"
        if not live or not self._exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(path).where(F.col("segment").isin(live))
        return rows.where("bucket < 0" if name == "docs" else "bucket >= 0") if name in _FOLDERS else rows

    def _store(self, name: str, rows: DataFrame, segment: int) -> None:
        writer = rows.drop("segment").write.mode("overwrite").option("compression", "zstd").option("parquet.dictionary.page.size", 8 << 20)  # a task's keys, each once
        with short_shuffles(self.spark):
            (writer.partitionBy("bucket") if "bucket" in rows.columns else writer).parquet(f"{self.path}/{name}/segment={segment}")

    # -- writes -------------------------------------------------------------------------------------------
    def _next(self) -> int:
        if not self._exists(f"{self.path}/stats"):
            return 1
        return 1 + (self.spark.read.schema(_SCHEMAS["stats"]).parquet(f"{self.path}/stats").agg(F.max("segment")).first()[0] or 0)

    def add(self, rows: DataFrame, key: str, field: str, segment: int | None = None) -> None:
        """Indexes rows; a key that is there already is replaced. Null texts count as documents without tokens. A key
        that comes twice in rows is not allowed. A segment's number is new, or that of a write to be repeated."""
        own = rows.select(F.col(key).cast("string").alias("key"), analyzer.words(field).alias("words"))
        self._write(own, rows.select(F.col(key).alias("key")), segment or self._next(), self.english)

    def delete(self, keys: DataFrame, key: str, segment: int | None = None) -> None:
        """Unknown keys change nothing."""
        none = self.spark.createDataFrame([], "key string, words array<string>")
        self._write(none, keys.select(F.col(key).alias("key")), segment or self._next(), False)

    def compact(self, segment: int | None = None) -> None:
        """All segments become one, without what is dead."""
        old, segment = self.segments(), segment or self._next()
        tf = self._alive(self.table("postings", old), old).groupBy("key").agg(F.collect_list(F.struct("term", "tf")).alias("e"))
        own = self._living_docs(old).select("key").join(tf, "key", "left").select("key", F.coalesce("e.term", F.array().cast("array<string>")).alias("words"), F.coalesce("e.tf", F.array().cast("array<int>")).alias("counts"))
        self._write(own, None, segment, False, old)

    def _living_docs(self, segments: list[int]) -> DataFrame:
        return self.table("docs", segments).join(self.table("dead", segments).select("key", "slice"), ["key", "slice"], "left_anti")

    def _write(self, rows: DataFrame, gone: DataFrame | None, segment: int, english: bool, replaces: list[int] | None = None) -> None:
        """rows: key, words and, where these are distinct terms, counts. What the versions of gone keys add to the counts
        is taken off."""
        before = [s for s in self.segments() if s != segment]
        entries = rows.mapInArrow(_entries(segment, self.slice_docs, english), _ENTRY)
        entries = entries.withColumn("bucket", F.when(F.col("key").isNotNull() | F.col("term").isNull(), -1).otherwise(self._bucket("term")))
        self._store("entries", entries.sortWithinPartitions("bucket", "term", "slice"), segment)
        none = self.spark.createDataFrame([], "key string, slice string, dl int")
        narrow = self._living_docs(before).select("key", "slice", "dl")
        self._store("dead", narrow.join(gone.distinct(), "key", "left_semi") if gone is not None and before else none, segment)
        dead = self.table("dead", [segment]).select("key", "slice", "dl")
        marks = dead.select("key", "slice")
        lost = self.table("docs", before).join(F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks, ["key", "slice"], "left_semi")
        change = self.table("postings", [segment]).select("bucket", "term", F.col("n").cast("long").alias("d"))
        change = change.unionByName(lost.select(F.explode("terms").alias("term"), F.lit(-1).cast("long").alias("d")).withColumn("bucket", self._bucket("term")))
        change = change.groupBy("bucket", "term").agg(F.sum("d").alias("df")).select("term", "df", "bucket")
        self._store("terms", change.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term"), segment)
        total = self.table("docs", [segment]).select("dl", F.lit(1).alias("d")).unionByName(dead.select("dl", F.lit(-1).alias("d"))).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.col("dl") * F.col("d")), F.lit(0)).alias("tokens"))
        self._store("stats", total.select(F.col("docs").cast("long"), F.col("tokens").cast("long"), F.array(*[F.lit(s) for s in replaces or []]).cast("array<long>").alias("replaces")), segment)

    # -- reads --------------------------------------------------------------------------------------------
    def statistics(self, segments: list[int] | None = None) -> DataFrame:
        """One row: docs, avg (length of a document)."""
        s = self.table("stats", segments).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
        return s.select(F.col("docs").cast("double").alias("docs"), F.coalesce(F.try_divide("tokens", "docs"), F.lit(0.0)).alias("avg"))

    def _alive(self, blocks: DataFrame, segments: list[int]) -> DataFrame:
        """A row for each posting of a living document."""
        each = blocks.select(*[c for c in blocks.columns if c not in ("keys", "at", "tfs", "dls")], F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))))
        return each.join(self.table("dead", segments).select("key", "slice"), ["key", "slice"], "left_anti")

    def _of_terms(self, name: str, terms: dict[str, int], segments: list[int]) -> DataFrame:
        return self.table(name, segments).where(F.col("bucket").isin(list(set(terms.values()))) & F.col("term").isin(list(terms)))

    def terms_of(self, query: str) -> dict[str, int]:
        """The stems of one query and their folders."""
        one = query_terms(self.spark.createDataFrame([(query,)], "query string"), english=self.english).select(F.explode("terms").alias("term"))
        return {r[0]: r[1] for r in one.select("term", self._bucket("term")).collect()}

    def search(self, query: str, k: int | None = None, all_terms: bool = True) -> DataFrame:
        """(key, ft_score) of the documents that hold all terms of a query (or any), all of them or the k best: by score
        to nine decimals, then key. A query without terms finds nothing."""
        terms, live = self.terms_of(query), self.segments()
        if not terms or not live:
            return self.spark.createDataFrame([], "key string, ft_score double")
        blocks = self._blocks(terms, live)
        need = len(terms) if all_terms else 1
        if k is None:
            return self._scored(blocks, live, need)
        bounds = (blocks.groupBy("slice").agg(F.count("*").alias("t"), F.sum(F.col("idf") * _share(F.col("max_tf"), F.col("min_dl"), F.col("avg"))).alias("bound"))
                  .where(F.col("t") >= need).select("slice", "bound"))
        bounds = cut(bounds)  # a narrow row for each slice
        first = bounds.orderBy(F.col("bound").desc(), "slice").limit(1 + 4 * k // self.slice_docs)
        reached = self._scored(blocks.join(F.broadcast(first.select("slice")), "slice"), live, need).orderBy(F.col("ft_score").desc()).limit(k)
        floor = reached.agg(F.when(F.count("*") >= k, F.min("ft_score")).otherwise(F.lit(float("-inf"))).alias("floor"))
        kept = self.candidate_slices = bounds.join(F.broadcast(floor)).where(F.col("bound") >= F.col("floor") - F.lit(1e-8)).select("slice")
        return self._scored(blocks.join(kept, "slice"), live, need).orderBy(F.round("ft_score", 9).desc(), "key").limit(k)

    def _blocks(self, terms: dict[str, int], live: list[int]) -> DataFrame:
        stats = F.broadcast(self.statistics(live))  # one row
        df = self._of_terms("terms", terms, live).groupBy("term").agg(F.sum("df").alias("df")).join(stats).withColumn("idf", _idf(F.col("docs"), F.col("df")))
        return self._of_terms("postings", terms, live).join(F.broadcast(df.select("term", "idf", "avg")), "term")  # the terms of one query

    def parts(self, terms: dict[str, int]) -> DataFrame:
        """(key, term, part): what each term adds to each document that holds it."""
        live = self.segments()
        if not terms or not live:
            return self.spark.createDataFrame([], "key string, term string, part double")
        each = self._alive(self._blocks(terms, live).select("slice", "term", "idf", "avg", "keys", "tfs", "dls"), live)
        return each.select("key", "term", (F.col("idf") * _share(F.col("tf"), F.col("dl"), F.col("avg"))).alias("part"))

    def weights(self, terms: DataFrame, live: list[int]) -> DataFrame:
        """(bucket, term, idf, avg) of a table of terms, broadcast where they are few, so that blocks of others stay where they lie."""
        wanted = terms.select("term").distinct().withColumn("bucket", self._bucket("term"))
        stats = F.broadcast(self.statistics(live))  # one row
        df = self.table("terms", live).join(wanted, ["bucket", "term"]).groupBy("bucket", "term").agg(F.sum("df").alias("df"))
        return small(df.join(stats).select("bucket", "term", _idf(F.col("docs"), F.col("df")).alias("idf"), "avg"))

    def blocks_batch(self, terms: DataFrame, live: list[int], *columns: str) -> DataFrame:
        """(slice, term, idf, avg and columns): whole blocks of a table of terms, each read once, whoever asks. Dead documents
        are still in them."""
        return self.table("postings", live).join(self.weights(terms, live), ["bucket", "term"]).select("slice", "term", "idf", "avg", *(columns or ("at", "tfs")))

    def parts_batch(self, terms: DataFrame) -> DataFrame:
        """parts() for a table of terms: a row for each posting, so for short texts."""
        live = self.segments()
        each = self._alive(self.blocks_batch(terms, live, "keys", "tfs", "dls"), live)
        return each.select("term", "key", (F.col("idf") * _share(F.col("tf"), F.col("dl"), F.col("avg"))).alias("part"))

    def places(self) -> DataFrame:
        """(key, slice, place, dl) of the living documents."""
        return self._living_docs(self.segments()).select("key", "slice", "place", "dl")

    def _scored(self, blocks: DataFrame, live: list[int], need: int) -> DataFrame:
        part = F.col("idf") * _share(F.col("tf"), F.col("dl"), F.col("avg"))
        found = self._alive(blocks.select("slice", "term", "idf", "avg", "keys", "tfs", "dls"), live).groupBy("slice", "key").agg(F.sum(part).alias("ft_score"), F.count("*").alias("t"))
        return found.where(F.col("t") >= need).select("key", "ft_score")

    def search_batch(self, queries: DataFrame, k: int, all_terms: bool = True) -> DataFrame:
        """queries: query_id, query. (query_id, key, ft_score, rank from 1), k for each query, in one plan.

        Blocks of the terms that any of QUERIES_AT_ONCE queries has meet in their slices, as they are; a slice scores its
        documents for these queries and gives the k best of each, so no posting is a row and no document that is out of
        reach leaves its slice."""
        live = self.segments()
        asked = cut(query_terms(queries.select("query_id", "query"), english=self.english).withColumn("need", F.size("terms") if all_terms else F.lit(1)).where(F.size("terms") > 0).drop("query"))
        groups = -(-asked.count() // QUERIES_AT_ONCE) or 1
        asked = asked.withColumn("part", F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(groups)).cast("int"))
        each = small(asked.select("part", F.explode("terms").alias("term")).distinct())
        blocks = self.blocks_batch(each, live).join(each, "term")
        told = asked.groupBy("part").agg(F.collect_list(F.struct("query_id", "need", "terms")).alias("queries"))
        docs = self.places().groupBy("slice").agg(F.collect_list(F.struct("key", "place", "dl")).alias("docs")).crossJoin(told)
        rows = blocks.unionByName(docs, allowMissingColumns=True)
        kind = dict(asked.dtypes)["query_id"]
        found = rows.select("part", "slice", "term", "idf", "avg", "at", "tfs", "docs", "queries").groupBy("part", "slice").applyInArrow(_best_of_slice(k), f"query_id {kind}, key string, ft_score double")
        w = Window.partitionBy("query_id").orderBy(F.round("ft_score", 9).desc(), "key")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "key", "ft_score", "rank")


#: Queries that a slice scores at once.
QUERIES_AT_ONCE = 256


def ticks(score: np.ndarray) -> np.ndarray:
    """Scores in units of 1e-9, rounded as round(score, 9) does it: half up by their shortest digits."""
    x = score * 1e9
    out = np.floor(x + 0.5).astype(np.int64)
    for i in np.flatnonzero(np.abs(x - np.floor(x) - 0.5) < 1e-3).tolist():
        out[i] = int((Decimal(repr(float(score[i]))) * 1_000_000_000).to_integral_value(ROUND_HALF_UP))
    return out


def parts_of(blocks: pa.Table, docs: pa.StructArray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of the blocks (term, idf, avg, at, tfs) of one slice: term -> those of its documents that are among docs (place, dl),
    by their number there, and what it adds to each."""
    if not blocks.num_rows or not len(docs):
        return {}
    column = lambda c: blocks.column(c).combine_chunks()
    number = lambda x: x.to_numpy(zero_copy_only=False)
    lens = number(pc.list_value_length(column("at"))).astype(np.int64)
    at, tf = (number(column(c).flatten()).astype(np.int64) for c in ("at", "tfs"))
    known = number(pc.is_valid(docs.field("place")))
    where = number(pc.fill_null(docs.field("place"), -1)).astype(np.int64)
    size = 1 + max(at.max(initial=0), where.max(initial=0))
    who, dl = np.full(size, -1), np.zeros(size)
    who[where[known]], dl[where[known]] = np.flatnonzero(known), number(pc.fill_null(docs.field("dl"), 0))[known]
    idf, avg = (np.repeat(number(column(c)), lens) for c in ("idf", "avg"))
    share = np.divide(dl[at], avg, out=np.zeros(len(at)), where=avg != 0)
    part = idf * (tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * share)))
    ends, at = np.r_[0, np.cumsum(lens)], who[at]
    out = {}
    for k, term in enumerate(column("term").to_pylist()):
        own, add = at[ends[k]:ends[k + 1]], part[ends[k]:ends[k + 1]]
        keep = own >= 0
        if keep.any():
            out[term] = own[keep], add[keep]
    return out


def _best_of_slice(k: int):
    def best(table: pa.Table) -> pa.Table:
        told = table.filter(pc.is_valid(table.column("docs"))).combine_chunks()
        if not told.num_rows:  # nothing of the slice is alive
            return pa.table({"query_id": pa.nulls(0, table.schema.field("queries").type.value_type.field("query_id").type), "key": pa.array([], pa.string()), "ft_score": pa.array([], pa.float64())})
        docs, queries = (told.column(c).combine_chunks().flatten() for c in ("docs", "queries"))
        docs = docs.take(pc.sort_indices(docs.field("key")))
        keys = docs.field("key").cast(pa.string())
        parts = parts_of(table.filter(pc.is_valid(table.column("term"))), docs)
        ids, need, asked = queries.field("query_id"), queries.field("need").to_pylist(), queries.field("terms").to_pylist()
        who, which, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for q, terms in enumerate(asked):
            score, held = np.zeros(len(keys)), np.zeros(len(keys), np.int32)
            for at, add in (parts[t] for t in terms if t in parts):
                score[at] += add
                held[at] += 1
            hit = np.flatnonzero(held >= need[q])
            hit = hit[np.lexsort((hit, -ticks(score[hit])))[:k]]
            who.append(np.full(len(hit), q))
            which.append(hit)
            scores.append(score[hit])
        return pa.table({"query_id": ids.take(pa.array(np.concatenate(who))), "key": keys.take(pa.array(np.concatenate(which))), "ft_score": pa.array(np.concatenate(scores))})

    return best


def _idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def _share(tf: Column, dl: Column, avg: Column) -> Column:
    """What a term adds for each unit of its idf; grows with tf, falls with dl, so a block's largest tf and smallest
    length bound it."""
    t = tf.cast("double")
    return t * F.lit(K1 + 1) / (t + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.coalesce(F.try_divide(dl.cast("double"), avg), F.lit(0.0))))
