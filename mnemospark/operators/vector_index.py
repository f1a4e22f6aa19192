"""A stored vector index: a coarse quantiser, product-quantised residuals, exact re-ranking.

A model (centres of cells, codebooks of residuals) is fitted on a bounded sample; every vector is then written to the
folder of its nearest cell as a code of a byte for each few components. A query reads the folders of its nearest cells,
ranks their codes by a table of inner products, and scores the best of them exactly by their vectors. Vectors are
normalised, so inner products are cosines.

Large cells are cut in parts of about part_rows, so what a task holds is bounded whatever the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut
from ..functions.vector import cosine
from . import semantic

#: Rows and bytes of the sample at most; rounds of k-means; values of a code.
SAMPLE_ROWS, SAMPLE_BYTES, ROUNDS, CODES = 65_536, 64 << 20, 8, 256


def _unit(column, dims: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).astype(float)
    v = flat.reshape(-1, dims)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _nearest(points: np.ndarray, centres: np.ndarray, block: int = 4_096) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([(half - points[a:a + block] @ centres.T).argmin(1) for a in range(0, len(points), block)]) if len(points) else np.zeros(0, int)


def _k_means(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """At most k centres; empty ones stay where they were."""
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(ROUNDS):
        near = _nearest(points, centres)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


class Quantiser:
    """centres: (cells, dims); books: (subspaces, codes, width), the last one padded where dims do not divide."""

    def __init__(self, centres: np.ndarray, books: np.ndarray):
        self.centres, self.books = centres, books

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, width: int, seed: int = 0) -> "Quantiser":
        rng = np.random.default_rng(seed)
        centres = _k_means(sample, cells, rng)
        rest = cls._split(sample - centres[_nearest(sample, centres)], width)
        books = [_k_means(rest[:, s], CODES, rng) for s in range(rest.shape[1])]
        return cls(centres, np.stack(books))

    @staticmethod
    def _split(v: np.ndarray, width: int) -> np.ndarray:
        parts = -(-v.shape[1] // width)
        return np.pad(v, ((0, 0), (0, parts * width - v.shape[1]))).reshape(len(v), parts, width)

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(v, self.centres)
        rest = self._split(v - self.centres[cell], self.books.shape[2])
        return cell, np.stack([_nearest(rest[:, s], book) for s, book in enumerate(self.books)], 1).astype(np.uint8)

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products (queries, codes) with the vectors of one cell."""
        table = np.einsum("qsw,scw->qsc", self._split(q, self.books.shape[2]), self.books)
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), 1)
        for s in range(codes.shape[1]):
            out += table[:, s, codes[:, s]]
        return out


class VectorIndex:
    """Under a folder that every executor reaches. Vectors that are null, of another length, or hold a null or
    non-finite component are not indexed. A key that is added again is there twice until the index is made anew."""

    def __init__(self, spark: SparkSession, path: str, part_rows: int = 50_000):
        self.spark, self.path, self.part_rows = spark, path.rstrip("/"), part_rows

    def _there(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        where, fs = self._there("model")
        return fs.exists(where)

    def drop(self) -> None:
        where, fs = self._there("")
        fs.delete(where, True)

    @staticmethod
    def _usable(rows: DataFrame, vector: str, dims: int) -> DataFrame:
        good = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
        return rows.where(F.col(vector).isNotNull() & (F.size(vector) == dims) & F.forall(vector, good))

    def create(self, rows: DataFrame, key: str, vector: str, dims: int, cells: int | None = None, width: int = 4) -> None:
        """Fits the model on a sample (by hash of the key) and indexes all rows. cells: about the root of the sample."""
        self.drop()
        good = self._usable(rows, vector, dims)
        most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)))
        got = good.select(F.transform(vector, lambda x: x.cast("double")).alias("v")).orderBy(F.xxhash64("v")).limit(most).collect()  # bounded in rows and bytes
        sample = np.array([r["v"] for r in got], float).reshape(-1, dims)
        if not len(sample):
            sample = np.ones((1, dims))
        sample /= np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
        q = Quantiser.fit(sample, cells or max(1, int(len(sample) ** 0.5)), width)
        kind = rows.schema[key].dataType.simpleString()
        model = [(kind, dims, q.centres.shape[0], q.books.shape[1], width, q.centres.ravel().tolist(), q.books.ravel().tolist())]
        self.spark.createDataFrame(model, "kind string, dims int, cells int, codes int, width int, centres array<double>, books array<double>").coalesce(1).write.parquet(f"{self.path}/model")
        self.add(rows, key, vector)

    def _model(self) -> tuple[Quantiser, int]:
        m = self.spark.read.parquet(f"{self.path}/model").first()
        return Quantiser(np.array(m["centres"]).reshape(m["cells"], m["dims"]), np.array(m["books"]).reshape(-1, m["codes"], m["width"])), m["dims"]

    def add(self, rows: DataFrame, key: str, vector: str) -> None:
        model, dims = self._model()

        def encode(batches):
            for b in batches:
                cell, codes = model.encode(_unit(b.column(1), dims))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell.astype(np.int32))], names=["key", "code", "cell"])

        kind = rows.schema[key].dataType.simpleString()
        coded = self._usable(rows, vector, dims).select(F.col(key).alias("key"), vector).mapInArrow(encode, f"key {kind}, code binary, cell int")
        coded.repartitionByRange("cell", F.xxhash64("key")).write.partitionBy("cell").mode("append").parquet(f"{self.path}/codes")

    def codes(self) -> DataFrame:
        kind = self.spark.read.parquet(f"{self.path}/model").first()["kind"]
        schema = f"key {kind}, code binary, cell int"
        where, fs = self._there("codes")
        return self.spark.read.schema(schema).parquet(f"{self.path}/codes") if fs.exists(where) else self.spark.createDataFrame([], schema)

    def search(self, rows: DataFrame, query: list[float], k: int, key: str, vector: str = "embedding", probes: int = 8, candidates: int = 20, exact: bool = False) -> DataFrame:
        """The k rows most similar to a query, with sem_score; rows: those that may be found (filters come before the cut).
        Only the folders of `probes` cells are read; candidates * k codes are scored by their vectors. exact: all rows are
        scored, without the index."""
        if exact:
            return semantic.top_k(rows, query, k, key)
        model, dims = self._model()
        q = _unit(pa.array([query], pa.list_(pa.float64())), dims)
        cells = np.argsort(-(q @ model.centres.T)[0], kind="stable")[:probes]
        near = self.codes().where(F.col("cell").isin([int(c) for c in cells]))
        near = near.join(rows.select(F.col(key).alias("key")), "key", "left_semi")

        def rate(batches):
            for b in batches:
                cell, codes = b.column("cell").to_numpy(), np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                score = np.zeros(b.num_rows)
                for c in np.unique(cell):
                    score[cell == c] = model.scores(q, c, codes[cell == c])[0]
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(score)], names=["key", "near"])

        kind = rows.schema[key].dataType.simpleString()
        few = near.select("key", "code", "cell").mapInArrow(rate, f"key {kind}, near double").orderBy(F.col("near").desc(), "key").limit(candidates * k)
        return semantic.top_k(rows.join(F.broadcast(few.select(F.col("key").alias(key))), key, "left_semi"), query, k, key)

    def search_batch(self, queries: DataFrame, rows: DataFrame, k: int, key: str, vector: str = "embedding", probes: int = 8, candidates: int = 20) -> DataFrame:
        """queries: query_id, vector. (query_id, key, sem_score, rank from 1) in one plan: queries go to the parts of their
        cells, each part gives its best, and the best of all parts are scored exactly."""
        model, dims = self._model()
        qid, kind = queries.schema["query_id"].dataType.simpleString(), rows.schema[key].dataType.simpleString()
        most = candidates * k

        def route(batches):
            for b in batches:
                v = _unit(b.column("vector"), dims)
                cells = np.argsort(-(v @ model.centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                at = pa.array(np.repeat(np.arange(len(v)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("vector").take(at), pa.array(cells.ravel())], names=["query_id", "vector", "cell"])

        asked = self._usable(queries, "vector", dims).select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
        routed = asked.mapInArrow(route, f"query_id {qid}, vector array<double>, cell int")
        stored = self.codes().join(rows.select(F.col(key).alias("key")), "key", "left_semi")
        parts = cut(stored.groupBy("cell").agg(F.ceil(F.count("*") / self.part_rows).cast("int").alias("parts")))  # a row for each cell
        stored = stored.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"), "key", "code")
        routed = routed.join(F.broadcast(parts), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "vector")

        def rate(_, codes, asked):
            keys, q = codes.column("key").combine_chunks(), _unit(asked.column("vector"), dims) if asked.num_rows else np.zeros((0, dims))
            ids, code = asked.column("query_id").combine_chunks(), np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(codes.num_rows, -1)
            out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
            for at in range(0, len(q) if codes.num_rows else 0, 16):
                score = model.scores(q[at:at + 16], codes.column("cell")[0].as_py(), code)
                for i, row in enumerate(score, at):
                    top = np.argpartition(-row, most)[:most] if len(row) > most else np.arange(len(row))
                    out.append((np.full(len(top), i), top, row[top]))
            i, top, score = (np.concatenate(x) for x in zip(*out))
            return pa.table({"query_id": ids.take(pa.array(i)), "key": keys.take(pa.array(top)), "near": pa.array(score)})

        found = stored.groupBy("cell", "part").cogroup(routed.groupBy("cell", "part")).applyInArrow(rate, f"query_id {qid}, key {kind}, near double")
        w = Window.partitionBy("query_id").orderBy(F.col("near").desc(), "key")
        few = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select("query_id", "key")
        both = few.join(rows.select(F.col(key).alias("key"), F.col(vector).alias("_x")), "key").join(asked, "query_id")
        scored = both.select("query_id", "key", F.round(cosine(F.col("_x"), F.col("vector")), 9).alias("sem_score"))
        best = Window.partitionBy("query_id").orderBy(F.col("sem_score").desc(), "key")
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
