"""Exact top-k search by inner product over KD-trees.

The upper levels of one KD-tree deal the vectors to shards: median splits of a bounded sample along the widest
dimension, and hash parts where one leaf holds more than a shard should (many equal vectors). Each shard is a
KD-tree of its own with a tight bounding box for every node. A query walks a tree best first: the box gives the
highest inner product that any vector in it can have, and a box below the query's k-th score so far is not
opened (an equal one is, since ties go to the smaller id). Each query first meets the shard that holds it; the
k-th score found there goes along, and only to those shards whose box can reach it.

A task reads the vectors of a shard once and then streams the queries that come to it, so vectors are never
copied and memory does not grow with the number of queries.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, table

#: Vectors of a shard, about; there are LEAST_SHARDS of them at least. Vectors of the sample for each shard.
SHARD_ROWS, LEAST_SHARDS, LEAF, SAMPLE_PER_SHARD = 100_000, 32, 256, 64
#: Vectors of the sample at most, and bytes of all boxes up to which they are broadcast.
SAMPLE_ROWS, BOX_BYTES = 200_000, 256 << 20
_INT64 = np.iinfo(np.int64)


class KDTree:
    """points: integer vectors as float64, int64 or (where products pass 64 bits) object rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        self.lo, self.hi, self.span, self.kids = [], [], [], []
        if len(points):
            self._grow(0, len(points), leaf)
        self.points = points[self.order]

    def _grow(self, a: int, b: int, leaf: int) -> int:
        own = self.points[self.order[a:b]]
        node = len(self.lo)
        lo, hi = own.min(0), own.max(0)
        self.lo.append(lo)
        self.hi.append(hi)
        self.span.append((a, b))
        self.kids.append(None)
        if b - a > leaf and (hi > lo).any():
            axis, mid = int(np.argmax(hi - lo)), (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argsort(own[:, axis], kind="stable") if own.dtype == object else np.argpartition(own[:, axis], mid)]
            self.kids[node] = self._grow(a, a + mid, leaf), self._grow(a + mid, b, leaf)
        return node

    def bound(self, node: int, q: np.ndarray):
        """The highest inner product of q with a point of the node's box."""
        up = np.maximum(q * self.lo[node], q * self.hi[node]).sum()
        return min(max(up, _INT64.min), _INT64.max) if self.points.dtype == object else up

    def search(self, q: np.ndarray, k: int, ids: np.ndarray, own: np.ndarray, me: int, floor):
        """The k best (score, id), ties to the smaller id, of points whose `own` is not me and whose score is
        floor or more. ids and own are in the order of self.points."""
        best_s, best_i = np.zeros(0, np.int64 if self.points.dtype == object else self.points.dtype), np.zeros(0, np.int64)
        heap = [(-self.bound(0, q), 0)] if self.lo else []
        while heap and -heap[0][0] >= floor:
            node = heapq.heappop(heap)[1]
            if self.kids[node]:
                for kid in self.kids[node]:
                    up = self.bound(kid, q)
                    if up >= floor:
                        heapq.heappush(heap, (-up, kid))
                continue
            a, b = self.span[node]
            s = self.points[a:b] @ q
            if s.dtype == object:  # beyond 64 bits all scores are alike
                s = np.array([min(max(x, _INT64.min), _INT64.max) for x in s], np.int64)
            hit = np.flatnonzero((s >= floor) & (own[a:b] != me))
            if len(hit):
                best_s, best_i = np.concatenate([best_s, s[hit]]), np.concatenate([best_i, ids[a:b][hit]])
                top = np.lexsort((best_i, -best_s))[:k]
                best_s, best_i = best_s[top], best_i[top]
                if len(top) == k:
                    floor = max(floor, best_s[-1])
        return best_s, best_i


def _matrix(column) -> np.ndarray:
    """int64 rows of a list column whose lists have one length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1), np.int64)


def _exact(v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which their inner products are exact: float64 if those stay below 2^53, int64 below 2^63,
    else Python's integers."""
    most = float(np.abs(v.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * max(1, v.shape[1])
    kind = float if most < 2**53 else np.int64 if most < 2**62 else object
    return v.astype(kind), q.astype(kind)


class TopTree:
    """The upper levels: median splits of a sample until each leaf is one of about n_leaves shards."""

    def __init__(self, sample: np.ndarray, n_leaves: int):
        self.axis, self.at, self.kids = [], [], []
        self.leaves = 0
        self._grow(sample.astype(float), n_leaves)

    def _grow(self, rows: np.ndarray, n: int) -> int:
        me = len(self.axis)
        self.axis.append(0)
        self.at.append(0.0)
        self.kids.append(None)
        spread = rows.max(0) - rows.min(0) if len(rows) > 1 else np.zeros(1)
        if n > 1 and spread.max() > 0:
            axis = int(np.argmax(spread))
            at = float(np.median(rows[:, axis]))
            low = rows[:, axis] <= at
            if low.all():  # many equal ones at the top: they part from the rest
                low = rows[:, axis] < at
                at = float(np.nextafter(at, -np.inf))
            self.axis[me], self.at[me] = axis, at
            self.kids[me] = (self._grow(rows[low], n // 2), self._grow(rows[~low], n - n // 2))
        else:
            self.kids[me] = -1 - self.leaves
            self.leaves += 1
        return me

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(self.kids[node], int):
                out[rows] = -1 - self.kids[node]
            elif len(rows):
                low = points[rows, self.axis[node]] <= self.at[node]
                todo += [(self.kids[node][0], rows[low]), (self.kids[node][1], rows[~low])]
        return out


def _by_length(column) -> dict[int, np.ndarray]:
    """Rows of a list column by the length of their lists."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    return {int(d): np.flatnonzero(n == d) for d in np.unique(n)}


def _placed(rows: DataFrame, n: int, shard_rows: int, least: int, seed: int) -> DataFrame:
    """rows with leaf (of the upper levels) and part (of a leaf that holds more than a shard should)."""
    shards = max(least, -(-n // shard_rows))
    want = min(SAMPLE_ROWS, shards * SAMPLE_PER_SHARD)
    rate = min(1.0, want / max(1, n))
    h = F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(1 << 40))
    sample: dict[int, list] = {}
    for r in rows.where(h < int(rate * (1 << 40))).select("v").collect():  # about SAMPLE_ROWS at most
        sample.setdefault(len(r["v"]), []).append(r["v"])
    trees = {d: TopTree(np.array(v, np.int64).reshape(len(v), -1), max(1, round(shards * len(v) / sum(map(len, sample.values()))))) for d, v in sample.items() if d}
    shared = rows.sparkSession.sparkContext.broadcast(trees)  # two numbers per shard

    def run(batches):
        for batch in batches:
            v, leaf = batch.column("v"), np.zeros(batch.num_rows, np.int32)
            for d, own in _by_length(v).items():
                if d in shared.value:
                    leaf[own] = shared.value[d].leaf_of(_matrix(v.take(pa.array(own))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    dealt = cut(rows.withColumn("dim", F.size("v")).mapInArrow(run, "vec_id long, v array<bigint>, is_query boolean, row long, dim int, leaf int"))
    sizes = dealt.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / float(shard_rows)).cast("int").alias("parts"))  # a row per leaf
    # a table of a few rows per shard
    return dealt.join(F.broadcast(sizes), ["dim", "leaf"]).withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "row"), F.col("parts")).cast("int")).drop("parts")


def _boxes(placed: DataFrame) -> DataFrame:
    """One row per shard: dim, leaf, part, lo and hi, the corners of its box. Tasks send one row per shard."""
    schema = "dim int, leaf int, part int, lo array<bigint>, hi array<bigint>"

    def corners(batches):
        found: dict[tuple, tuple] = {}
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("dim", "leaf", "part")], 1)
            lo, hi = batch.column("lo"), batch.column("hi")
            kinds, of = np.unique(key, axis=0, return_inverse=True)
            for i, k in enumerate(kinds.tolist()):
                own = pa.array(np.flatnonzero(of.ravel() == i))
                a, b = _matrix(lo.take(own)).min(0), _matrix(hi.take(own)).max(0)
                if tuple(k) in found:
                    x, y = found[tuple(k)]
                    a, b = np.minimum(a, x), np.maximum(b, y)
                found[tuple(k)] = a, b
        keys = np.array(list(found), np.int32).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, j]) for j in range(3)), pa.array([list(x[0]) for x in found.values()], pa.list_(pa.int64())),
                                          pa.array([list(x[1]) for x in found.values()], pa.list_(pa.int64()))], names=["dim", "leaf", "part", "lo", "hi"])

    points = placed.where("dim > 0").select("dim", "leaf", "part", F.col("v").alias("lo"), F.col("v").alias("hi"))
    return points.mapInArrow(corners, schema).repartition("dim", "leaf", "part").mapInArrow(corners, schema)


def _search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each query among the vectors of the shards it comes to. A task holds one shard's vectors; they
    come before the queries, which pass in batches."""
    names = ["dim", "leaf", "part", "asks", "row", "vec_id", "v", "floor"]
    both = vectors.select("dim", "leaf", "part", F.lit(False).alias("asks"), "row", "vec_id", "v", F.lit(None).cast("long").alias("floor")).unionByName(queries.withColumn("asks", F.lit(True)).select(*names))
    dealt = both.repartition("dim", "leaf", "part").sortWithinPartitions("dim", "leaf", "part", "asks")

    def run(batches):
        shard, held, tree = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "leaf", "part", "asks")], 1).astype(np.int64) if batch.num_rows else np.zeros((0, 4), np.int64)
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1), True]) if len(key) else [0]
            for a, b in zip(cuts, cuts[1:]):
                own = batch.slice(a, b - a)
                if tuple(key[a][:3]) != shard:
                    shard, held, tree = tuple(key[a][:3]), [], None
                if not key[a][3]:
                    held.append((_matrix(own.column("v")) if key[a][0] else np.zeros((b - a, 0), np.int64), own.column("vec_id").to_numpy(), own.column("row").to_numpy()))
                    continue
                if not held:
                    continue
                q = _matrix(own.column("v")) if key[a][0] else np.zeros((b - a, 0), np.int64)
                if tree is None:
                    v, ids, rows = (np.concatenate(x) for x in zip(*held))
                    held = [(v, ids, rows)]
                    kind = None
                v2, q2 = _exact(held[0][0], q)
                if kind is None or tree is None or v2.dtype != kind:
                    tree, kind = KDTree(v2), v2.dtype
                    ids, rows = held[0][1][tree.order], held[0][2][tree.order]
                out = [[], [], [], []]
                for x, me, name, floor in zip(q2, own.column("row").to_numpy(), own.column("vec_id").to_numpy(), own.column("floor").to_pylist()):
                    s, i = tree.search(x, k, ids, rows, me, -np.inf if floor is None else floor)
                    out[0] += [me] * len(s)
                    out[1] += [name] * len(s)
                    out[2] += i.tolist()
                    out[3] += s.astype(np.int64).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["q_row", "query_id", "vec_id", "score"])
        del held, tree
        give_back()

    return dealt.mapInArrow(run, "q_row long, query_id long, vec_id long, score long")


def _reached(queries: DataFrame, boxes: DataFrame) -> DataFrame:
    """queries (row, vec_id, v, dim, home leaf and part, floor) once for each other shard of their dimension whose
    box reaches their floor. Boxes are broadcast if they are within BOX_BYTES; beyond, they meet the queries of
    their dimension in shards of boxes, one join, with the same test."""
    boxes = cut(boxes)
    size = boxes.agg(F.sum(F.lit(64) + F.size("lo") * 16)).first()[0] or 0
    if size > BOX_BYTES:
        far = boxes.select(F.col("dim").alias("d"), F.col("leaf").alias("l"), F.col("part").alias("p"), "lo", "hi")
        up = F.aggregate(F.zip_with("v", F.arrays_zip("lo", "hi"), lambda x, c: F.greatest(x.cast("double") * c["lo"], x.cast("double") * c["hi"])), F.lit(0.0), lambda s, x: s + x)
        met = queries.join(far, (F.col("dim") == F.col("d")) & ~((F.col("leaf") == F.col("l")) & (F.col("part") == F.col("p"))))
        return (met.where(F.col("floor").isNull() | (F.col("floor") == int(_INT64.min)) | (up * (1 + 1e-9 * F.signum(up)) + 1 >= F.col("floor")))
                .select("row", "vec_id", "v", "dim", F.col("l").alias("leaf"), F.col("p").alias("part"), "floor"))
    sides: dict[int, tuple] = {}
    by_dim: dict[int, list] = {}
    for r in boxes.collect():
        by_dim.setdefault(r["dim"], []).append(r)
    for d, rs in by_dim.items():
        sides[d] = (np.array([(r["leaf"], r["part"]) for r in rs], np.int32), np.array([r["lo"] for r in rs], float), np.array([r["hi"] for r in rs], float))
    shared = queries.sparkSession.sparkContext.broadcast(sides)

    def run(batches):
        for batch in batches:
            column = batch.column("v")
            for d, own in _by_length(column).items():
                if d not in shared.value:
                    continue
                names, lo, hi = shared.value[d]
                at = pa.array(own)
                part = batch.take(at)
                q = _matrix(part.column("v")).astype(float)
                floor = np.array([-np.inf if f is None or f == _INT64.min else f for f in part.column("floor").to_pylist()], float)
                home = np.stack([part.column("leaf").to_numpy(), part.column("part").to_numpy()], 1)
                for a in range(0, len(q), 256):
                    x = q[a:a + 256]
                    # the larger corner of each dimension: positive parts meet hi, negative ones lo
                    up = np.maximum(x, 0) @ hi.T + np.minimum(x, 0) @ lo.T
                    slack = 1e-9 * (np.abs(x) @ np.maximum(np.abs(hi), np.abs(lo)).T) + 1  # rounding never hides a shard
                    go = (up + slack >= floor[a:a + 256, None]) & ~(home[a:a + 256, None, :] == names[None]).all(2)
                    i, j = np.nonzero(go)
                    some = part.take(pa.array(i + a))
                    yield pa.RecordBatch.from_arrays([some.column("row"), some.column("vec_id"), some.column("v"), some.column("dim"), pa.array(names[j, 0]), pa.array(names[j, 1]), some.column("floor")],
                                                     names=["row", "vec_id", "v", "dim", "leaf", "part", "floor"])

    return queries.select("row", "vec_id", "v", "dim", "leaf", "part", "floor").mapInArrow(run, "row long, vec_id long, v array<bigint>, dim int, leaf int, part int, floor long")


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, shard_rows: int = SHARD_ROWS, least_shards: int = LEAST_SHARDS, seed: int = 3) -> DataFrame:
    """For each row of vectors (vec_id long, embedding array) where is_query holds, the k rows with the
    highest integer inner product of floor(scale * x): query_id, rank (from 1), vec_id, score.

    Vectors that are null or hold a null or non-finite component take no part; an empty vector has score 0
    with other empty ones; only vectors of one length are compared. Components beyond 64 bits count as the
    nearest 64-bit number; inner products are exact, and those beyond 64 bits count as the nearest 64-bit number
    (ties among them go to the smaller id, as all do). A row is never its own neighbour, another row with the same id can be. Repeated
    query rows repeat their results. Fewer than k others: all of them. An empty table gives an empty result.
    Extra columns are not read.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = cut(vectors.where(usable & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
               .withColumn("row", F.monotonically_increasing_id()))
    placed = cut(_placed(rows, rows.count(), shard_rows, least_shards, seed))
    queries = placed.where("is_query").withColumn("floor", F.lit(None).cast("long"))
    home = cut(_search(placed, queries, k))
    kth = home.groupBy("q_row").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("q_row").alias("row"), "kth")
    away = _reached(queries.drop("floor").join(kth, "row", "left").withColumnRenamed("kth", "floor"), _boxes(placed))
    found = home.unionByName(_search(placed, away, k))
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
