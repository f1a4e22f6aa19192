"""Centroid clustering (Lloyd's rounds over integer vectors) by ball-tree filtering.

Each task puts its vectors in metric trees of at most TREE_ROWS vectors: a node stores the radius of a ball around
its mean, the count and the integer sum of its vectors. Trees are built once and written to the shared folder; a
round reads them with the centroids (k of them, so a bound size). From the root down, the triangle inequality drops
centroids that are farther from every vector of the ball than another one is; a ball with one centroid left goes to
it as a whole, by its count and sum, and the vectors of a leaf that keeps several are compared exactly. What leaves a
task in a round is one sum for each centroid and component, whatever the number of vectors.

Distances are integers: they are computed in float64 where every step stays below 2^53, else in int64, so both give
the same numbers. Bounds of balls are floating point with a margin; a bound that is too close to tell descends.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, short_batches, table, unused, written

#: Vectors of a tree and of a leaf, at most.
TREE_ROWS, LEAF = 8_192, 32
MARGIN = 1e-9
_MOST = (1 << 63) - 1


def component_limit(dims: int) -> int:
    """The largest power of two to which components are clamped: squared distances then fit a long."""
    return 1 << ((62 - math.ceil(math.log2(max(dims, 1)))) // 2 - 1)


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact int64 matrix; both int64 and within component_limit."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * points.shape[1] * most * most < 2**53:
        p, c = points.astype(float), centroids.astype(float)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], 1)


class BallTree:
    """Nodes in order of creation: span in points, children (0: a leaf), radius, integer sum. order: places of the
    rows that were given."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        span, kids, radii, sums, todo = [], [], [], [], [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            me, own = len(span), points[self.order[a:b]]
            if parent >= 0:
                kids[parent][side] = me
            total = own.sum(0)
            off = own - total / (b - a)
            span.append((a, b))
            kids.append([0, 0])
            sums.append(total)
            radii.append(math.sqrt(float((off * off).sum(1).max())) * (1 + MARGIN) + MARGIN)
            spread = own.max(0) - own.min(0)
            if b - a > leaf and spread.max() > 0:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, int(spread.argmax())], mid)]
                todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.points = points[self.order]
        self.span, self.kids = np.array(span, np.int32), np.array(kids, np.int32)
        self.radii, self.sums = np.array(radii), np.array(sums, np.int64)

    def dump(self) -> dict[str, bytes]:
        return {"points": self.points.astype("<i4").tobytes(), "shape": np.c_[self.span, self.kids].astype("<i4").tobytes(),
                "radii": self.radii.astype("<f8").tobytes(), "sums": self.sums.astype("<i8").tobytes()}

    @classmethod
    def load(cls, row: dict, dims: int) -> "BallTree":
        self = cls.__new__(cls)
        self.points = np.frombuffer(row["points"], "<i4").reshape(-1, dims).astype(np.int64)
        shape = np.frombuffer(row["shape"], "<i4").reshape(-1, 4)
        self.span, self.kids = shape[:, :2], shape[:, 2:]
        self.radii, self.sums = np.frombuffer(row["radii"], "<f8"), np.frombuffer(row["sums"], "<i8").reshape(-1, dims)
        return self

    def assign(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """(node, centroid) of balls that go as a whole; places of all other points and their nearest centroids."""
        whole, loose = [], []
        level, alive = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        c = centroids.astype(float)
        while len(level):
            counts = (self.span[level, 1] - self.span[level, 0]).astype(float)
            means = self.sums[level] / counts[:, None]
            d = np.sqrt(((means[:, None, :] - c[None, :, :]) ** 2).sum(2))
            r = self.radii[level][:, None]
            far = np.where(alive, d + r, np.inf).min(1)[:, None]
            alive &= d - r <= far + MARGIN * (1 + far)
            one = alive.sum(1) == 1
            whole += zip(level[one].tolist(), alive[one].argmax(1).tolist())
            leaf = ~one & (self.kids[level, 0] == 0)
            loose += [np.arange(*self.span[n]) for n in level[leaf]]
            deep = ~one & ~leaf
            level, alive = self.kids[level[deep]].ravel().astype(np.int64), np.repeat(alive[deep], 2, 0)
        places = np.concatenate(loose) if loose else np.zeros(0, np.int64)
        return whole, places, squared_distances(self.points[places], centroids).argmin(1) if len(places) else places

    def totals(self, centroids: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        """Adds what each centroid gets to counts and sums."""
        whole, places, near = self.assign(centroids)
        for node, k in whole:
            counts[k] += self.span[node, 1] - self.span[node, 0]
            sums[k] += self.sums[node]
        if len(places):
            counts += np.bincount(near, minlength=len(counts))
            np.add.at(sums, near, self.points[places])

    def labels(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid and squared distance of every point."""
        whole, places, near = self.assign(centroids)
        label = np.zeros(len(self.points), np.int32)
        label[places] = near
        for node, k in whole:
            label[self.span[node, 0]:self.span[node, 1]] = k
        distance = np.zeros(len(label), np.int64)
        for k in np.unique(label):
            own = label == k
            distance[own] = squared_distances(self.points[own], centroids[k:k + 1])[:, 0]
        return label, distance


def kept_vectors(rows: DataFrame, vec_id: str, vector: str, dims: int) -> DataFrame:
    """(vec_id, x): vectors with exactly dims components, none null or non-finite, as integers floor(256 * component),
    clamped to component_limit(dims)."""
    limit = float(component_limit(dims))
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    whole = lambda c: F.floor(F.greatest(F.least(F.lit(256.0) * c.cast("double"), F.lit(limit)), F.lit(-limit)))
    good = F.col(vector).isNotNull() & (F.size(vector) == dims) & F.forall(vector, finite)
    return rows.where(good).select(F.col(vec_id).alias("vec_id"), F.transform(vector, whole).alias("x"))


def ball_trees(kept: DataFrame, dims: int, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Rows of one tree each: ids (in the order of its points) and its parts; written once, read in every round."""
    kind = kept.schema["vec_id"].dataType.simpleString()

    def build(batches):
        held, n = [], 0

        def tree(parts: pa.Table) -> pa.RecordBatch:
            flat = parts.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            one = BallTree(flat.reshape(-1, dims))
            ids = parts.column("vec_id").combine_chunks().take(pa.array(one.order))
            parts = one.dump()
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[pa.array([parts[c]], pa.binary()) for c in ("points", "shape", "radii", "sums")]],
                                              names=["ids", "points", "shape", "radii", "sums"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= tree_rows:
                whole = pa.Table.from_batches(held)
                yield tree(whole.slice(0, tree_rows))
                held, n = whole.slice(tree_rows).to_batches(), n - tree_rows
        if n:
            yield tree(pa.Table.from_batches(held))
        give_back()

    short_batches(kept.sparkSession)
    return written(kept.mapInArrow(build, f"ids array<{kind}>, points binary, shape binary, radii binary, sums binary"), "balls")


def _round(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: exact floor of the mean of each one's vectors; one without vectors stays."""
    k, dims = centroids.shape

    def totals(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for row in batch.select(["points", "shape", "radii", "sums"]).to_pylist():
                BallTree.load(row, dims).totals(centroids, counts, sums)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dims + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, dims), len(some)).astype(np.int32)),
                                          pa.array(np.c_[counts, sums][some].ravel())], names=["cluster", "pos", "value"])

    # pos -1 is the count; k * (dims + 1) rows reach the driver
    got = trees.mapInArrow(totals, "cluster int, pos int, value long").groupBy("cluster", "pos").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    value = {(r["cluster"], r["pos"]): int(r["value"]) for r in got}
    return np.array([[value[c, p] // value[c, -1] for p in range(dims)] if (c, -1) in value else centroids[c] for c in range(k)], np.int64)


_RESULT = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def centroid_clusters(rows: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length, or hold a null or non-finite component take no part. A component whose
    integer passes component_limit(dims) (2^27 for 64) is clamped to it; sums of distances saturate at the largest long.
    Repeated rows are vectors like any other; a null vec_id is hashed as the empty text. Ties among the hashes that
    choose the first centroids go to the smaller vector. With fewer than k kept vectors each is a centroid; without
    any, or in an empty table, the result is empty. Other columns are not read.
    """
    spark = rows.sparkSession
    kept = kept_vectors(rows, vec_id, vector, dims)
    kind = kept.schema["vec_id"].dataType.simpleString()
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(key.alias("h"), "x").orderBy("h", "x").limit(k).collect()  # k vectors
    if not first:
        return spark.createDataFrame([], f"vec_id {kind}, {_RESULT}")
    centroids = np.array([r["x"] for r in first], np.int64)
    trees = ball_trees(kept, dims)
    for _ in range(rounds):
        centroids = _round(trees, centroids)

    def label(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                ids, parts = batch.column("ids")[at].values, batch.slice(at, 1).select(["points", "shape", "radii", "sums"]).to_pylist()[0]
                near, distance = BallTree.load(parts, dims).labels(centroids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(near), pa.array(distance)], names=["vec_id", "cluster", "distance"])
        give_back()

    assigned = written(trees.mapInArrow(label, f"vec_id {kind}, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    total = min(sum(inertia.values()), _MOST)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    (cluster,) = unused(assigned, "cluster")
    of_cluster = spark.createDataFrame([(c, min(inertia.get(c, 0), _MOST), total, sha[c]) for c in range(len(centroids))], f"{cluster} int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), F.col("cluster") == F.col(cluster)).drop(cluster)  # k rows are broadcast


def op11_clustering(spark, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _sql(k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2) -> str:
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256::DOUBLE * c) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v.x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, c{r}.c, list_sum(list_transform(list_zip(v.x, c{r}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
  FROM v, c{r}) JOIN v USING (vec_id) GROUP BY vec_id, v.x)""")
        if r < rounds:
            parts.append(f"""m{r} AS MATERIALIZED (SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY pos) AS x FROM (SELECT c, pos, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS pos FROM a{r}) GROUP BY c, pos) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(a{rounds}.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""


OP11_SQL = _sql()
