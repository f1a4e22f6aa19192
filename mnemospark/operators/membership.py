"""Communities as rows of members, and components that are kept up to date.

A community is never one row with all its members: its id follows from a digest of them that does not depend on their
order (sums of hashes, so tasks add up what they have), and its summary from three names at most. Stored labels are
updated by the edges that came and went: added edges contract the labels they touch, and only components that lost an
edge are walked again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut
from . import graphs

SHOWN = 3


def digests(members: DataFrame, by: str) -> DataFrame:
    """(by, n_members, digest) of rows (by, entity_id), each member once: the number of members and two sums of 60-bit
    halves of their MD5."""
    half = lambda k: F.conv(F.substring(F.md5("entity_id"), k, 15), 16, 10).cast("decimal(20,0)")
    sums = members.groupBy(by).agg(F.count("*").alias("n_members"), F.sum(half(1)).cast("string").alias("x"), F.sum(half(16)).cast("string").alias("y"))
    text = F.concat_ws("-", F.col("n_members").cast("string"), "x", "y")
    return sums.select(by, "n_members", F.substring(F.sha2(text, 256), 1, 24).alias("digest"))


def members_of(labels: DataFrame) -> DataFrame:
    """Entities of components (node, component) with two entities or more: (community_id, component, entity_id)."""
    own = labels.where(F.col("node").startswith("entity:")).select("component", F.col("node").alias("entity_id"))
    named = digests(own, "component").where("n_members >= 2").select("component", F.concat(F.lit("community:"), "digest").alias("community_id"))
    return own.join(named, "component").select("community_id", "component", "entity_id")


def summaries(members: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(community_id, n_members, summary): the first three distinct names, or ids where an entity has none at all. Ranks
    stop at three in each task, before anything is moved."""
    shown = members.select("community_id", F.col("entity_id").alias("name"))
    if names is not None:
        own = members.join(names.select("entity_id", F.col("canonical_name").alias("name")), "entity_id").where("name IS NOT NULL").select("community_id", "name")
        bare = shown.join(own.select("community_id").distinct(), "community_id", "left_anti")
        shown = own.unionByName(bare)
    first = F.row_number().over(Window.partitionBy("community_id").orderBy("name"))
    few = shown.distinct().withColumn("_n", first).where(F.col("_n") <= SHOWN).groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "name"))), lambda x: x["name"]), ", ").alias("summary"))
    return members.groupBy("community_id").agg(F.count("*").alias("n_members")).join(few, "community_id")


def stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """stored: rows (community_id, entity_id); current: members_of() now. (community_id, reason): too_small with fewer than
    two members, drifted if no component has just these members."""
    now = current.select(F.regexp_replace("community_id", "^community:", "").alias("digest")).distinct().withColumn("there", F.lit(True))
    was = digests(stored.distinct(), "community_id")
    return was.join(now, "digest", "left").where((F.col("n_members") < 2) | F.col("there").isNull()).select("community_id", F.when(F.col("n_members") < 2, "too_small").otherwise("drifted").alias("reason"))


class ComponentStore:
    """Labels (node, component) under a folder, once in folders by node and once by component. An update reads and writes
    the folders of what it touches alone."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, c: str):
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _there(self, name: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _table(self, by: str) -> DataFrame:
        schema = "node string, component string, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{by}") if self._there(by) else self.spark.createDataFrame([], schema)

    def labels(self) -> DataFrame:
        return self._table("by_node").select("node", "component")

    def _folders(self, values: DataFrame, c: str) -> list[int]:
        return [r[0] for r in values.select(self._bucket(c).alias("b")).distinct().collect()]  # buckets at most

    def _of(self, values: DataFrame, c: str) -> DataFrame:
        """Labels whose node (component) is among values, from their folders."""
        t = self._table("by_node" if c == "node" else "by_component").where(F.col("bucket").isin(self._folders(values, c)))
        return t.join(values.select(c).distinct(), c, "left_semi").select("node", "component")

    def _write(self, gone: DataFrame, new: DataFrame) -> None:
        """Labels of the nodes in gone go, new ones come: folders that hold neither stay as they are."""
        for by, c in (("by_node", "node"), ("by_component", "component")):
            folders = sorted({*self._folders(gone, c), *self._folders(new, c)})
            old = self._table(by).where(F.col("bucket").isin(folders)).select("node", "component")
            rows = cut(old.join(gone.select("node"), "node", "left_anti").unionByName(new).withColumn("bucket", self._bucket(c)))
            have = [r[0] for r in rows.select("bucket").distinct().collect()]
            rows.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{by}")
            for b in set(folders) - set(have):  # a folder that has nothing left
                where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{by}/bucket={b}")
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def replace(self, labels: DataFrame) -> None:
        """All labels anew, after a rebuild."""
        for by, c in (("by_node", "node"), ("by_component", "component")):
            labels.select("node", "component", self._bucket(c).alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{by}")

    def update(self, edges: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
        """edges: those that hold now, with the added and without the removed ones; each (in_id, out_id). Returns the labels
        that came or changed. The labels are then those of components(edges)."""
        ends = lambda e: e.select(F.col("in_id").alias("node")).union(e.select(F.col("out_id").alias("node"))).distinct()
        none = self.spark.createDataFrame([], "node string, component string")
        lost = walked = none
        if removed is not None:
            hit = self._of(cut(ends(removed)), "node").select("component").distinct()
            lost = cut(self._of(cut(hit), "component"))  # nodes of the components that lost an edge
            inside = edges.select("in_id", "out_id").join(lost.select(F.col("node").alias("in_id")), "in_id", "left_semi")
            walked = cut(graphs.components(inside))
        touched = cut(ends(added))
        known = self._of(touched, "node").join(lost.select("node"), "node", "left_anti").unionByName(walked.join(touched, "node", "left_semi"))
        label = cut(touched.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
        step = lambda c, to: label.select(F.col("node").alias(c), F.col("component").alias(to))
        contracted = added.select("in_id", "out_id").join(step("in_id", "a"), "in_id").join(step("out_id", "b"), "out_id").select(F.col("a").alias("in_id"), F.col("b").alias("out_id")).distinct()
        merged = cut(graphs.components(contracted).select(F.col("node").alias("component"), F.col("component").alias("into")))
        moved = self._of(merged, "component").join(lost.select("node"), "node", "left_anti")
        rows = moved.unionByName(walked).unionByName(label).distinct().join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
        rows = cut(rows.distinct())
        gone = cut(lost.select("node").unionByName(moved.select("node")).unionByName(rows.select("node")).distinct())
        # labels lie by component as well: what leaves a component leaves its folder there
        before = cut(self._of(gone, "node"))
        self._write(before, rows)
        return rows
