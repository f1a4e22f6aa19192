"""Graph operators over edge tables (in_id, relation, out_id). Loops run over frontiers, one equi-join per
level, each level cut by a checkpoint; the driver sees counts only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, temporal
from ..runtime import cut, travels

travels(__name__)


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str, cutoff=None) -> DataFrame:
    """Edges at nodes (node): incoming have it as out_id, outgoing as in_id. Rows (node, neighbour, edge)."""
    own, other = ("out_id", "in_id") if direction == "incoming" else ("in_id", "out_id")
    active = edges.where(temporal.active_at(cutoff)) if cutoff is not None else edges
    return active.join(nodes.select(F.col("node").alias(own)), own).withColumns({"node": F.col(own), "neighbour": F.col(other)})


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in either direction: (src, dst)."""
    return edges.select(F.col("in_id").alias("src"), F.col("out_id").alias("dst")).union(edges.select(F.col("out_id").alias("src"), F.col("in_id").alias("dst")))


def within_hops(edges: DataFrame, start: DataFrame, hops: int = 2, direction: str = "outgoing", limit: int | None = None) -> DataFrame:
    """Nodes within hops of the start nodes (node), with their distance; start excluded."""
    src, dst = ("in_id", "out_id") if direction == "outgoing" else ("out_id", "in_id")
    steps = (both_ways(edges) if direction == "both" else edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))).distinct()
    seen = start.select("node", F.lit(0).alias("distance"))
    front = start.select("node")
    for d in range(1, hops + 1):
        new = steps.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        new = cut(new)
        seen = seen.unionByName(new.select("node", F.lit(d).alias("distance")))
        front = new
    out = seen.where("distance > 0")
    return out.orderBy("distance", "node").limit(limit) if limit else out


def distances(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """Undirected breadth-first distances from the start nodes: (node, distance, parent). Ties go to the
    smallest parent."""
    steps = cut(both_ways(edges).distinct())
    seen = cut(start.select("node", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent")))
    front = seen
    for d in range(1, max_depth + 1):
        new = (steps.join(front.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
               .join(seen, "node", "left_anti").select("node", F.lit(d).alias("distance"), "parent"))
        new = cut(new)
        if not new.limit(1).count():
            break
        seen = cut(seen.unionByName(new))
        front = new
    return seen


def _touching(edges: DataFrame, nodes: list[str]) -> DataFrame:
    """(src, dst) of edges in either direction from the nodes, which the scan filters."""
    out = edges.where(F.col("in_id").isin(nodes)).select(F.col("in_id").alias("src"), F.col("out_id").alias("dst"))
    return out.union(edges.where(F.col("out_id").isin(nodes)).select(F.col("out_id").alias("src"), F.col("in_id").alias("dst")))


def shortest_path(edges: DataFrame, source: str, target: str, cutoff=None, max_depth: int = 4, max_nodes: int = 500) -> dict:
    """The nodes of one shortest path of at most max_depth edges, and a status: found, no_path, or depth_limit_exceeded
    (more than max_nodes would have to be looked at).

    Searched from both ends: the smaller frontier takes the next step, and the step first asks whether one of its edges
    ends in what the other side has seen, so a hub's neighbours are not gathered to be met. What the driver holds is
    bounded by max_nodes on each side; a side whose next frontier passes it stands still while the other goes on."""
    active = edges.where(temporal.active_at(cutoff)) if cutoff is not None else edges
    if source == target:
        return {"status": "found", "path": [source]}
    seen = [{source: None}, {target: None}]  # node -> parent
    front, depth, wide, looked = [[source], [target]], 0, [False, False], 0
    while depth < max_depth:
        open_ = [s for s in (0, 1) if front[s] and not wide[s]]
        if not front[0] or not front[1]:
            return {"status": "no_path", "path": []}
        side = min(open_, key=lambda s: (len(front[s]), s), default=None)
        if side is None or looked + len(front[side]) > max_nodes:
            return {"status": "depth_limit_exceeded", "path": []}
        looked += len(front[side])
        steps, other = _touching(active, front[side]), seen[1 - side]
        met = steps.where(F.col("dst").isin(list(other))).orderBy("dst", "src").first()
        if met is not None:
            halves = []
            for s, node in ((side, met["src"]), (1 - side, met["dst"])):
                half = []
                while node is not None:
                    half.append(node)
                    node = seen[s][node]
                halves.append(half)
            path = halves[0][::-1] + halves[1]
            return {"status": "found", "path": path if side == 0 else path[::-1]}
        depth += 1
        if depth == max_depth:
            break
        new = steps.where(~F.col("dst").isin(list(seen[side]))).groupBy("dst").agg(F.min("src").alias("src")).limit(max_nodes + 1).collect()
        if len(new) > max_nodes:
            wide[side] = True
            depth -= 1  # this step was not taken; what it would have met is found from the other side
            continue
        seen[side].update({r["dst"]: r["src"] for r in new})
        front[side] = [r["dst"] for r in new]
    return {"status": "no_path", "path": []}


def path_steps(edges: DataFrame, entities: DataFrame, path: list[str], cutoff=None) -> DataFrame:
    """A path's nodes in order (position from 0, node, entity_type, label) with the edge that leads on from each: edge_id,
    relation, direction, strength, confidence, t_valid, t_invalid; the smallest edge_id where there are several."""
    active = edges.where(temporal.active_at(cutoff)) if cutoff is not None else edges
    spark = edges.sparkSession
    nodes = spark.createDataFrame(list(enumerate(path)), "position int, node string")
    if not path:
        return nodes.select("position", "node", *[F.lit(None).cast(t).alias(c) for c, t in (("entity_type", "string"), ("label", "string"), *_STEP)])
    steps = F.broadcast(spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(path, path[1:]))], "position int, a string, b string"))  # max_depth rows
    have = [F.col(c) if c in edges.columns else F.lit(None).cast(t).alias(c) for c, t in _STEP if c != "direction"]
    near = active.where(F.col("in_id").isin(path) & F.col("out_id").isin(path)).select("in_id", "out_id", *have)
    out = near.join(steps, (F.col("in_id") == F.col("a")) & (F.col("out_id") == F.col("b"))).withColumn("direction", F.lit("outgoing"))
    both = out.unionByName(near.join(steps, (F.col("in_id") == F.col("b")) & (F.col("out_id") == F.col("a"))).withColumn("direction", F.lit("incoming")))
    names = [c for c, _ in _STEP]
    best = both.groupBy("position").agg(F.min_by(F.struct(*names), F.struct("edge_id", "direction")).alias("e")).select("position", "e.*")
    told = entities.where(F.col("entity_id").isin(path)).select(F.col("entity_id").alias("node"), "entity_type", F.col("canonical_name").alias("label"))
    return nodes.join(told, "node", "left").join(best, "position", "left").select("position", "node", "entity_type", "label", *names)


_STEP = (("edge_id", "string"), ("relation", "string"), ("direction", "string"), ("strength", "double"), ("confidence", "double"), ("t_valid", "timestamp_ntz"), ("t_invalid", "timestamp_ntz"))


def intro_chains(edges: DataFrame, target: str, max_hops: int, cutoff=None) -> DataFrame:
    """Chains that lead to the target over incoming edges: one row per start, the shortest and first chain.
    Starts are nodes that were reached and that no reached node leads to, or that lie at the last level."""
    active = edges.where(temporal.active_at(cutoff)) if cutoff is not None else edges
    steps = cut(active.select(F.col("in_id").alias("src"), F.col("out_id").alias("dst")).distinct())
    spark = edges.sparkSession
    seen = spark.createDataFrame([(target, [target])], "node string, path array<string>")
    front = seen
    for _ in range(max_hops):
        new = (steps.join(front, steps.dst == front.node).groupBy("src").agg(F.min(F.concat(F.array("src"), "path")).alias("path"))
               .select(F.col("src").alias("node"), "path").join(seen.select("node"), "node", "left_anti"))
        new = cut(new)
        if not new.limit(1).count():
            break
        seen = seen.unionByName(new)
        front = new
    reached = cut(seen)
    led_to = steps.join(reached.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    return reached.where(F.col("node") != target).join(led_to, "node", "left_anti").select("node", "path", (F.size("path") - 1).alias("hops"))


def intro_chain(edges: DataFrame, target: str, max_hops: int, cutoff=None) -> DataFrame:
    """The shortest chain, ties in lexicographic order."""
    return intro_chains(edges, target, max_hops, cutoff).orderBy("hops", "path").limit(1).select("path")


def numbered(nodes: DataFrame) -> DataFrame:
    """Distinct nodes (node) with a long id; ids stand in the order of the names. Range-partitioned and sorted, so a
    row's partition and place make the number, and nothing is gathered."""
    dealt = nodes.select("node").distinct().repartitionByRange("node").sortWithinPartitions("node")
    return cut(dealt.withColumn("id", F.monotonically_increasing_id()))


#: Edges that a task contracts at once.
CONTRACTED = 1 << 19


def _labels(a, b, n: int):
    """For n nodes the smallest that each reaches over the edges (a, b): roots hook to smaller ones, then paths are halved."""
    import numpy as np

    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up


def _forest(batches):
    """Streams edges (in_id, out_id); of every CONTRACTED of them each node with the smallest that it reaches over these, itself
    included. The same nodes are connected, by a row for each node and not for each edge."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def contracted(held):
        ends = pa.concat_arrays([b.column(k) for k in (0, 1) for b in held]).dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        names, rank = ends.dictionary.take(order), np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        code = rank[ends.indices.to_numpy()]
        half = len(code) // 2
        return pa.RecordBatch.from_arrays([names, names.take(pa.array(_labels(code[:half], code[half:], len(names))))], names=["in_id", "out_id"])

    held, n = [], 0
    for batch in batches:
        whole = pc.and_(pc.is_valid(batch.column(0)), pc.is_valid(batch.column(1)))
        if not pc.all(whole).as_py():  # an edge without an end links nothing; its ends are nodes
            for k in (0, 1):
                loose = batch.column(k).filter(pc.invert(whole))
                yield pa.RecordBatch.from_arrays([loose, loose], names=["in_id", "out_id"])
            batch = batch.filter(whole)
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= CONTRACTED:
            yield contracted(held)
            held, n = [], 0
    if held:
        yield contracted(held)


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One round over links (a, b): nodes at a link move to the smallest neighbour."""
    if large:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")  # a hub's links are split by AQE: the other side has a row for each node
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Undirected components: (node, component), the component named by its smallest node. Each task first contracts the edges
    that it reads, so they are read once, may repeat, and what moves is a row for each node of a task. Names are numbered once, and
    large-star and small-star rounds (Kiveris et al., 2014) contract the numbers: each moves every node to the smallest
    one near it, so rounds grow with the logarithm of the longest chain. Counts and checksums reach the driver."""
    ends = edges.select("in_id", "out_id")
    edges = cut(ends.mapInArrow(_forest, ends.schema))
    ids_ = numbered(edges.select(F.col("in_id").alias("node")))
    end = lambda c, k: ids_.select(F.col("node").alias(c), F.col("id").alias(k))
    links = edges.select("in_id", "out_id").where("in_id <> out_id").join(end("in_id", "x"), "in_id").join(end("out_id", "y"), "out_id")
    pairs = cut(links.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    mark = lambda p: tuple(p.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = mark(pairs)
    for _ in range(max_rounds if before[0] else 0):
        pairs = cut(_star(_star(pairs, True), False))
        now = mark(pairs)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    roots = ids_.join(pairs.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("node", F.coalesce("root", "id").alias("root"))
    return roots.join(ids_.select(F.col("id").alias("root"), F.col("node").alias("component")), "root").select("node", "component")


def communities(edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Components of two entities or more: community_id (hash of its members), member_entities, summary (first
    three distinct names, or ids). One row holds a community: beyond what fits, see membership.members_of."""
    return communities_of(components(edges), names)


def communities_of(labels: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """communities() of known components (node, component)."""
    members = labels.where(F.col("node").startswith("entity:"))
    if names is not None:
        members = members.join(names.select(F.col("entity_id").alias("node"), F.col("canonical_name").alias("name")), "node", "left")
    else:
        members = members.withColumn("name", F.lit(None).cast("string"))
    groups = members.groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("member_entities"), F.array_sort(F.collect_set("name")).alias("names")).where(F.size("member_entities") >= 2)
    shown = F.when(F.size("names") > 0, F.col("names")).otherwise(F.col("member_entities"))
    return groups.select(ids.community_id(F.col("member_entities")).alias("community_id"), "member_entities", F.array_join(F.slice(shown, 1, 3), ", ").alias("summary"))


def stale_communities(stored: DataFrame, edges: DataFrame) -> DataFrame:
    """Stored communities with fewer than two members, or that are no component any more."""
    now = communities(edges).select("community_id", F.col("member_entities").alias("current"))
    return (stored.join(now, "community_id", "left").where((F.size("member_entities") < 2) | ~F.coalesce(F.array_sort("member_entities") == F.array_sort("current"), F.lit(False)))
            .select("community_id", F.when(F.size("member_entities") < 2, "too_small").otherwise("drifted").alias("reason")))


def component_of_scope(edges: DataFrame, facts: DataFrame, scope: str, cutoff=None) -> DataFrame:
    """Components (node, component) of the active edges whose ends are entities that facts of a scope link to, or
    those facts themselves."""
    own = facts.where(F.col("scope") == scope)
    nodes = own.select(F.explode("entity_links").alias("node")).union(own.select(F.col("fact_id").alias("node"))).distinct()
    active = edges.where(temporal.active_at(cutoff)) if cutoff is not None else edges
    inside = active.join(nodes.withColumnRenamed("node", "in_id"), "in_id", "left_semi").join(nodes.withColumnRenamed("node", "out_id"), "out_id", "left_semi")
    return components(inside)


def ordered_edges(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Edges by in_id, out_id and newest valid time first."""
    out = edges.orderBy("in_id", "out_id", F.col("t_valid").desc(), "edge_id")
    return out.limit(limit) if limit else out


def overlapped_communities(stored: DataFrame, upserted: DataFrame) -> DataFrame:
    """Stored communities that share a member with an upserted one and gave it no id: they are to be deleted."""
    new = upserted.select(F.explode("member_entities").alias("m")).distinct()
    hit = stored.select("community_id", F.explode("member_entities").alias("m")).join(new, "m", "left_semi").select("community_id").distinct()
    return stored.join(hit, "community_id", "left_semi").join(upserted.select("community_id"), "community_id", "left_anti")


def upsert_communities(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """A rebuilt community keeps the smallest id among stored ones that share a member. An id goes to one of them
    only, the first that has it."""
    old = stored.select("community_id", F.explode("member_entities").alias("m")).withColumnRenamed("community_id", "old_id")
    new = rebuilt.select("community_id", F.explode("member_entities").alias("m"))
    kept = new.join(old, "m").groupBy("community_id").agg(F.min("old_id").alias("old_id"))
    kept = kept.groupBy("old_id").agg(F.min("community_id").alias("community_id"))
    return rebuilt.join(kept, "community_id", "left").withColumn("community_id", F.coalesce("old_id", "community_id")).drop("old_id")


_TRIPLE = ("in_id", "relation", "out_id")
_ORDER = (*_TRIPLE, "t_ingested", "t_valid", "edge_id")


def _next_not_less(v, last):
    """For each place the first later one up to last (the end of its run, exclusive) whose value is not less, or last. Each
    waits for a candidate; one that is less hands on to its own candidate, since all between are less still."""
    import numpy as np

    at = np.arange(len(v)) + 1
    todo = np.arange(len(v))
    while True:
        todo = todo[at[todo] < last[todo]]
        todo = todo[v[at[todo]] < v[todo]]
        if not len(todo):
            return np.minimum(at, last)
        at[todo] = at[at[todo]]


def _first_later(batches):
    """Streams versions sorted by triple and transaction order. A version waits until one comes that is not earlier in valid
    time; what waits of the current triple is in falling order of valid time, and goes before the next batch.

    Rows: closed (edge_id with its closer), waiting (of the last triple, which may go on elsewhere) and high (versions of
    the first triple that are later in valid time than all before them: only these can close what waits elsewhere)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held, first, most = None, True, np.iinfo(np.int64).min

    def rows(kind, part, valid=None, ingested=None):
        n = part.num_rows
        none = pa.nulls(n, pa.timestamp("us"))
        when = [none, none] if valid is not None else [part.column(c).cast(pa.timestamp("us")) for c in ("t_valid", "t_ingested")]
        by = [none, none] if valid is None else [pa.array(x).cast(pa.timestamp("us")) for x in (valid, ingested)]
        triple = [pa.nulls(n, pa.string()) if valid is not None else part.column(c) for c in _TRIPLE]  # a closed version needs none
        return pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), [kind]).dictionary_decode(), *triple, part.column("edge_id"), *when, *by], names=["kind", *_TRIPLE, "edge_id", "t_valid", "t_ingested", "by_valid", "by_ingested"])

    def changed(column):
        x, y = column.slice(0, len(column) - 1), column.slice(1)
        same = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y)))
        return ~same.to_numpy(zero_copy_only=False)

    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column("t_valid")))
        if not batch.num_rows:
            continue
        before = held.num_rows if held is not None else 0
        whole = pa.concat_batches([held, batch]) if before else batch
        v = whole.column("t_valid").cast(pa.int64()).to_numpy()
        i = whole.column("t_ingested").cast(pa.int64())
        new = np.r_[True, changed(whole.column("in_id")) | changed(whole.column("relation")) | changed(whole.column("out_id"))]
        starts = np.r_[np.flatnonzero(new), len(v)]
        end = starts[np.cumsum(new)]
        if first:  # highs of the first triple of the task
            own = v[before:end[0]] if end[0] > before else v[:0]
            top = np.maximum.accumulate(np.r_[most, own])
            rise = before + np.flatnonzero(own > top[:-1])
            if len(rise):
                yield rows("high", whole.take(pa.array(rise)))
            most, first = top[-1], end[0] == len(v)
        to = _next_not_less(v, end)
        done = np.flatnonzero(to < end)
        if len(done):
            yield rows("closed", whole.select(["edge_id"]).take(pa.array(done)), v[to[done]], i.take(pa.array(to[done])))
        held = whole.take(pa.array(np.flatnonzero((to == end) & (end == len(v)))))
    if held is not None and held.num_rows:
        yield rows("waiting", held)


def close_superseded(edges: DataFrame) -> DataFrame:
    """Open versions of a triple closed by the first later one (in transaction order) that is not earlier in valid time;
    a late arrival closes nothing that is newer. Versions are range-partitioned by triple and order, so one with very
    many versions is spread over tasks; each task settles its own in one pass, and what waits at its end is matched with
    the rising highs of the next tasks: no version is joined with the others of its triple. A version without valid time
    neither closes nor is closed."""
    order = [F.col(c) for c in _ORDER]
    dealt = edges.select(*_ORDER).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "kind string, in_id string, relation string, out_id string, edge_id string, t_valid timestamp_ntz, t_ingested timestamp_ntz, by_valid timestamp_ntz, by_ingested timestamp_ntz"
    found = cut(dealt.mapInArrow(_first_later, schema).withColumn("task", F.spark_partition_id()))
    high, waiting = found.where("kind = 'high'"), found.where("kind = 'waiting'")
    tops = high.groupBy(*_TRIPLE, "task").agg(F.max("t_valid").alias("top")).withColumnRenamed("task", "there")  # a row for each task at most
    to = (waiting.select(*_TRIPLE, "edge_id", "t_valid", "task").join(F.broadcast(tops), list(_TRIPLE)).where((F.col("there") > F.col("task")) & (F.col("top") >= F.col("t_valid")))
          .groupBy(*_TRIPLE, "edge_id", "t_valid").agg(F.min("there").alias("task")))
    none = F.lit(None).cast("struct<by_valid:timestamp_ntz,by_ingested:timestamp_ntz>")
    both = (high.select(*_TRIPLE, "task", "t_valid", F.lit(0).alias("side"), F.lit(None).cast("string").alias("edge_id"), F.struct(F.col("t_valid").alias("by_valid"), F.col("t_ingested").alias("by_ingested")).alias("by"))
            .unionByName(to.select(*_TRIPLE, "task", "t_valid", F.lit(1).alias("side"), "edge_id", none.alias("by"))))
    least = Window.partitionBy(*_TRIPLE, "task").orderBy(F.col("t_valid").desc(), "side").rowsBetween(Window.unboundedPreceding, 0)
    late = both.withColumn("by", F.last("by", ignorenulls=True).over(least)).where("side = 1").select("edge_id", "by.by_valid", "by.by_ingested")
    closing = found.where("kind = 'closed'").select("edge_id", "by_valid", "by_ingested").unionByName(late)
    is_open = F.col("t_invalid").isNull()
    return edges.join(closing, "edge_id", "left").withColumns({
        "t_invalid": F.when(is_open, F.col("by_valid")).otherwise(F.col("t_invalid")),
        "t_invalid_ingested": F.when(is_open, F.col("by_ingested")).otherwise(F.col("t_invalid_ingested"))}).select(*edges.columns)


def expand_entities(edges: DataFrame, seeds: DataFrame, query_is_relational: bool, cutoff=None) -> DataFrame:
    """Seed entities and their neighbours: one hop, two for questions about relations."""
    active = edges.where(temporal.active_at(cutoff)) if cutoff is not None else edges
    start = seeds.select(F.col("entity_id").alias("node"))
    near = within_hops(active, start, 2 if query_is_relational else 1, "both").select("node")
    return start.union(near).where(F.col("node").startswith("entity:")).select(F.col("node").alias("entity_id")).distinct()
