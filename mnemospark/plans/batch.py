"""assemble_context over a table of requests, in one plan: what one request does with its legs is done here by joins and
ranks within a request, so a suite of many requests is one job and not a loop of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import temporal, text
from ..operators import fusion, postings, relational
from ..operators.lexical import B, K1
from ..operators.postings import parts_of, ticks
from ..runtime import cut, small, travels
from .retrieval import CANDIDATES, MemoryTables

travels(__name__)

_OPTIONAL = {"view": "string", "window_start": "timestamp_ntz", "window_end": "timestamp_ntz", "allowed_tags": "array<string>", "allowed_scopes": "array<string>"}


def _prepared(requests: DataFrame) -> DataFrame:
    r = requests.select("request_id", "query", "scope", F.col("as_of").cast("timestamp_ntz").alias("as_of"), F.greatest(F.coalesce(F.col("budget").cast("int"), F.lit(5)), F.lit(1)).alias("budget"),
                        *[(F.col(c) if c in requests.columns else F.lit(None)).cast(t).alias(c) for c, t in _OPTIONAL.items()])
    seen = F.col("allowed_scopes").isNull() | F.array_contains("allowed_scopes", F.col("scope"))
    q = text.search_query(F.coalesce("query", F.lit("")))
    return cut(r.where(seen).withColumns({"q": F.trim(q), "blank": F.trim(F.coalesce("query", F.lit(""))) == ""}))


def _month(t: Column) -> Column:
    return F.date_format(t, "MMMM yyyy")


def rewrites_of(requests: DataFrame, entities: DataFrame | None) -> DataFrame:
    """(request_id, n, rewrite): the query as n = 0, then its rewrites in order, by spans of time and by other names of the
    entities that it names."""
    base = requests.where("q <> ''").select("request_id", "q", "as_of")
    out = base.select("request_id", F.lit(0).alias("n"), F.col("q").alias("rewrite"))
    found = None
    for phrase, when in (("last month", F.add_months(F.trunc(F.col("as_of").cast("date"), "month"), -1)), ("this month", F.col("as_of"))):
        named = F.replace(F.replace("q", F.lit(phrase), _month(when)), F.lit(phrase.capitalize()), _month(when))
        new = base.where(F.lower("q").contains(phrase)).select("request_id", "q", named.alias("rewrite"))
        found = new if found is None else found.unionByName(new)
    if entities is not None:
        words = base.select("request_id", "q", F.split(F.trim("q"), r"\s+").alias("w"))
        spans = words.select("*", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("at")).select("*", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("at") + 1)).alias("len"))
        spans = spans.withColumn("gram", F.array_join(F.slice("w", F.col("at"), F.col("len")), " ")).where(F.octet_length("gram") >= 2).withColumn("g", text.normalize("gram"))
        names = entities.select("entity_id", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("name")).withColumn("g", text.normalize("name"))
        hit = spans.join(names.select("g", "entity_id"), "g").select("request_id", "q", "w", "at", "len", "g", "entity_id")
        other = hit.join(names.select("entity_id", "name", F.col("g").alias("own")), "entity_id").where(F.col("own") != F.col("g"))
        parts = F.concat(F.slice("w", 1, F.col("at") - 1), F.array("name"), F.slice("w", F.col("at") + F.col("len"), F.size("w")))
        found = found.unionByName(other.select("request_id", "q", F.array_join(parts, " ").alias("rewrite")))
    more = found.where(F.col("rewrite") != F.col("q")).select("request_id", "rewrite").distinct()
    return out.unionByName(more.withColumn("n", F.row_number().over(Window.partitionBy("request_id").orderBy("rewrite"))))


def _active(requests: DataFrame) -> Column:
    """Of facts joined with their request: scope, time and tags."""
    tags = F.coalesce("policy_tags", F.array().cast("array<string>"))
    return (F.col("scope") == F.col("r_scope")) & temporal.active_at(F.col("r_as_of")) & (F.col("r_tags").isNull() | (F.size(tags) == 0) | F.arrays_overlap(tags, F.coalesce("r_tags", F.array().cast("array<string>"))))


def _asked(requests: DataFrame) -> DataFrame:
    return requests.select("request_id", F.col("scope").alias("r_scope"), F.col("as_of").alias("r_as_of"), F.col("allowed_tags").alias("r_tags"), "budget")


def _recency() -> list[Column]:
    return [F.col("t_valid").desc(), F.col("fact_id")]


_NARROW = ["request_id", "n", "fact_id", "t_valid", "ft_score"]


def _lexical(facts: DataFrame, requests: DataFrame, rewrites: DataFrame, tables: MemoryTables) -> DataFrame:
    """The hits of every rewrite, each cut to its request's budget: request_id, n, fact_id, t_valid, ft_score.

    Requests that see the same facts (scope, time, tags and limit alike) are scored together, up to QUERIES_AT_ONCE: blocks
    of their terms meet the facts that they see in the slices of the content index, and a slice gives the best of each
    request, and of each single term once for all. Texts of index keys are short: their postings go by row."""
    pair, content = ["request_id", "n"], tables.content_index
    own = ["r_scope", "r_as_of", "r_tags", "most"]
    told = _asked(requests).withColumn("most", F.greatest(F.col("budget") * CANDIDATES, F.lit(50)))
    seeing = cut(told.select(*[F.col(c).alias(f"{c}_") for c in own]).distinct().withColumn("sees", F.monotonically_increasing_id()))
    told = told.join(seeing, F.expr(" AND ".join(f"{c} <=> {c}_" for c in own))).drop(*[f"{c}_" for c in own])
    asked = postings.query_terms(rewrites, "rewrite", content.english).withColumn("need", F.size("terms")).where("need > 0").drop("rewrite")
    asked = cut(asked.join(told, "request_id"))
    groups = -(-asked.count() // postings.QUERIES_AT_ONCE) or 1
    asked = asked.withColumn("part", F.pmod(F.xxhash64(F.col("request_id").cast("string"), "n"), F.lit(groups)).cast("int"))
    views = asked.select("sees", "part", "r_scope", "r_as_of", "r_tags").distinct()
    each = small(asked.select("sees", "part", F.explode("terms").alias("term")).distinct())
    narrow = facts.select("fact_id", "t_valid", "t_ingested", "t_invalid", "t_invalid_ingested", "scope", "policy_tags").join(F.broadcast(views), F.col("scope") == F.col("r_scope")).where(_active(requests))
    loose = F.concat(F.lit("none-"), F.pmod(F.xxhash64("key"), F.lit(64)))  # of facts that the content index lacks
    seen = cut(narrow.select("sees", "part", F.col("fact_id").alias("key"), "t_valid").join(content.places(), "key", "left").withColumn("slice", F.coalesce("slice", loose)))
    docs = seen.groupBy("sees", "part", "slice").agg(F.sort_array(F.collect_list(F.struct("key", "t_valid", "place", "dl"))).alias("docs"))
    queries = asked.groupBy("sees", "part").agg(F.collect_list(F.struct(*pair, "need", "terms")).alias("queries"), F.first("most").alias("most"))
    docs = docs.join(F.broadcast(queries), ["sees", "part"])
    blocks = content.blocks_batch(each, content.segments()).join(each, "term")
    by_key = tables.keys_index.parts_batch(each).withColumnRenamed("part", "add").join(each, "term").join(seen, ["sees", "part", "key"])
    short = by_key.groupBy("sees", "part", "slice", "term").agg(F.collect_list(F.struct("key", "add")).alias("e")).select("sees", "part", "slice", "term", F.col("e.key").alias("short_keys"), F.col("e.add").alias("adds"))
    rows = docs.unionByName(blocks, allowMissingColumns=True).unionByName(short, allowMissingColumns=True)
    kind = dict(asked.dtypes)["request_id"]
    found = rows.groupBy("sees", "part", "slice").applyInArrow(_best_facts, f"sees long, part int, request_id {kind}, n int, leg string, key string, ft_score double, t_valid timestamp_ntz, most int")
    found = cut(found.withColumn("ft_score", F.round("ft_score", 9)))
    order = [F.col("ft_score").desc(), F.col("t_valid").desc(), F.col("key")]
    of_term = found.where("leg <> ''").withColumn("_rn", F.row_number().over(Window.partitionBy("sees", "part", "leg").orderBy(*order))).where(F.col("_rn") <= F.col("most"))
    wants = asked.where("need > 1").select("sees", "part", *pair, F.explode("terms").alias("leg"))
    single = of_term.drop(*pair, "_rn").join(wants, ["sees", "part", "leg"])  # terms sort as their places do
    hits = found.where("leg = ''").unionByName(single, allowMissingColumns=True).select(*pair, "leg", F.col("key").alias("fact_id"), "t_valid", "ft_score", "most")
    order = [F.col("ft_score").desc(), *_recency()]
    few = hits.withColumn("_rn", F.row_number().over(Window.partitionBy(*pair, "leg").orderBy(*order))).where(F.col("_rn") <= F.col("most"))
    once = few.withColumns({"_first": F.row_number().over(Window.partitionBy(*pair, "fact_id").orderBy("leg", "_rn")), "_best": F.min("leg").over(Window.partitionBy(*pair))})
    chosen = once.where((F.col("_first") == 1) & ((F.col("_best") != "") | (F.col("leg") == ""))).drop("_rn", "_first", "_best", "leg")
    kept = chosen.join(told.select("request_id", "budget"), "request_id").withColumn("_rn", F.row_number().over(Window.partitionBy(*pair).orderBy(*order))).where(F.col("_rn") <= F.col("budget"))
    return kept.select(*_NARROW)


def _best_facts(table: pa.Table) -> pa.Table:
    """The best facts of one slice: for each request those that hold all its terms, in the content or in the index keys
    (leg ''), and for each single term those that hold it."""
    told = table.filter(pc.is_valid(table.column("docs"))).combine_chunks()
    who, which, legs, scores = [], [], [], []
    docs = pa.array([], pa.string())
    if told.num_rows:  # else no request sees a fact of the slice
        facts, most = told.column("docs").combine_chunks().flatten(), told.column("most")[0].as_py()
        docs, when = facts.field("key").cast(pa.string()), facts.field("t_valid")
        queries = told.column("queries").combine_chunks().flatten()
        newest = -when.cast(pa.int64()).to_numpy(zero_copy_only=False)
        content = parts_of(table.filter(pc.is_valid(table.column("idf"))), facts)
        short = table.filter(pc.is_valid(table.column("adds")))
        keys = {}
        for term, own, adds in zip(short.column("term").to_pylist(), short.column("short_keys").to_pylist(), short.column("adds").to_pylist()):
            keys[term] = pc.index_in(pa.array(own, pa.string()), value_set=docs).to_numpy(zero_copy_only=False).astype(np.int64), np.array(adds)
        needs, asked = queries.field("need").to_pylist(), queries.field("terms").to_pylist()

        def give(q: int | None, leg: str, score: np.ndarray, hit: np.ndarray) -> None:
            hit = hit[np.lexsort((hit, newest[hit], -ticks(score[hit])))[:most]]  # docs are in the order of their keys
            who.extend([q] * len(hit))
            which.extend(hit.tolist())
            legs.extend([leg] * len(hit))
            scores.extend(score[hit].tolist())

        for q, terms in enumerate(asked):
            score, held = np.zeros(len(docs)), np.zeros(len(docs), bool)
            for parts in (content, keys):
                if all(t in parts for t in terms):
                    own, n = np.zeros(len(docs)), np.zeros(len(docs), np.int32)
                    for at, add in (parts[t] for t in terms):
                        own[at] += add
                        n[at] += 1
                    whole = n == len(terms)
                    score[whole] += own[whole]
                    held |= whole
            give(q, "", score, np.flatnonzero(held))
        for term in sorted({t for need, terms in zip(needs, asked) if need > 1 for t in terms}):
            score, held = np.zeros(len(docs)), np.zeros(len(docs), bool)
            for at, add in (parts[term] for parts in (content, keys) if term in parts):
                score[at] += add
                held[at] = True
            give(None, term, score, np.flatnonzero(held))
    else:
        when, most, queries = pa.array([], pa.timestamp("us")), 0, None
    at, q = pa.array(which, pa.int64()), pa.array(who, pa.int64())
    ids = table.schema.field("queries").type.value_type.field("request_id").type
    n = len(which)
    same = lambda c: pa.array([table.column(c)[0].as_py()] * n, table.schema.field(c).type)
    return pa.table({"sees": same("sees"), "part": same("part"), "request_id": queries.field("request_id").take(q) if queries is not None else pa.nulls(0, ids), "n": (queries.field("n").take(q) if queries is not None else pa.nulls(0, pa.int32())).cast(pa.int32()),
                     "leg": pa.array(legs, pa.string()), "key": docs.take(at), "ft_score": pa.array(scores, pa.float64()), "t_valid": when.take(at), "most": pa.array([most] * n, pa.int32())})


def _newest(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """The newest facts for requests without a query: request_id, n, fact_id, t_valid, ft_score."""
    asked = cut(_asked(requests.where("blank")))
    narrow = facts.select("fact_id", "t_valid", "t_ingested", "t_invalid", "t_invalid_ingested", "scope", "policy_tags")
    hits = narrow.join(F.broadcast(asked), F.col("scope") == F.col("r_scope")).where(_active(requests))  # requests alone
    newest = hits.withColumn("_rn", F.row_number().over(Window.partitionBy("request_id").orderBy(*_recency()))).where(F.col("_rn") <= F.col("budget"))
    return newest.withColumns({"n": F.lit(0), "ft_score": F.lit(0.0)}).select(*_NARROW)


def _leg(hits: DataFrame, name: str, by: list[str], order: list[Column], why: Column) -> DataFrame:
    weight, priority = fusion.LEGS[name]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return hits.withColumns({"rank": rank, "weight": F.lit(weight), "source_priority": F.lit(priority), "rationale": why}).select(
        "request_id", "fact_id", "fact_type", "content", "source_episode", "t_valid", "confidence", "ft_score", "rank", "weight", "source_priority", "rationale")


def _summaries(communities: DataFrame, requests: DataFrame) -> DataFrame:
    """The 25 communities of each request whose summary holds most of its words: request_id, community_id, member_entities,
    summary, _rank. Tokens are those of single requests, without stems."""
    low = F.lower("summary")
    plain = F.regexp_extract_all(low, F.lit("([a-z]+|[0-9]+)"), F.lit(1))
    other = F.filter(F.regexp_extract_all(low, F.lit(r"(\p{L}+)"), F.lit(1)), lambda w: w.rlike(r"[^a-z]"))
    words = communities.select("community_id", F.size(plain).alias("dl"), F.explode_outer(F.concat(plain, other)).alias("term"))
    tf = words.where("term <> ''").groupBy("community_id", "dl", "term").agg(F.count("*").alias("tf"))
    stats = F.broadcast(communities.agg(F.count("*").alias("docs"), F.avg(F.size(plain)).alias("avg")))  # one row
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("q"), F.lit(r"([\p{L}\p{M}]+|[0-9]+)"), F.lit(1)))
    asked = requests.where("q <> ''").select("request_id", F.explode(tokens).alias("term"))
    share = F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.coalesce(F.try_divide(F.col("dl").cast("double"), F.col("avg")), F.lit(0.0))))
    hit = asked.join(tf, "term").join(df, "term").join(stats).groupBy("request_id", "community_id").agg(F.sum(postings._idf(F.col("docs"), F.col("df")) * share).alias("s"))
    top = hit.withColumn("_rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("s").desc(), "community_id"))).where("_rank <= 25").drop("s")
    return top.join(communities.select("community_id", "member_entities", "summary"), "community_id")


def _community(facts: DataFrame, links: DataFrame, requests: DataFrame, tables: MemoryTables, used: DataFrame) -> DataFrame:
    members = _summaries(tables.communities, requests).select("request_id", "community_id", "summary", "_rank", F.explode("member_entities").alias("entity_id"))
    best = links.join(members, "entity_id").groupBy("request_id", "fact_id").agg(F.min(F.struct("_rank", "community_id", "summary")).alias("_best"))
    hits = best.join(facts, "fact_id").join(_asked(requests), "request_id").where(_active(requests)).join(used, ["request_id", "fact_id"], "left_anti")
    order = [F.col("_best._rank"), *_recency()]
    top = hits.withColumn("_rn", F.row_number().over(Window.partitionBy("request_id").orderBy(*order))).where(F.col("_rn") <= F.col("budget")).withColumn("ft_score", F.lit(0.0))
    why = F.format_string("matched community summary for query=\"%s\" via %s: %s", "q", "_best.community_id", "_best.summary")
    return _leg(top.join(requests.select("request_id", "q"), "request_id"), "community", ["request_id"], order, why)


def _linked(facts: DataFrame, links: DataFrame, requests: DataFrame, tables: MemoryTables, used: DataFrame) -> DataFrame:
    """Facts linked to entities that a query names, or that lie next to them: one hop, two for questions about relations."""
    asked = requests.where("q <> ''")
    words = asked.select("request_id", F.split(F.trim("q"), r"\s+").alias("w"))
    spans = words.select("*", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("at")).select("*", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("at") + 1)).alias("len"))
    grams = cut(spans.select("request_id", F.array_join(F.slice("w", F.col("at"), F.col("len")), " ").alias("name")).where(F.octet_length("name") >= 2).distinct())
    seeds = grams.join(relational.resolve_names(grams.select("name").distinct(), tables.entities), "name").select("request_id", F.col("entity_id").alias("node")).distinct()
    near = seeds
    if tables.edges is not None:
        deep = F.lit(False)
        for p in text.RELATIONSHIP:
            deep = deep | F.lower("q").contains(p)
        told = asked.select("request_id", F.col("as_of").alias("r_as_of"), F.when(deep, 2).otherwise(1).alias("hops"))
        both = tables.edges.select(F.col("in_id").alias("node"), F.col("out_id").alias("next"), *["t_valid", "t_ingested", "t_invalid", "t_invalid_ingested"])
        both = both.unionByName(both.withColumns({"node": F.col("next"), "next": F.col("node")}))
        front = seeds
        for hop in (1, 2):
            front = cut(front.join(both, "node").join(told, "request_id").where((F.col("hops") >= hop) & temporal.active_at(F.col("r_as_of"))).select("request_id", F.col("next").alias("node")).distinct())
            near = near.unionByName(front)
    wanted = near.where(F.col("node").startswith("entity:")).distinct()
    hits = links.join(wanted.withColumnRenamed("node", "entity_id"), "entity_id").select("request_id", "fact_id").distinct().join(used, ["request_id", "fact_id"], "left_anti")
    hits = hits.join(facts, "fact_id").join(_asked(requests), "request_id").where(_active(requests))
    top = hits.withColumn("_rn", F.row_number().over(Window.partitionBy("request_id").orderBy(*_recency()))).where(F.col("_rn") <= 3 * F.col("budget")).withColumn("ft_score", F.lit(0.0))
    return _leg(top, "semantic", ["request_id"], _recency(), F.lit("linked to an entity of the query"))


def assemble_contexts(tables: MemoryTables, requests: DataFrame) -> DataFrame:
    """requests: request_id, query, scope, as_of, budget and, where wanted, view, window_start, window_end, allowed_tags,
    allowed_scopes. The rows of assemble_context for each request, with request_id: lexical leg over the stored indexes
    of `tables` (which it needs), rewrites, community leg and leg of linked facts, fused, diversified and cut in one plan.

    It equals single calls without a query vector and without episodes: vectors of many queries are the vector index's
    work (search_batch), and the episode fallback stays with single calls, whose statistics are those of one scope. A null
    query is a blank one; a request of a scope that it may not see has no rows.
    """
    facts = tables.facts
    for name in ("index_keys", "entity_links", "policy_tags"):
        if name not in facts.columns:
            facts = facts.withColumn(name, F.array().cast("array<string>"))
    facts = facts.select("fact_id", "fact_type", "content", "source_episode", "t_valid", "t_ingested", "t_invalid", "t_invalid_ingested", "confidence", "scope", "policy_tags", "entity_links")
    r = _prepared(requests)
    rewrites = cut(rewrites_of(r, tables.entities))
    chosen = small(_lexical(facts, r, rewrites, tables).unionByName(_newest(facts, r)))  # budget rows of a rewrite; only now texts are read
    found = facts.drop("entity_links", "policy_tags").join(chosen, ["fact_id", "t_valid"]).join(_asked(r).drop("r_tags"), "request_id").where((F.col("scope") == F.col("r_scope")) & temporal.active_at(F.col("r_as_of")))
    found = cut(found.join(rewrites, ["request_id", "n"], "left").withColumn("rewrite", F.coalesce("rewrite", F.lit(""))))
    order = [F.col("ft_score").desc(), *_recency()]
    direct = found.where("n = 0")
    again = found.where("n > 0").join(direct.select("request_id", "fact_id"), ["request_id", "fact_id"], "left_anti")
    legs = _leg(direct, "lexical", ["request_id"], order, F.lit("lexical")).unionByName(_leg(again, "lexical", ["request_id", "n"], order, F.concat(F.lit("matched rewrite "), "rewrite")))
    used = direct.select("request_id", "fact_id").unionByName(again.select("request_id", "fact_id")).distinct()
    links = facts.select("fact_id", F.explode("entity_links").alias("entity_id"))
    if tables.communities is not None:
        own = cut(_community(facts, links, r, tables, used))
        legs, used = legs.unionByName(own), used.unionByName(own.select("request_id", "fact_id")).distinct()
    if tables.entities is not None:
        legs = legs.unionByName(_linked(facts, links, r, tables, used))
    asked = r.select("request_id", "as_of", "budget", "view", "window_start", "window_end")
    own = ("fact_type", "content", "source_episode", "t_valid", "confidence", "ft_score", "rationale")
    fused = (legs.join(asked.select("request_id", "as_of"), "request_id").withColumn("_c", temporal.retrieval_confidence(F.col("as_of"))).groupBy("request_id", "fact_id")
             .agg(F.sum(F.col("weight") / (F.lit(fusion.K) + F.col("rank").cast("double") + F.lit(1.0))).alias("fusion_score"), F.max("_c").alias("decayed_confidence"), F.min("source_priority").alias("source_priority"),
                  F.min_by(F.struct(*own), F.struct("source_priority", "rank")).alias("r")).select("request_id", "fact_id", "fusion_score", "decayed_confidence", "source_priority", "r.*"))
    inside = (F.col("window_start").isNull() | (F.col("t_valid") >= F.col("window_start"))) & (F.col("window_end").isNull() | (F.col("t_valid") <= F.col("window_end")))
    ranked = fused.join(asked.drop("as_of"), "request_id").where(inside)
    by_time = F.when(F.col("view") == "timeline", F.col("t_valid"))
    final = [by_time.asc(), F.when(by_time.isNull(), F.round(fusion.composite_score(), 9)).desc(), F.when(by_time.isNull(), F.col("source_priority")).asc(), F.when(by_time.isNull(), F.col("t_valid")).desc(), F.col("fact_id").asc()]
    capped = ranked.withColumn("_rn", F.row_number().over(Window.partitionBy("request_id", "source_episode").orderBy(*final))).where(F.col("_rn") <= fusion.MAX_PER_EPISODE)
    placed = capped.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy(*final))).where(F.col("place") <= F.col("budget"))
    return placed.select("request_id", "place", "fact_id", "content", "source_episode", "t_valid", F.round(fusion.composite_score(), 6).alias("score"), F.col("decayed_confidence").alias("confidence"), "rationale")
