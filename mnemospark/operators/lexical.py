"""Full-text ranking: BM25 over content and index keys, every query term needed, with a per-term fallback.

A query has few terms, so a text is scored in one pass: its tokens, their number and the counts of the
query's terms stay in one row; only document frequencies, N and the mean length are aggregated, to a single
row. No posting is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

K1, B = 1.2, 0.75


def query_terms(query: str) -> list[str]:
    """Runs of letters of any alphabet, or of digits; a query without either has no terms and matches nothing."""
    import re

    return sorted(set(re.findall(r"[^\W\d_]+|[0-9]+", query.lower())))


def _times(low: Column, term: str) -> Column:
    """How often a lower-case text holds a term as a whole token. A term of plain letters ends at any other one, as
    it always did; one with other letters ends at what is no letter."""
    kind = "0-9" if term.isdigit() else "a-z" if term.isascii() else r"\p{L}"
    return F.when(low.contains(term), F.regexp_count(low, F.lit(f"(?<![{kind}]){term}(?![{kind}])"))).otherwise(F.lit(0))


def _counted(df: DataFrame, field: Column, terms: list[str], suffix: str = "") -> DataFrame:
    """df with _dl (tokens of field) and _tf (counts of the terms), made without an array of tokens."""
    low = F.lower(field)
    return df.withColumns({f"_dl{suffix}": F.regexp_count(low, F.lit("[a-z]+|[0-9]+")), f"_tf{suffix}": F.array(*[_times(low, t) for t in terms])})


def _statistics(counted: DataFrame, n: int, suffix: str = "") -> list[Column]:
    return [F.avg(f"_dl{suffix}").alias(f"_avg{suffix}"), *[F.sum((F.col(f"_tf{suffix}")[i] > 0).cast("long")).alias(f"_df{suffix}{i}") for i in range(n)]]


def _parts(n: int, suffix: str = "") -> list[Column]:
    """The score that each term adds."""
    out = []
    for i in range(n):
        df_i = F.col(f"_df{suffix}{i}")
        idf = F.log1p((F.col("_n") - df_i + F.lit(0.5)) / (df_i + F.lit(0.5)))
        tf = F.col(f"_tf{suffix}")[i].cast("double")
        out.append(idf * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.coalesce(F.try_divide(F.col(f"_dl{suffix}").cast("double"), F.col(f"_avg{suffix}")), F.lit(0.0)))))
    return out


def _sum(parts: list[Column]) -> Column:
    total = F.lit(0.0)
    for p in parts:
        total = total + p
    return total


def bm25(df: DataFrame, field: Column, terms: list[str], all_terms: bool = True, score: str = "ft_score") -> DataFrame:
    """Rows whose field holds all terms (or any) with their score. Statistics cover every row of df."""
    if not terms:
        return df.withColumn(score, F.lit(0.0)).limit(0)
    n = len(terms)
    counted = _counted(df, field, terms)
    stats = counted.agg(F.count("*").alias("_n"), *_statistics(counted, n))
    hit = F.forall("_tf", lambda x: x > 0) if all_terms else F.exists("_tf", lambda x: x > 0)
    return counted.where(hit).join(F.broadcast(stats)).withColumn(score, _sum(_parts(n))).select(*df.columns, score)  # stats: one row


def search_facts(facts: DataFrame, active: Column, query: str, limit: int, fallback: bool = True) -> DataFrame:
    """The best facts whose content or index keys hold every term (both scores add up); if there is none and the
    query has several terms, those that hold single terms, each at its first term.

    One scan gathers the statistics of both fields over the whole table, a second one scores: a row goes to the
    leg of all terms and to those of single terms, and each task keeps `limit` rows of a leg.
    """
    terms = query_terms(query)
    n = len(terms)
    if not n:
        return facts.withColumn("ft_score", F.lit(0.0)).limit(0)
    counted = _counted(_counted(facts, F.col("content"), terms), F.array_join("index_keys", " "), terms, "k")
    stats = counted.agg(F.count("*").alias("_n"), *_statistics(counted, n), *_statistics(counted, n, "k"))
    some = F.exists("_tf", lambda x: x > 0) | F.exists("_tfk", lambda x: x > 0)
    scored = counted.where(active & some).join(F.broadcast(stats))  # stats: one row
    own, keys = _parts(n), [F.coalesce(p, F.lit(0.0)) for p in _parts(n, "k")]
    in_own, in_keys = F.forall("_tf", lambda x: x > 0), F.forall("_tfk", lambda x: x > 0)
    whole = F.when(in_own, _sum(own)).otherwise(F.lit(0.0)) + F.when(in_keys, _sum(keys)).otherwise(F.lit(0.0))
    legs = [F.when(in_own | in_keys, F.struct(F.lit(-1).alias("leg"), whole.alias("ft_score")))]
    if fallback and n > 1:
        legs += [F.when((F.col("_tf")[i] > 0) | (F.col("_tfk")[i] > 0), F.struct(F.lit(i).alias("leg"), (own[i] + keys[i]).alias("ft_score"))) for i in range(n)]
    return _best_leg(scored.select(*facts.columns, F.inline(F.array_compact(F.array(*legs)))), limit).select(*facts.columns, "ft_score")


def _best_leg(rows: DataFrame, limit: int) -> DataFrame:
    """rows: of each leg, the one of all terms (-1) and those of single terms. The best of the first, or of the others
    if it is empty, each fact at its first term."""
    order = [F.col("ft_score").desc(), F.col("t_valid").desc(), F.col("fact_id")]
    few = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("leg").orderBy(*order))).where(F.col("_rn") <= limit)
    first = F.row_number().over(Window.partitionBy("fact_id").orderBy("leg", "_rn"))
    best = F.min("leg").over(Window.partitionBy())  # over limit x (terms + 1) rows at most
    chosen = few.withColumns({"_first": first, "_best": best}).where((F.col("_first") == 1) & ((F.col("_best") >= 0) | (F.col("leg") < 0)))
    return chosen.orderBy(*order).limit(limit)


def search_facts_indexed(facts: DataFrame, active: Column, query: str, limit: int, content, keys, fallback: bool = True) -> DataFrame:
    """search_facts over two stored indexes (FullTextIndex of fact_id), one of the content and one of the index keys: only
    the folders of the query's terms are read, and of the facts those that hold one of them. Words match by stem. Scores have nine
    decimals, so that the order does not hang on the order of sums."""
    terms = content.terms_of(query)
    if not terms:
        return facts.withColumn("ft_score", F.lit(0.0)).limit(0)
    each = content.parts(terms).withColumn("own", F.lit(True)).unionByName(keys.parts(terms).withColumn("own", F.lit(False)))
    full = each.groupBy("key", "own").agg(F.count("*").alias("n"), F.sum("part").alias("part")).where(F.col("n") == len(terms)).groupBy("key").agg(F.round(F.sum("part"), 9).alias("ft_score")).withColumn("leg", F.lit(-1))
    legs = full
    if fallback and len(terms) > 1:
        at = F.array_position(F.array(*[F.lit(t) for t in sorted(terms)]), F.col("term")).cast("int") - 1
        legs = full.unionByName(each.groupBy("key", at.alias("leg")).agg(F.round(F.sum("part"), 9).alias("ft_score")))
    hits = facts.where(active).select("fact_id", "t_valid").join(legs.withColumnRenamed("key", "fact_id"), "fact_id")  # narrow: no text is moved for a rank
    best = _best_leg(hits, limit).select("fact_id", "t_valid", "ft_score")
    return facts.where(active).join(F.broadcast(best), ["fact_id", "t_valid"]).select(*facts.columns, "ft_score")  # limit rows


def with_fallback(primary: DataFrame, each_term: list[DataFrame], key: str, order: list[Column]) -> DataFrame:
    """primary, or if it is empty the hits of single terms, each key once, at its first term and best place."""
    if not each_term:
        return primary
    union = None
    for k, hits in enumerate(each_term):
        ranked = hits.withColumn("_term", F.lit(k))
        union = ranked if union is None else union.unionByName(ranked)
    once = union.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy("_term", *order))).where("_rn = 1").drop("_rn", "_term")
    some = primary.limit(1).select(F.lit(1).alias("_some"))
    return primary.unionByName(once.join(some, F.lit(True), "left_anti").select(*primary.columns))
