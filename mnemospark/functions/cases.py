"""Expressions that prepare external evaluation cases and tool arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
TEMPORAL_QUESTIONS = (r"how many days?\s+(before|after|between)", r"how long\s+(had|did|have)", r"how many months?\s+(before|after|between)",
                      r"how many weeks?\s+(before|after|between)", r"which.*first", r"which.*last", r"which.*earlier", r"which.*later", r"what.*date.*when", r"what time.*on")
RELATION_QUESTIONS = (r"who.*knows", r"who.*introduce", r"relationship", r"connected", r"introduction")
DEFAULT_DATE = "2026-03-01T09:00:00Z"


def _any(c: Column, patterns) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def question_tier(question: str, sessions: str) -> Column:
    """temporal, graph (only over more than two sessions) or direct. The tier alias cannot come out: the words that
    would decide it are compared in lower case."""
    q = F.lower(question)
    return F.when(_any(q, TEMPORAL_QUESTIONS), "temporal").when((F.size(sessions) > 2) & _any(q, RELATION_QUESTIONS), "graph").otherwise("direct")


def case_date(raw: str) -> Column:
    """RFC 3339 as it is; "2023/05/30 (Tue) 22:10" converted; anything else the default."""
    c = F.col(raw)
    parts = r"^(\d{4})/(\d{2})/(\d{2})\s+\(\w+\)\s+(\d{2}):(\d{2})"
    made = F.regexp_replace(F.regexp_extract(c, "(" + parts[1:] + ")", 1), parts, "$1-$2-$3T$4:$5:00Z")
    return F.when(c.contains("T") & c.contains("Z"), c).when(c.rlike(parts), made).otherwise(F.lit(DEFAULT_DATE))


def context_items(raw: str) -> Column:
    """A JSON array of episode ids, objects or other values as structs (fact_id, content, quote, source_episode)."""
    values = F.from_json(raw, "array<string>")

    def item(v: Column) -> Column:
        is_object = F.coalesce(v.startswith("{"), F.lit(False))
        get = lambda *names: F.coalesce(*[F.get_json_object(v, f"$.{n}") for n in names])
        of_object = F.struct(get("factId", "fact_id").alias("fact_id"), F.coalesce(get("content"), F.lit("")).alias("content"), F.coalesce(get("quote"), F.lit("")).alias("quote"),
                             F.coalesce(get("sourceEpisode", "source_episode", "id"), F.lit("")).alias("source_episode"))
        other = v.isNull() | v.rlike(r"^(-?[0-9.]+([eE][-+]?[0-9]+)?|true|false|\[.*\])$")
        of_text = F.struct(F.lit(None).cast("string").alias("fact_id"), F.lit("").alias("content"), F.lit("").alias("quote"), F.when(other, "").otherwise(v).alias("source_episode"))
        return F.when(is_object, of_object).otherwise(of_text)

    return F.transform(values, item)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
