"""Spans of tokens: overlapping windows, decoding of a model's logits, suppression of overlaps.

A model's weights stay outside: it brings a column of logits. What is done here is what lies around it.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import travels

travels(__name__)

SPAN_WIDTH, WINDOW_SHARE = 12, 8


def windows(texts: DataFrame, size: int) -> DataFrame:
    """texts: id, offsets (array of start and end of each token). A row for each window of size tokens: id, first (place of
    its first token) and its offsets; windows overlap by an eighth. A text without tokens has none."""
    step = max(1, size - size // WINDOW_SHARE)
    starts = F.when(F.size("offsets") > 0, F.sequence(F.lit(0), F.size("offsets") - 1, F.lit(step)))
    return texts.select("id", "offsets", F.explode(starts).alias("first")).select("id", "first", F.slice("offsets", F.col("first") + 1, F.lit(size)).alias("offsets"))


def enumerated(n: Column, width: int = SPAN_WIDTH) -> Column:
    """All spans of up to width of n tokens, as (first, last), in order of first and last."""
    each = lambda a: F.transform(F.sequence(a, F.least(a + (width - 1), n - 1)), lambda b: F.struct(a.alias("first"), b.alias("last")))
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), each))).otherwise(F.array().cast("array<struct<first:int,last:int>>"))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double")))


def decode(scored: DataFrame, labels: list[str], threshold: float = 0.5, width: int = SPAN_WIDTH) -> DataFrame:
    """scored: id, text, offsets of a window and logits (for each of its spans, in the order of enumerated(), one number for
    each label). Spans whose probability reaches the threshold: (id, label, start, end, text, score), those of several
    windows once, with their best score. Spans of blank text, and beyond the text, are left out; logits without a label
    are not read."""
    pairs = F.arrays_zip(enumerated(F.size("offsets"), width).alias("span"), F.col("logits").alias("row"))
    spans = scored.select("id", "text", "offsets", F.inline(pairs)).where("span IS NOT NULL AND row IS NOT NULL")
    at = spans.select("id", "text", F.get("offsets", F.col("span.first"))["start"].alias("start"), F.get("offsets", F.col("span.last"))["end"].alias("end"), F.posexplode("row").alias("k", "logit")).where(F.col("k") < len(labels))
    named = at.withColumns({"score": sigmoid(F.col("logit")), "label": F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("k") + 1)})
    good = (F.col("score") >= threshold) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("text"))
    own = named.where(good).withColumn("text", F.trim(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))).where("text <> ''")
    return own.groupBy("id", "label", "start", "end").agg(F.first("text").alias("text"), F.max("score").alias("score"))


def names_of(scored: DataFrame, labels: list[str], threshold: float = 0.5, width: int = SPAN_WIDTH) -> DataFrame:
    """Candidates for entities (id, entity_type, canonical_name), distinct: decoded spans of all windows of a text without
    those that a better one of their label overlaps."""
    found = decode(scored, labels, threshold, width)
    kept = suppress_overlaps(found.drop("text"), ["id"])
    return kept.join(found.select("id", "label", "start", "end", "text"), ["id", "label", "start", "end"]).select("id", F.col("label").alias("entity_type"), F.col("text").alias("canonical_name")).distinct()


def greedy(start: np.ndarray, end: np.ndarray, score: np.ndarray, most: float) -> np.ndarray:
    """Places of the spans that greedy suppression keeps: best score first, ties by start and end.

    Kept spans lie in bins by length (powers of two) and start. One that overlaps by IoU above `most` is shorter or longer
    by a factor of 1 / most at most and starts nearby, so a span looks at a few bins, and kept spans of a bin are few,
    since they do not overlap each other much."""
    reach = math.ceil(math.log2(1 / most)) if most > 0 else 64
    bins: dict[tuple[int, int], list[int]] = defaultdict(list)
    classes: set[int] = set()
    kept = []
    s, e = start.tolist(), end.tolist()
    for i in np.lexsort((end, start, -score)).tolist():
        a, b = s[i], e[i]
        own = int(b - a).bit_length()
        free = True
        for c in range(max(0, own - reach), own + reach + 1):
            if c not in classes:
                continue
            w = 1 << c
            for at in range((a - w) // w, (b - 1) // w + 1):
                for k in bins.get((c, at), ()):
                    inter = min(b, e[k]) - max(a, s[k])
                    if inter > 0 and inter / (b - a + e[k] - s[k] - inter) > most:
                        free = False
                        break
                if not free:
                    break
            if not free:
                break
        if free:
            kept.append(i)
            classes.add(own)
            bins[own, a // (1 << own)].append(i)
    return np.array(kept, np.int64)


def _changed(column: pa.Array) -> np.ndarray:
    """For each row but the first: differs from the row before."""
    x, y = column.slice(0, len(column) - 1), column.slice(1)
    same = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y)))
    return ~same.to_numpy(zero_copy_only=False)


def _chains(new: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where a chain of overlapping spans begins, in rows sorted by group, start and end; new: where a group begins."""
    group = np.cumsum(new) - 1
    low, high = int(start.min()), int(max(start.max(), end.max()))
    wide = high - low + 1
    if wide * (int(group[-1]) + 1) < 1 << 62:  # each group in a range of its own, so that one pass has the highest end before each
        shift = (group * wide).astype(np.int64) - low
        top = np.maximum.accumulate(np.maximum(start, end) + shift)
        return new | np.r_[True, (start + shift)[1:] >= top[:-1]]
    out, starts = new.copy(), [*np.flatnonzero(new), len(new)]
    for a, b in zip(starts, starts[1:]):
        out[a + 1:b] |= start[a + 1:b] >= np.maximum.accumulate(np.maximum(start[a:b], end[a:b]))[:-1]
    return out


def _kept(first: np.ndarray, start: np.ndarray, end: np.ndarray, score: np.ndarray, most: float) -> np.ndarray:
    """Places of the spans that stay, chain by chain in one go: chains are laid side by side, where they can't meet. A chain
    of one span stays as it is."""
    begins = np.flatnonzero(first)
    size = np.diff(np.r_[begins, len(first)])
    chain = np.cumsum(first) - 1
    many = np.flatnonzero(size[chain] > 1)
    if not len(many):
        return np.arange(len(first))
    low, high = start[begins], np.maximum.reduceat(np.maximum(start, end), begins)
    if float(np.sum(high.astype(float) - low)) + len(begins) < 2.0 ** 62:
        base = np.r_[0, np.cumsum(high - low + 1)[:-1]] - low
        s, e = start[many] + base[chain[many]], end[many] + base[chain[many]]
        own = many[greedy(s, e, score[many], most)]
    else:
        own = np.concatenate([b + greedy(start[b:b + n], end[b:b + n], score[b:b + n], most) for b, n in zip(begins, size) if n > 1])
    return np.sort(np.r_[np.flatnonzero(size[chain] == 1), own])


def _suppressed(names: int, most: float):
    def run(batches):
        held = None
        for batch in batches:
            none = pc.or_(pc.is_null(batch.column(names)), pc.is_null(batch.column(names + 1)))
            if pc.any(none).as_py():  # a span without an end overlaps none
                yield batch.filter(none)
                batch = batch.filter(pc.invert(none))
            if not batch.num_rows:
                continue
            held = pa.concat_batches([held, batch]) if held is not None and held.num_rows else batch
            new = np.zeros(held.num_rows, bool)
            new[0] = True
            for k in range(names):
                new[1:] |= _changed(held.column(k))
            start, end, score = (held.column(names + k).to_numpy(zero_copy_only=False) for k in range(3))
            first = _chains(new, start.astype(np.int64), end.astype(np.int64))
            last = int(np.flatnonzero(first)[-1])  # this chain may go on in the next batch
            if last:
                at = _kept(first[:last], start[:last].astype(np.int64), end[:last].astype(np.int64), score[:last].astype(float), most)
                yield held.take(pa.array(at))
            held = held.slice(last)
        if held is not None and held.num_rows:
            start, end, score = (held.column(names + k).to_numpy(zero_copy_only=False) for k in range(3))
            yield held.take(pa.array(greedy(start, end, score.astype(float), most)))

    return run


def suppress_overlaps(spans: DataFrame, by: list[str], most: float = 0.5) -> DataFrame:
    """Greedy non-maximum suppression of spans (start, end, label, score) within a group and label: best score first, ties
    by start and end; one that overlaps a kept span by IoU above `most` goes.

    Groups stream through a task sorted by start and are cut where no span goes over, so a task holds a batch and a chain
    of overlapping spans, not a group, and settles all chains of a batch together: small groups cost no call of their own."""
    names = [*by, "label"]
    rows = spans.select(*names, "start", "end", "score")
    return rows.repartition(*names).sortWithinPartitions(*names, "start", "end").mapInArrow(_suppressed(len(names), most), rows.schema)
