"""Toxic spans with a linear-chain conditional random field.

Labels mark documents, the field tags words. Word labels are derived first: in a toxic document a word is
toxic if it, or its first letters, are many times as frequent in toxic as in other documents of the sample;
in other documents no word is. The field has the states clean and toxic, a weight for each word, prefix,
suffix and shape, and transition weights; it is trained by gradient ascent on the conditional likelihood.
Forward-backward marginals give the probability of each word; a logistic model of the largest, the second
largest and the sum of them gives the document's score; runs of words above one half are the offending offsets.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, held_out, sliced, small, table, through_python, unused

#: The labelled rows that the model is fitted on: about this many of label 1 and of label 0 at most, and fewer
#: where their texts together would pass SAMPLE_CHARS characters. Rows of any length are drawn alike, and whole.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_CHARS = 1_500, 4_500, 64_000_000
#: Rows of each label in that sample, in the order of a hash, that the field itself is trained on, whole.
FIELD_ROWS, EPOCHS, L2 = 200, 40, 1e-3
_JUNK = re.compile(r"[^\w]+|_+")


def bare(token: str) -> str:
    return _JUNK.sub("", token).lower()


def features(token: str) -> list[str]:
    """Features of a word as it stands in a text."""
    w = bare(token)
    if not w:
        return ["s:none"]
    out = ["w:" + w, "4:" + w[:4], "5:" + w[:5]]
    if w != token.lower():
        out.append("s:marks")
    if any(c.isdigit() for c in w):
        out.append("s:digit")
    return out


def marginals(unary: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, width: int = 128) -> tuple[np.ndarray, np.ndarray, float]:
    """Exact forward-backward over many sequences laid end to end.

    unary: score of state 1 for each word (state 0: zero); first: True where a sequence starts; trans[i, j]
    and start[j]: scores. Returns P(state 1) per word, the expected transitions summed (2 x 2) and the log
    partition summed. The words are cut in `width` columns that are walked side by side: products of
    transition matrices within a row first, then the rows one after another, then the words again.
    """
    n = len(unary)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    rows = -(-n // width)
    m = np.empty((rows * width, 2, 2))
    at = np.ones(rows * width, bool)  # padding starts anew, so it says nothing about the last word
    at[:n] = first
    u = np.zeros(rows * width)
    u[:n] = np.clip(unary, -30, 30)
    m[:, :, 0] = np.where(at[:, None], np.exp(start[0]), np.exp(trans[:, 0])[None, :])
    m[:, :, 1] = np.where(at[:, None], np.exp(start[1]), np.exp(trans[:, 1])[None, :]) * np.exp(u)[:, None]
    # a sequence that ends forgets what follows: going back, its last word starts from (1, 1)
    m = m.reshape(rows, width, 2, 2)

    def times(a, b):  # of 2 x 2 matrices, scaled
        c = np.empty_like(a)
        for i in (0, 1):
            for j in (0, 1):
                c[:, i, j] = a[:, i, 0] * b[:, 0, j] + a[:, i, 1] * b[:, 1, j]
        return c / c.max(axis=(1, 2), keepdims=True)

    whole = m[:, 0] / m[:, 0].max(axis=(1, 2), keepdims=True)
    for k in range(1, width):
        whole = times(whole, m[:, k])
    into, back = np.empty((rows, 2)), np.empty((rows, 2))
    v = np.array([0.5, 0.5])
    for r in range(rows):
        into[r] = v
        v = v @ whole[r]
        v /= v.sum()
    v = np.array([1.0, 1.0])
    for r in range(rows - 1, -1, -1):
        back[r] = v
        v = whole[r] @ v
        v /= v.sum()
    alpha, scale, beta = np.empty((rows, width, 2)), np.empty((rows, width)), np.empty((rows, width, 2))
    v = into
    for k in range(width):
        x, y = v[:, 0] * m[:, k, 0, 0] + v[:, 1] * m[:, k, 1, 0], v[:, 0] * m[:, k, 0, 1] + v[:, 1] * m[:, k, 1, 1]
        scale[:, k] = x + y
        v = np.stack([x, y], 1) / scale[:, k, None]
        alpha[:, k] = v
    v = back
    for k in range(width - 1, -1, -1):
        beta[:, k] = v
        x, y = m[:, k, 0, 0] * v[:, 0] + m[:, k, 0, 1] * v[:, 1], m[:, k, 1, 0] * v[:, 0] + m[:, k, 1, 1] * v[:, 1]
        v = np.stack([x, y], 1) / (x + y)[:, None]
    a, b = alpha.reshape(-1, 2)[:n], beta.reshape(-1, 2)[:n]
    p = a * b
    p /= p.sum(1, keepdims=True)
    inner = np.flatnonzero(~first[1:]) + 1  # words with one before them
    pair = a[inner - 1][:, :, None] * m.reshape(-1, 2, 2)[inner] * b[inner][:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return p[:, 1], pair.sum(0), float(np.log(scale.ravel()[:n]).sum())


class Model:
    """Feature weights, transitions and the document's logistic model; small and picklable."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.trans, self.start = np.zeros((2, 2)), np.zeros(2)
        self.doc = np.array([-9.0, 12.0, 0.0, 0.0])

    def unary(self, token: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(token)) + get("bias", -4.0)


def lexicon(texts: list[str], labels: np.ndarray, ratio: float = 12.0) -> set[str]:
    """Word and prefix features that are `ratio` times as frequent (by documents) in toxic texts as in
    others, and that more toxic texts hold than any feature would by chance (at one in a hundred)."""
    def of(token: str) -> list[str]:
        w = bare(token)
        return ["w:" + w, "4:" + w[:4], "5:" + w[:5]] if len(w) >= 4 else ["w:" + w] if w else []

    toxic_in: dict[str, int] = {}
    for text in (t for t, y in zip(texts, labels) if y):
        for f in {f for token in set(text.split()) for f in of(token)}:
            toxic_in[f] = toxic_in.get(f, 0) + 1
    seen = {f: [0, c] for f, c in toxic_in.items() if c >= 3}  # nothing rarer can pass
    n_features = len(toxic_in)
    del toxic_in
    for text in (t for t, y in zip(texts, labels) if not y):
        for f in {f for token in set(text.split()) for f in of(token)}:
            if f in seen:
                seen[f][0] += 1
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    least = max(3.0, np.log(100 * max(n_features, 2)) / np.log((n0 + n1) / n1))
    found = {f for f, (c0, c1) in seen.items() if c1 >= least and (c1 / n1) >= ratio * (c0 + 0.5) / n0}
    # copies of a toxic document hold all its words: only different neighbours count as different places
    places: dict[str, set] = {f: set() for f in found}
    for text, y in zip(texts, labels):
        if y:
            tokens = ["", *text.split(), ""]
            for before, token, after in zip(tokens, tokens[1:], tokens[2:]):
                for f in of(token) if token else ():
                    if f in places:
                        places[f].add((before, after))
    return {f for f, at in places.items() if len(at) >= least}


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, field_rows: int = FIELD_ROWS, l2: float = L2) -> Model:
    """labels: 0 or 1 per text; the field learns from the first field_rows of each label. One class or no text at
    all: a model that scores everything as clean."""
    model = Model()
    labels = np.asarray(labels, int)
    if not len(texts) or labels.min() == labels.max():
        model.weights = {"bias": -20.0}
        return model
    words = lexicon(texts, labels)
    order = [*np.flatnonzero(labels == 1)[:field_rows], *np.flatnonzero(labels == 0)[:field_rows]]
    index: dict[str, int] = {"bias": 0}
    of_token: dict[str, tuple[list[int], bool]] = {}
    rows, y, first = [], [], []
    for k in order:
        for i, token in enumerate(texts[k].split()):
            hit = of_token.get(token)
            if hit is None:
                fs = features(token)
                hit = of_token[token] = [0, *(index.setdefault(f, len(index)) for f in fs)], any(f in words for f in fs)
            rows.append(hit[0])
            y.append(bool(labels[k]) and hit[1])
            first.append(i == 0)
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate([np.asarray(r) for r in rows]) if rows else np.zeros(0, int)
    word_of = np.repeat(np.arange(len(rows)), lengths)
    y, first = np.array(y, float), np.array(first, bool)
    w, trans, start = np.zeros(len(index)), np.zeros((2, 2)), np.zeros(2)
    w[0] = -2.0
    seen = np.bincount(flat, minlength=len(index)).astype(float)
    rare = seen < 3  # say nothing of other texts
    inner = np.flatnonzero(~first[1:]) + 1
    states = y.astype(int)
    want = np.zeros((2, 2))
    np.add.at(want, (states[inner - 1], states[inner]), 1)
    want_start = np.bincount(states[first], minlength=2)
    mom = [np.zeros_like(w), np.zeros_like(w), np.zeros((2, 2)), np.zeros((2, 2)), np.zeros(2), np.zeros(2)]
    for epoch in range(1, epochs + 1):
        unary = np.bincount(word_of, weights=w[flat], minlength=len(rows))
        p, pairs, _ = marginals(unary, first, trans, start)
        grads = [np.bincount(flat, weights=(y - p)[word_of], minlength=len(index)) / np.sqrt(seen + 1) - l2 * w * np.sqrt(seen + 1),
                 (want - pairs) / len(rows) ** 0.5, (want_start - np.array([(1 - p[first]).sum(), p[first].sum()])) / max(1, first.sum()) ** 0.5]
        grads[0][rare] = 0
        for k, (value, g) in enumerate(zip((w, trans, start), grads)):  # Adam
            mom[2 * k] = 0.9 * mom[2 * k] + 0.1 * g
            mom[2 * k + 1] = 0.98 * mom[2 * k + 1] + 0.02 * g * g
            value += 0.25 * (mom[2 * k] / (1 - 0.9**epoch)) / (np.sqrt(mom[2 * k + 1] / (1 - 0.98**epoch)) + 1e-6)
    model.weights = {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-2 or f == "bias"}
    model.trans, model.start = trans, start
    del rows, y, first, flat, word_of, unary, p, grads, mom, of_token
    known = Scores(model, 100_000)
    x = np.array([doc_signals(p) for part in sliced([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]) for p in batch(model, part.column(0).to_pylist(), known)])
    model.doc = _logistic(np.c_[np.ones(len(x)), x], labels.astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1, rounds: int = 60) -> np.ndarray:
    """Newton steps, halved until the penalised loss falls."""

    def loss(b):
        z = x @ b
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * l2 * b @ b

    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - l2 * b)
        while np.abs(step).max() > 1e-8 and not loss(b + step) < loss(b):
            step /= 2
        b = b + step
        if np.abs(step).max() < 1e-6:
            break
    return b


def doc_signals(p: np.ndarray) -> list[float]:
    """Maximum, second largest and sum (as logarithm) of a document's marginals."""
    if not len(p):
        return [0.0, 0.0, 0.0]
    top = np.partition(p, len(p) - 2)[-2:] if len(p) > 1 else np.array([0.0, p[0]])
    return [float(top[1]), float(top[0]), float(np.log1p(p.sum()))]


class Scores(dict):
    """Scores of the words met so far."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most

    def __missing__(self, token: str) -> float:
        x = self.model.unary(token)
        if len(self) < self.most:  # the words met first are the frequent ones; rare ones need no place
            self[token] = x
        return x


def batch(model: Model, texts: list[str], known: Scores) -> list[np.ndarray]:
    """The marginals of each text's words."""
    unary, lengths = [], []
    for t in texts:
        tokens = t.split()
        lengths.append(len(tokens))
        unary.append(np.fromiter(map(known.__getitem__, tokens), float, len(tokens)))
    ends = np.cumsum(lengths)
    u = np.concatenate(unary) if unary else np.zeros(0)
    first = np.zeros(len(u), bool)
    first[[e - n for e, n in zip(ends, lengths) if n]] = True
    p = marginals(u, first, model.trans, model.start)[0]
    return [p[e - n:e] for e, n in zip(ends, lengths)]


def spans_of(text: str, p: np.ndarray, least: float = 0.5) -> list[dict]:
    """Character offsets (start, end) of runs of words whose marginals are `least` or more."""
    out: list[dict] = []
    last = -2
    for k, m in enumerate(re.finditer(r"\S+", text)):
        if k < len(p) and p[k] >= least:
            if last == k - 1:
                out[-1]["end"] = m.end()
                out[-1]["score"] = max(out[-1]["score"], float(p[k]))
            else:
                out.append({"start": m.start(), "end": m.end(), "score": float(p[k])})
            last = k
    return out


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, sample_chars: int = SAMPLE_CHARS, seed: int = 5) -> Model:
    """Fits on a bounded sample of labelled rows outside the held-out fifth. Null labels and texts teach
    nothing; of several labels of a document the largest holds, of several texts the least."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    sizes = docs.where("text IS NOT NULL").select("doc_id", F.length("text").alias("n")).join(known, "doc_id")
    h = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40))
    limit = F.lit(0)
    for r in sizes.groupBy("toxic").agg(F.count("*").alias("rows"), F.sum("n").alias("chars")).collect():  # two rows at most
        rate = min(1.0, (toxic_rows if r["toxic"] else clean_rows) / r["rows"], sample_chars / 2 / max(1, r["chars"]))
        limit = F.when(F.col("toxic") == r["toxic"], F.lit(int(rate * (1 << 40)))).otherwise(limit)
    picked = known.where(h < limit)
    got = (docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # toxic_rows + clean_rows narrow rows, about
           .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).withColumn("h", F.xxhash64(F.lit(seed + 1), "doc_id")).collect())
    got.sort(key=lambda r: (r["h"], r["doc_id"]))
    texts, toxic = [r["text"] for r in got], np.array([int(r["toxic"]) for r in got])
    del got
    model = fit(texts, toxic)
    del texts
    give_back()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1), spans (start, end, score; character offsets).

    Null and empty texts get the score of a text without words and no spans. Repeated rows repeat; an empty
    table gives an empty result; other columns are not read.
    """
    return _scored(docs, model)[0]


def _scored(docs: DataFrame, model: Model) -> tuple:
    """score()'s result and its broadcast model, which may be destroyed when the result is written."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # bounded by the training sample

    def work():
        model = Model()
        vars(model).update(shared.value)
        known = Scores(model)

        def each(part: pa.RecordBatch) -> dict:
            texts = [t or "" for t in part.column(1).to_pylist()]
            mine = batch(model, texts, known)
            x = np.array([doc_signals(q) for q in mine]).reshape(-1, 3)
            z = np.c_[np.ones(len(x)), x] @ model.doc
            return {"doc_id": part.column(0), "score": 1 / (1 + np.exp(-np.clip(z, -30, 30))),
                    "spans": [spans_of(t, q) if len(q) and q.max() >= 0.5 else [] for t, q in zip(texts, mine)]}

        return each

    return through_python(docs.select("doc_id", "text"), work, f"doc_id {kind}, score double, spans array<struct<start:int,end:int,score:double>>"), shared


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that the model rejects (score of one half or more); columns unchanged, whatever
    their names. A row without doc_id is scored, too: it is matched by its text's hash. Null and empty texts score
    as texts without words. Repeated rows share their fate; without labels nothing goes; an empty table stays
    empty."""
    key, theirs = unused(docs, "key", "bad")
    model = train(docs, labels)
    flagged = docs.withColumn(key, F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")))
    scored, shared = _scored(flagged.select(F.col(key).alias("doc_id"), "text"), model)
    bad = small(scored.where("score >= 0.5").select(F.col("doc_id").alias(theirs)).distinct())
    shared.destroy()
    return flagged.join(bad, F.col(key).eqNullSafe(F.col(theirs)), "left_anti").drop(key)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         F.size("spans").alias("n_spans"), "spans")
