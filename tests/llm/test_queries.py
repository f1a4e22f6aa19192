"""The registered queries themselves: contract columns recomputed by plain code on the smallest tables."""

import re
import time
import zlib
from collections import defaultdict

import pytest

from mnemospark.llm import html_text, licenses
from mnemospark.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
CRC = lambda i: zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1(spark, docs):
    rows = QUERIES["op1_sharding"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    slots = defaultdict(list)
    for r in rows:
        data = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 8, zlib.crc32(data), "key") and 0 <= r["shard"] < 24
        assert r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op2_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = QUERIES["op2_language_id"](spark, d).collect()
    assert len(rows) == len(langs) and all(r["held_out"] == CRC(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, langs[r["doc_id"]][1] or ""))) for r in rows)
    asked = [r for r in rows if r["held_out"] and langs[r["doc_id"]][0] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == langs[r["doc_id"]][0] for r in asked) >= 0.95 * len(asked)


def test_op3_columns(spark):
    rows = QUERIES["op3_html_text"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) and not re.search(r"  |^\s|\s$|\n\n", r["text"]) for r in rows)


def test_op4_fills_sequences(spark, docs):
    rows = QUERIES["op4_packing"](spark, SF).collect()
    seq, own = defaultdict(list), defaultdict(list)
    for r in rows:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
        own[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    assert set(own) == set(docs) and len(seq) <= -(-sum(r["length"] for r in rows) // 4096) + 1
    for places in (sorted(x) for x in seq.values()):
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 4096
    for pieces in (sorted(x) for x in own.values()):
        assert [(p, s) for p, s, _ in pieces] == [(k, 4096 * k) for k in range(len(pieces))] and all(n == 4096 for _, _, n in pieces[:-1])


def test_op5_columns(spark, docs):
    for r in QUERIES["op5_licenses"](spark, SF).collect():
        line = re.sub("[A-Z]", lambda m: m[0].lower(), docs[r["doc_id"]]["text"] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line)
        at = [(k, label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for k in range(len(words)) if words[k:k + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(at), ",".join(sorted({x for _, x in at})))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_op6_finds_toxic_documents_and_their_offsets(spark):
    d = "/root/testdata/sf0.1"
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = QUERIES["op6_toxicity"](spark, d).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert r["held_out"] == CRC(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 and r["n_spans"] == len(r["spans"])
        assert all(text[r["doc_id"]][s["start"]:s["end"]].strip() for s in r["spans"])
    held = [(toxic[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    found, clean = [p for y, p in held if y == 1], [p for y, p in held if y == 0]
    assert sum(found) >= 0.8 * len(found) and sum(clean) <= 0.01 * len(clean)  # measured: 84 of 97, and 2 of 728


def test_op9_sums(spark, docs):
    rows = QUERIES["op9_mixing"](spark, SF).collect()
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]]["text"] or "")) and r["taken"] <= 2 * r["size"]
        by[docs[r["doc_id"]]["source"]].append(r)
    assert len(rows) == len(docs)
    for own in by.values():
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(1, min(32, own[0]["source_size"] // 64)) / 2 + 1e-6
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op9_mixing"](spark, SF).collect()))


def test_op10_columns(spark, docs):
    rows = QUERIES["op10_simhash"](spark, SF).collect()
    assert len(rows) == len(docs) and all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) and r["component_id"] <= r["doc_id"] for r in rows)


def grows(work, small, large):
    """Seconds for ten times the input over seconds for one, the better of two runs each."""
    def best(x):
        took = []
        for _ in range(2):
            t = time.perf_counter()
            work(x)
            took.append(time.perf_counter() - t)
        return min(took)

    return best(large) / max(best(small), 0.02)


@pytest.mark.parametrize("unit", ["<p>word, text.", "<div><b>", "<b>", "<svg>x", "<td>", "<div><i>a</div></i>"])
def test_long_pages_take_their_share_of_time(unit):
    n = 2_000
    parse = lambda k: html_text.features(html_text.parse(unit * k + "</i>x" * k), html_text.Flags())
    assert grows(parse, n, 10 * n) < 25


@pytest.mark.parametrize("unit", ["under the MIT License, or gpl v2; ", "licensed under the apache license, version 2.0 "])
def test_long_texts_take_their_share_of_time(unit):
    scanner = licenses.Scanner()
    assert grows(lambda k: scanner.scan(unit * k), 2_000, 20_000) < 25


def test_suppression_is_the_plain_one():
    scanner = licenses.Scanner()
    text = "licensed under the apache license, version 2.0; spdx-license-identifier: mit; mit license gpl v3 the gnu general public license v2, https://opensource.org/licenses/mit all rights reserved. é mit license x"
    found = sorted(((m.start(), m.end(), k) for k, r in enumerate(scanner.rules) for m in r.pattern.finditer(text)), key=lambda d: (-scanner.rules[d[2]].priority, d[0] - d[1], d[2], d[0]))
    kept = []
    for d in found:
        if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
            kept.append(d)
    assert sorted(kept) == sorted(scanner.detections(text))
