"""Faults that reviews found, each by the least input that shows it."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberleaf.functions import fingerprint as fp
from emberleaf.functions import text as t
from emberleaf.operators import fingerprints, graph, merkle, search, store, supersession, vector_search


def test_trimmed_lines_keep_their_digits(spark):
    """The index of a line is not what is trimmed from it."""
    text = "0 calls went to line 555-8630\n1 call went to line 555-8631"
    row = spark.range(1).select(F.lit(text).alias("a")).select(t.summarize_text("a").alias("text"), t.summarize_markdown("a").alias("md"), t.ingest_summary("a", F.lit("x/a.md")).alias("ingest"), t.headers(F.lit("# 0 of 100\n## 1 of 11")).alias("h")).first()
    line = text.split("\n")[0]
    assert row["text"] == row["md"] == line and row["ingest"] == f"a.md: {line}" and row["h"] == ["0 of 100", "1 of 11"]


def test_verification_names_all_failures(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 2 == 0).alias("ok"))
    got = store.verification(rows, "id").first()
    assert (got["total"], got["passed"], got["failed"]) == (3000, 1500, 1500)
    assert got["failures"] == ",".join(str(i) for i in range(1, 3000, 2))


def test_leaves_are_numbered_once(spark):
    """Every leaf comes out under its own number, though one side of the numbering needs fewer columns."""
    n = 60_000
    got = merkle.numbered(spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")), "h", "id").toPandas()
    assert len(got) == n and (got.idx == got.id).all() and sorted(got.idx) == list(range(n)) and got.hash.nunique() == n


@pytest.mark.parametrize("few", [0, 5, 200])
def test_supersession_of_small_and_large_kinds(spark, monkeypatch, few):
    """By brute force, whether kinds are compared whole or by prefixes; small ones take no more rows than pairs of one kind."""
    monkeypatch.setattr(supersession, "FEW", few)
    rng = np.random.default_rng(3)
    rows = [(i, f"k{rng.integers(8) ** 2 // 8}", sorted({f"t{x}" for x in rng.integers(0, 6, rng.integers(1, 6))}), f"2026-01-{rng.integers(1, 20):02}") for i in range(160)]
    want = {}
    for i, kind, a, day in rows:
        ok = [(-len({*a} & {*b}) / len({*a} | {*b}), d, j) for j, k, b, d in rows if k == kind and d < day and len(a) > 1 and len(b) > 1]
        ok = [x for x in ok if -x[0] >= 0.7]
        if ok:
            best = min(x[0] for x in ok)
            last = max(d for s, d, _ in ok if s == best)
            want[i] = (min(j for s, d, j in ok if (s, d) == (best, last)), -best)
    got = supersession.register(spark.createDataFrame(rows, "id long, kind string, terms array<string>, created_date string")).collect()
    assert {r["new_id"]: (r["old_id"], r["similarity"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("common", [1, 2, 100])
def test_weighted_simhash_in_pieces(spark, monkeypatch, common):
    """By brute force: words beyond those that all tasks hold, texts shorter than a window, more characters than fit 16 bits."""
    monkeypatch.setattr(fingerprints, "COMMON", common)
    monkeypatch.setattr(fingerprints, "CHARS", 50)
    many = "".join(chr(0x4E00 + i) for i in range(20_000)) + "".join(chr(0x20000 + i) for i in range(46_000))
    texts = {1: "alpha beta beta gamma", 2: "", 3: "abc", 4: "Delta alpha \u00e4\U0001f600 delta" * 9, 5: None, 6: "\u00e4b", 7: many}
    idf = {"alpha": 1.2, "beta": 2.5, "gamma": 1.2, "delta": 7.25}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    rows = fingerprints.weighted_simhash(docs, "id", "text", spark.createDataFrame(list(idf.items()), "term string, idf double"))
    got = {r["id"]: r["hex"] for r in rows.select("id", fp.to_hex(F.col("fingerprint")).alias("hex")).collect()}
    words = {r["id"]: r["w"] for r in docs.select("id", t.fingerprint_tokens("text").alias("w")).collect()}
    assert got.keys() == texts.keys()
    bits = lambda w: np.unpackbits(np.frombuffer(hashlib.sha256(w.encode()).digest(), np.uint8)).astype(float) * 2 - 1
    for i, text in texts.items():
        low = (text or "").lower()
        grams = [low[k : k + 4] for k in range(len(low) - 3)] or [low]
        votes = sum(0.7 * idf.get(w, 1.0) * bits(w) for w in words[i]) + sum(bits(g) for g in grams) * 0.3 / len(grams)
        assert got[i] == np.packbits(np.round(votes, 9) >= 0).tobytes().hex(), i


def test_graph_search_misses_no_row(spark):
    """Against all vectors, with so narrow a beam that walks alone miss rows; equal vectors go by id."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 64)).round(3)
    x[800:810] = x[:10]
    rows = spark.createDataFrame([(i, "hot", e.tolist()) for i, e in enumerate(x)], "id long, tier string, e array<double>")
    tiers = {"hot": (64, "float")}
    index = vector_search.graph_index(rows, "id", "e", "tier", tiers).collect()
    index = spark.createDataFrame(index, "tier string, shard int, data binary")
    for q in rng.standard_normal((3, 64)):
        cos = ((x / np.linalg.norm(x, axis=1, keepdims=True)) * (q / np.linalg.norm(q))).sum(1).round(12)
        want = np.lexsort((np.arange(900), -cos))[:10].tolist()
        assert [r["id"] for r in vector_search.graph_search(index, q.tolist(), 10, 10, tiers).collect()] == want


def test_term_counts_by_brute_force(spark):
    text = "Data data the the of ab abc-ABC_def 12 123 " + " ".join(f"w{i}" for i in range(50))
    got = spark.range(1).select(t.term_counts(F.lit(text)).alias("a"), t.ranked_keywords(F.lit(None).cast("string")).alias("b")).first()
    assert [(r["n"], r["term"]) for r in got["a"]][:4] == [(2, "abc"), (2, "data"), (1, "123"), (1, "def")] and len(got["a"]) == 30 and got["b"] == []


@pytest.mark.parametrize("block", [60, 2_000_000])
def test_keyword_edges_in_blocks(spark, monkeypatch, block):
    """By brute force, with text keys, whether all rows meet in one task or blocks in several."""
    monkeypatch.setattr(graph, "BLOCK_WORDS", block)
    rng = np.random.default_rng(2)
    sets = {f"c{i}": {f"w{x}" for x in rng.integers(0, 60, rng.integers(0, 8))} for i in range(60)}
    rows = spark.createDataFrame([(i, sorted(k)) for i, k in sets.items()], "id string, k array<string>")
    n = {w: sum(w in k for k in sets.values()) for k in sets.values() for w in k}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and any(2 <= n[w] <= 5 for w in sets[a] & sets[b])}
    got = graph.keyword_edges(rows, "id", "k", 0.2, 5).collect()
    assert {(r["a"], r["b"]): r["overlap"] for r in got} == {p: s for p, s in want.items() if s >= 0.2} and len(got) == len({(r["a"], r["b"]) for r in got}) > 10


def test_best_shared_by_brute_force(spark, monkeypatch):
    """More passages than are counted at once, ties, a passage without words and one that no text shares."""
    monkeypatch.setattr(search, "TOGETHER", 3)
    rng = np.random.default_rng(4)
    docs = {i: sorted({f"w{x}" for x in rng.integers(0, 12, 6)}) for i in range(700)}
    asked = {i: sorted({f"w{x}" for x in rng.integers(0, 12, 5)}) for i in range(5)} | {5: [], 6: ["none"]}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, w array<string>")
    got = search.best_shared(frame(docs), "id", "w", frame(asked).withColumnRenamed("id", "p"), "p", "w", 4).collect()
    want = {(p, r + 1, i, -n) for p, a in asked.items() for r, (n, i) in enumerate(sorted((-len({*a} & {*w}), i) for i, w in docs.items())[:4]) if n}
    assert {(r["p"], r["r"], r["id"], r["matched"]) for r in got} == want and len(got) == len(want)
