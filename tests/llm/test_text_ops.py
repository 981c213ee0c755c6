"""Operators on whole texts against brute force, an exact round trip or held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberleaf.llm._graph import components
from emberleaf.llm import class_lm, language_id, minhash_dedup, queries, secret_scan, sentencepiece_codec, source_mix, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(x) -> int:
    return zlib.crc32(str(x).encode())


def test_source_mix_matches_sql(spark, sf):
    duckdb.sql(f"create or replace view documents as select * from '{sf}/documents.parquet'")
    want = duckdb.sql(source_mix.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.op1_source_mix(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


def test_source_mix_totals(spark, sf):
    docs = documents(sf)
    size = {r.doc_id: len(WORD.findall(r.text)) for r in docs.itertuples()}
    source = dict(zip(docs.doc_id, docs.source, strict=True))
    got = queries.op1_source_mix(spark, sf).toPandas()
    sums = Counter()
    for r in got.itertuples():
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        sums[source[r.doc_id]] += r.taken
    target = got.assign(source=got.doc_id.map(source)).groupby("source").target.first()
    assert all(abs(sums[s] - t) < 1 for s, t in target.items())
    assert abs(target.sum() - 1.5 * got["size"].sum()) < 1e-6 * target.sum()


def test_source_mix_edges(odd, none):
    got = source_mix.mix(odd)
    assert got.count() == odd.count() and got.where("size is null or taken is null or target is null").isEmpty()
    assert set(odd.columns) - {"size"} <= set(got.columns)
    out = source_mix.copies(got)
    words = out.select(F.sum(F.regexp_count("text", F.lit(WORD.pattern)))).first()[0]
    assert words == got.agg(F.sum("taken")).first()[0]
    assert source_mix.mix(none).isEmpty()


@pytest.mark.parametrize("edge", [1, 10_000])
def test_source_mix_of_unspaced_texts(spark, monkeypatch, edge):
    """Words of hundreds of characters, whose weights crowd the keys; the range that is sorted is small all the same."""
    monkeypatch.setattr(source_mix, "EDGE_ROWS", edge)
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat(concat('w', repeat('x', 999), ' '), cast(1 + id % 3 as int)) as text", "if(id % 3 = 0, null, concat('s', id % 2)) as source")
    rows = source_mix.stored(source_mix.keyed(docs))
    slim = rows.select("source", "of_", "size", "z_")
    ends = source_mix.cuts(slim.drop("source"), source_mix.targets(slim.select("source", "size")))
    inside = rows.join(ends, "of_").where("z_ >= cut_ and z_ < end_").groupBy("of_").count().collect()
    assert len(inside) == 3 and all(r["count"] <= (1 if edge == 1 else 200) for r in inside)
    got = source_mix.mix(docs, texts=False).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(abs(r["t"] - r["g"]) < 1 and r["over"] <= 0 for r in got)


def test_targets_reshare_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 10)], "source string, size long")
    got = {r["source"]: r["target"] for r in source_mix.targets(sizes).collect()}
    rest = 1.5 * 2020 - 20 - 20
    assert got["a"] == 20 and got[None] == 20
    assert got["b"] == pytest.approx(rest * 2 / 3) and got["c"] == pytest.approx(rest / 3)


def test_language_id_held_out(spark, sf):
    got = queries.op2_language_id(spark, sf).toPandas().merge(documents(sf), on="doc_id")
    assert (got.held_out == (got.doc_id.map(crc) % 3 == 1)).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_id_posterior_by_brute_force(spark):
    train = [("ab ab", "x"), ("cd cd", "y"), ("abcd", "x"), ("dddd", "y")]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(train)], "id long, text string, lang string")
    model = language_id.fit(docs, "text", "lang", "id")

    def bins(text):
        import pyarrow as pa

        return language_id.counted(pa.array([text]))

    count = {x: sum(bins(t) for t, lang in train if lang == x) + 0.5 for x in "xy"}
    logs = np.array([bins("abab cd") @ np.log(count[x] / count[x].sum()) + math.log(0.5) for x in "xy"])
    got = language_id.predict(spark.createDataFrame([("abab cd",)], "text string"), model).first()
    assert got["lang_pred"] == "xy"[logs.argmax()]
    assert got["score"] == pytest.approx(1 / np.exp(logs - logs.max()).sum(), rel=1e-5)


def test_language_id_edges(odd, none):
    model = language_id.fit(odd, "text", "lang", "doc_id")
    got = language_id.predict(odd, model)
    assert got.count() == odd.count() and "a b" in got.columns
    assert {r["lang_pred"] for r in got.where("text is null or trim(text) = ''").collect()} == {"und"}
    empty = language_id.fit(none, "text", "lang", "doc_id")
    assert {r["lang_pred"] for r in language_id.predict(odd, empty).collect()} == {"und"}
    assert language_id.predict(none, model).isEmpty()


def test_language_id_of_many_languages(spark, monkeypatch):
    """More languages than have room for all bins, and rows without ids, of which a share is drawn as of any others."""
    monkeypatch.setattr(language_id, "CELLS", 1 << 14)
    rng = np.random.default_rng(0)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rows = []
    for k in range(12):
        own = rng.permutation(letters)[:6]
        rows += [(None, " ".join("".join(rng.choice(own, 5)) for _ in range(30)), f"l{k}") for _ in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, "text", "lang", "doc_id", sample_rows=8)
    assert model.log_prob.shape == (1024, 12)
    got = language_id.predict(docs, model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.95 * len(got)


def test_toxicity_held_out(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = queries.op4_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert (got.held_out == (got.doc_id.map(crc) % 5 == 0)).all() and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.9
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()


@pytest.mark.parametrize("seed", range(20))
def test_segments_against_brute_force(seed):
    """Ruzzo and Tompa's definition: take the best contiguous part, then the same to its left and right."""
    s = np.random.default_rng(seed).integers(-5, 6, 40).astype(float)
    s += np.arange(40) * 1e-4

    def best(lo, hi):
        found = max(((s[i:j].sum(), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
        if found[0] <= 0:
            return []
        return best(lo, found[1]) + [found[1:]] + best(found[2], hi)

    got = toxicity.segments(s)
    assert [(a, b) for a, b, _ in got] == best(0, 40)
    assert all(x == pytest.approx(s[a:b].sum()) for a, b, x in got)


def test_toxicity_keeps_the_share_of_toxic_rows(spark):
    """Scores of a table with one toxic row in ten, of which the fit draws as many as of the clean ones."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(4000):
        toxic = int(rng.random() < 0.1)
        own = list(rng.choice(words, 12))
        if rng.random() < (0.6 if toxic else 0.15):
            own[5] = "awful"
        rows.append((i, " ".join(own), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    for sample_rows in (400, 10_000):
        model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), sample_rows=sample_rows)
        mean = toxicity.score(docs.select("doc_id", "text"), model).agg(F.avg("score")).first()[0]
        assert mean == pytest.approx(0.1, abs=0.05), sample_rows


def test_toxicity_score_by_brute_force(spark, sf):
    """Scores of whole texts from the fitted numbers, word by word, and evidence from several passages."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    odds = dict(zip(model.keys.tolist(), model.scores.tolist(), strict=True))
    from emberleaf.llm._text import scan

    for r in toxicity.score(docs.limit(40), model).collect():
        words = scan(pa.array([r["text"]]), lower=True, letters=True)
        forms = [f.tolist() for f in toxicity.features(words)]
        s = [next((odds[f[i]] for f in forms[::-1] if f[i] in odds), 0.0) - toxicity.DRIFT for i in range(len(words.start))]
        low = math.log(model.space * max(len(s), 1))
        total, best = np.concatenate([[0.0], np.cumsum(s)]), 0.0
        lowest = np.inf
        for x in total:
            lowest = min(lowest, x)
            best = max(best, x - lowest)
        if sum(model.rate * x[2] > low for x in toxicity.segments(np.array(s))) < 2:
            want = 1 / (1 + math.exp(-(model.slope * (model.rate * best - low) + model.bias)))
            assert r["n_tokens"] == len(s) and r["score"] == pytest.approx(want, rel=1e-6, abs=1e-9)
    law = toxicity.Model(model.keys, model.scores, rate=1.0, space=1.0)
    one, two = law.evidence([9.0], 100), law.evidence([9.0, 8.5], 100)
    assert one == pytest.approx(9 - math.log(100)) and two > one
    assert law.evidence([9.0, 1.0, 2.0], 100) == one and law.evidence([], 0) == 0.0


def test_toxicity_edges(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (6, 0), (7, 1), (8, 1), (9, 0), (None, 1), (10, None)], "doc_id long, toxic int")
    for model in (toxicity.fit(odd, labels), toxicity.fit(odd, labels.where("toxic = 0")), toxicity.fit(none, labels)):
        got = toxicity.score(odd, model)
        assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").isEmpty()
        assert toxicity.score(none, model).isEmpty()


def test_secrets_against_brute_force(spark, sf):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {r["doc_id"]: r for r in queries.op5_secret_scans(spark, sf).collect()}
    for d in documents(sf).itertuples():
        text = d.text or ""
        base = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        kinds = Counter(x[3] for x in base)
        said = [f"{k}:{a}:{b}" for a, _, b, k in sorted(base)]
        r = got[d.doc_id]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (kinds["assign"], kinds["access"], kinds["hex"], sha(",".join(said)))
        assert set(said) <= set(r["spans"].split(","))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('key_part = "Zx81Qp0LmN47"\ndb_password = key_part', ["Zx81Qp0LmN47"]),
        ('api_secret: "ab12" + "Cd34Ef56Gh78"', ["ab12", "Cd34Ef56Gh78"]),
        ("color = blue-green-teal9", []),
        ("password = changeme", []),
        ('client_key = "q7R2v9X4k1Z8"', ["q7R2v9X4k1Z8"]),
        ('a = "Zx81Qp0LmN47"\nb = a\nauthorization = b', ["Zx81Qp0LmN47"]),
    ],
)
def test_assigned_literals(text, want):
    assert [text[a:b] for a, b in secret_scan.literals(text)] == want


def test_literals_of_many_pieces():
    """A key of 100 pieces that reaches its name through a constant, and constants that double 200 times."""
    pieces = [f"Zx{i:03}Qp" for i in range(100)]
    text = "part = " + " + ".join(f'"{x}"' for x in pieces) + "\nsame = part\nprivate_key = same"
    assert [text[a:b] for a, b in secret_scan.literals(text)] == pieces
    lines = ['c0 = "Zx81Qp0LmN47"', *(f"c{i + 1} = c{i} + c{i}" for i in range(2000)), "api_key = c2000", "color = c7"]
    text = "\n".join(lines)
    assert [text[a:b] for a, b in secret_scan.literals(text)] == ["Zx81Qp0LmN47"]


@pytest.mark.parametrize("unit", ["a", "aB3+/", "ab.", "a ", "a=", 'a="', "a:'", "token ", "password=", "AKIA", "0f", "k=v+", "\\"], ids=repr)
def test_secrets_in_linear_time(unit):
    """A megabyte of one unbroken run, or of one piece of syntax again and again."""
    began = time.perf_counter()
    secret_scan.scan_text("x=1 " + unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - began < 10
    began = time.perf_counter()
    secret_scan.scan_text("a" * 1_000_000 + " b:c")
    assert time.perf_counter() - began < 1


def test_secrets_edges(odd, none):
    got = secret_scan.find_secrets(odd, replacement="*")
    assert got.count() == odd.count() and got.where("n_assign is null or base is null or spans is null").isEmpty()
    assert got.where("text is null").count() == 2
    assert secret_scan.find_secrets(none).isEmpty()
    assert secret_scan.masked("x token=abcdef1 y", [(2, 15, "assign"), (8, 15, "literal")], "*") == "x * y"


def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_sentencepiece_matches_the_library(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    got = {r["doc_id"]: r for r in queries.op7_sentencepiece(spark, sf).collect()}
    for d in documents(sf).itertuples():
        ids = sp.encode(d.text or "")
        assert (got[d.doc_id]["n_tokens"], got[d.doc_id]["ids_sha256"], got[d.doc_id]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_sentencepiece_odd_texts(odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    with open(model_path(), "rb") as f:
        coder = sentencepiece_codec.Codec(f.read())
    rng = np.random.default_rng(5)
    texts = ["", " ", "   a", "a   ", "\n\n\t", "▁", "▁▁ a▁b", "x" * 5000, "ab" * 3000, "é漢字\U0001f600́", "<s></s><unk><0x41>", "\x00\x01", "﻿a", "a b", " ▁ ", "Ωmega ١٢٣"]
    texts += ["".join(chr(c) for c in rng.choice([32, 97, 98, 101, 116, 9601, 10, 233, 0x4E2D, 0x1F600, 48], n)) for n in range(1, 200)]
    texts += ["".join(chr(c) for c in rng.integers(32, 0x2FFF, 60)) for _ in range(100)]
    for t in texts:
        want = sp.encode(t)
        assert coder.encode(t) == want, t
        assert coder.decode(want) == sp.decode(want), t
    got = sentencepiece_codec.encode(odd, model_path())
    assert got.count() == odd.count() and got.where("n_tokens <> size(ids)").isEmpty()
    assert sentencepiece_codec.encode(none, model_path()).isEmpty()


def shingled(text, n):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def linked_groups(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_pairs(texts, n):
    sets = {i: shingled(t, n) for i, t in texts.items()}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    both = Counter((a, b) for v in by.values() for k, a in enumerate(v) for b in v[k + 1 :])
    return sets, [p for p, c in both.items() if 100 * c >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - c)]


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_near_duplicates_against_brute_force(spark, sf, size):
    sf = sf.replace("0.001", size)
    d = documents(sf)
    sets, links = near_pairs(dict(zip(d.doc_id, d.text, strict=True)), 4)
    want = linked_groups(list(sets), links)
    got = queries.op8_minhash_dedup(spark, sf).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(d)
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (want[r["doc_id"]] == r["doc_id"]) for r in got)


def test_near_duplicates_of_edited_texts(spark):
    """Variants of a few texts at all similarities around the threshold, many at it exactly."""
    rng = np.random.default_rng(3)
    texts = {}
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(20, 90)))]
        for _ in range(25):
            own = list(base)
            for _ in range(int(rng.integers(0, 6))):
                own[int(rng.integers(len(own)))] = f"n{rng.integers(1e9)}"
            texts[len(texts)] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.groups(docs, words=5).collect()}
    assert got == linked_groups(list(texts), near_pairs(texts, 5)[1])


def dealt_links(spark, links, parts):
    return spark.createDataFrame(spark.sparkContext.parallelize([(int(a), int(b)) for a, b in links], parts), "a long, b long")


@pytest.mark.parametrize(("parts", "held"), [(1, 1 << 20), (8, 1 << 20), (64, 1 << 20), (8, 20)])
def test_components_over_tasks(spark, parts, held):
    """Links by brute force however they are dealt; a star's centre may reach a smaller node by way of its members."""
    rng = np.random.default_rng(parts)
    links = [(5, 300), (0, 300), *((int(a), int(b)) for a, b in rng.integers(1000, 1200, (140, 2)) if a != b)]
    want = {i: c for i, c in linked_groups(sorted({x for p in links for x in p}), links).items() if i != c}
    got = components(dealt_links(spark, links, parts), held).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


def test_components_of_a_chain(spark, monkeypatch):
    """Rounds grow with the logarithm of a chain, and a hot node is dealt over tasks."""
    from emberleaf.llm import _graph, _skew

    rounds, plain = [], _graph._joined
    monkeypatch.setattr(_graph, "_joined", lambda *a: rounds.append(1) or plain(*a))
    monkeypatch.setattr(_skew, "HOT_ROWS", 8)
    rng = np.random.default_rng(0)
    links = [(i, i + 1) for i in rng.permutation(3000)] + [(9000, i) for i in range(8000, 8200)]
    got = {r["node"]: r["component"] for r in components(dealt_links(spark, links, 32), held=200).collect()}
    assert got == {i: 0 for i in range(1, 3001)} | {i: 8000 for i in [*range(8001, 8200), 9000]}
    assert len(rounds) <= 14


def test_near_duplicates_through_a_third(spark):
    """C is near A and B, which are not near each other, in many tasks."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = {}
        for g in range(60):
            base = [f"g{g}w{i}" for i in range(60)]
            texts[3 * g + 2] = " ".join(base)
            texts[3 * g] = " ".join([f"g{g}x", *base[3:]])
            texts[3 * g + 1] = " ".join([*base[:-3], f"g{g}y"])
        docs = spark.createDataFrame(spark.sparkContext.parallelize(list(texts.items()), 8), "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.groups(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == linked_groups(list(texts), near_pairs(texts, 5)[1]) and len(set(got.values())) == 60


def test_near_duplicates_with_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = spark.createDataFrame([(5, a), (9, b), (None, a), (None, b), (None, "c d e f g h"), (None, "c d e f g h")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["component_id"] or 0, r["kept"]) for r in minhash_dedup.groups(rows).collect())
    assert got == [("5", 5, True), ("9", 9, True), ("None", 0, True), ("None", 0, True), ("None", 5, False), ("None", 9, False)]


def test_near_duplicates_of_a_star_over_tasks(spark):
    """Many texts near to one original but not to each other, in more tasks than one."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(600):
        own = list(base)
        for at in rng.choice(50, 4, replace=False) * 4:
            own[at] = f"n{rng.integers(1e12)}"
        texts[i] = " ".join(own if i != 300 else base)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.groups(docs, words=4, task_rows=100).collect()}
    sets = {i: shingled(t, 4) for i, t in texts.items()}
    near = [(300, i) for i in texts if 100 * len(sets[300] & sets[i]) >= 80 * len(sets[300] | sets[i])]
    want = linked_groups(list(texts), near)
    assert len(near) == 600 and got == want


def test_near_duplicates_edges(odd, none):
    got = minhash_dedup.groups(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == odd.count()
    assert by[2]["component_id"] == 1 and by[7]["component_id"] == 1 and not by[7]["kept"]
    assert by[3]["n_shingles"] == by[4]["n_shingles"] == by[5]["n_shingles"] == 0 and by[4]["kept"] and by[5]["kept"]
    assert by[8]["n_shingles"] == by[9]["n_shingles"] == 1
    assert minhash_dedup.groups(none).isEmpty()


def test_class_lm_base_scores(spark, sf):
    sf = sf.replace("0.001", "0.01")
    d = documents(sf)
    words = {r.doc_id: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(r.text or "")] + [None] for r in d.itertuples()}
    count = Counter(w for i, ws in words.items() if crc(i) % 5 != 1 for w in ws)
    total, distinct = sum(count.values()), len(count)
    rows = queries.op9_class_lm(spark, sf).collect()
    assert len(rows) == len(d)
    better = 0
    for r in rows:
        ws = words[r["doc_id"]]
        want = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(w in count for w in ws), total, crc(r["doc_id"]) % 5 == 1)
        assert r["base_score"] == pytest.approx(want, rel=1e-9)
        better += r["held_out"] and r["score"] > r["base_score"]
    assert better > 0.9 * sum(r["held_out"] for r in rows)


def test_class_lm_is_a_distribution(spark):
    """Over all next tokens, with one place for all unseen words, probabilities sum to at most 1 and nearly 1."""
    texts = ["the cat sat", "the dog sat", "a cat ran", "a dog ran far", "the cat ran", ""] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    model, counts = class_lm.fit(docs)
    words = sorted({w for t in texts for w in t.split()})
    asked = spark.createDataFrame([("",), *((w,) for w in words), ("unseen",)], "text string")
    got = {r["text"]: 10 ** r["score"] for r in class_lm.score(asked, model, counts, keep=(F.col("text"),)).collect()}
    step = 10**model.log_step
    assert np.allclose(step.sum(1), 1)
    assert all(0 < p < 1 for p in got.values())
    kept = model.cls != len(step) - 1
    emit = np.bincount(model.cls[kept], 10 ** model.log_emit[kept])
    assert np.allclose(emit[np.unique(model.cls[kept])], 1)


def class_likelihood(n, cls):
    """Of class bigrams with word emissions, but for the part that classes do not change, by brute force."""
    pairs = Counter()
    for a in range(len(n)):
        for b in range(len(n)):
            pairs[cls[a], cls[b]] += n[a, b]
    left, right = Counter(), Counter()
    for (a, b), x in pairs.items():
        left[a] += x
        right[b] += x
    h = lambda c: sum(x * math.log(x) for x in c.values() if x)
    return h(pairs) - h(left) - h(right)


def test_exchange_against_brute_force():
    """No single move raises the likelihood further, and moves of one word at a time gain as foretold."""
    rng = np.random.default_rng(8)
    size, to = 14, 4
    n = rng.poisson(rng.gamma(0.4, 4, (size + 2, size + 2))).astype(float)
    n[:, -2] += 1
    cls = [*class_lm.exchange(n, to, 50), to, to + 1]
    best = class_likelihood(n, cls)
    assert best > class_likelihood(n, [*(np.arange(size) % to), to, to + 1])
    for w in range(size):
        assert all(class_likelihood(n, [*cls[:w], c, *cls[w + 1 :]]) <= best + 1e-6 for c in range(to))
    cls = np.array([*rng.integers(0, to, size), to, to + 1])
    cls[3] = to + 1  # a word without a class
    pairs = np.zeros((to + 2, to + 2))
    np.add.at(pairs, (cls[:, None], cls[None]), n)
    assert class_lm.likelihood(pairs) == pytest.approx(class_likelihood(n, cls))
    code, count, word = [], [], []
    for w in range(size):
        for c in range(to + 2):
            code += [c, to + 2 + c]
            count += [n[cls == c, w].sum(), n[w, cls == c].sum()]
        code.append(2 * (to + 2))
        count.append(n[w, w])
        word += [w] * (2 * (to + 2) + 1)
    got = class_lm.gains(pairs, cls[:size], np.array(word), np.array(code), np.array(count))
    for w in range(size):
        want = np.array([class_likelihood(n, [*cls[:w], c, *cls[w + 1 :]]) for c in range(to)])
        assert np.allclose(got[w] - got[w, 0], want - want[0], atol=0.05)


def test_class_lm_gains_take_few_logarithms(monkeypatch):
    """Gains of many words with small counts and some large ones are those of brute force, without a logarithm for each context and class."""
    rng = np.random.default_rng(9)
    size, to = 600, 30
    every = to + 2
    n = rng.poisson(rng.gamma(0.02, 8, (size + 2, size + 2))).astype(float)
    n[rng.integers(0, size, 40), rng.integers(0, size, 40)] += 200
    n[range(0, 60, 3), range(0, 60, 3)] += 5  # words that follow themselves
    n[:, -2] += 1
    cls = np.array([*rng.integers(0, to, size), to, to + 1])
    cls[:size:5] = to + 1  # words without a class

    def pairs(cls):
        one = np.eye(every)[cls]
        return one.T @ n @ one

    one = np.eye(every)[cls]
    counts = np.concatenate([n.T[:size] @ one, n[:size] @ one, np.diag(n)[:size, None]], 1)
    word, code = np.nonzero(counts)
    logarithms = 0

    def counting(f):
        def run(x, *more, **named):
            nonlocal logarithms
            logarithms += np.size(x)
            return f(x, *more, **named)

        return run

    with monkeypatch.context() as m:
        m.setattr(np, "log", counting(np.log))
        m.setattr(np, "log1p", counting(np.log1p))
        got = class_lm.gains(pairs(cls), cls[:size], word, code, counts[word, code])
    assert logarithms < len(word) * to
    for w in [0, 3, 5, 45, *rng.integers(0, size, 6)]:
        want = np.array([class_lm.likelihood(pairs(np.where(np.arange(size + 2) == w, c, cls))) for c in range(to)])
        assert np.allclose(got[w] - got[w, 0], want - want[0], atol=0.05)


def test_class_lm_table_finds_words():
    """Also words whose hashes share their first bits, and in a table of the end of texts alone."""
    rng = np.random.default_rng(10)
    keys = np.unique(np.concatenate([[class_lm.END], np.uint64(1 << 60) + np.arange(50, dtype=np.uint64), rng.integers(0, 1 << 64, 500, np.uint64), [np.uint64((1 << 64) - 1)]]))
    rank = rng.permutation(len(keys)).astype(np.int32)
    known = dict(zip(keys.tolist(), rank.tolist(), strict=True))
    asked = rng.permutation(np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 1 << 64, 500, np.uint64)]))
    assert class_lm.Table(keys, rank).find(asked).tolist() == [known.get(k, len(keys)) for k in asked.tolist()]
    alone = class_lm.Table(np.array([class_lm.END]), np.zeros(1, np.int32))
    assert alone.find(np.array([class_lm.END, 0, (1 << 64) - 1], np.uint64)).tolist() == [0, 1, 1] and not len(alone.find(np.zeros(0, np.uint64)))


@pytest.mark.parametrize("table", [1 << 20, 40])
def test_class_lm_score_by_brute_force(spark, sf, monkeypatch, table):
    """Probabilities by counting tokens and class transitions one by one, also with words that the table lacks."""
    monkeypatch.setattr(class_lm, "TABLE", table)
    monkeypatch.setattr(class_lm, "SEEDS", 30)
    d = documents(sf).head(120)
    docs = spark.createDataFrame([(int(r.doc_id), r.text) for r in d.itertuples()], "doc_id long, text string")
    model, counts = class_lm.fit(docs.where("doc_id % 4 <> 0"))
    words = {r.doc_id: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(r.text or "")] + [None] for r in d.itertuples()}
    flat = sorted({w for ws in words.values() for w in ws if w is not None})
    hashes, _ = class_lm.tokens(pa.array(flat))
    ranks = dict(zip(flat, model.table.find(hashes[hashes != class_lm.END]).tolist(), strict=True)) | {None: 0}
    every = len(model.log_step)
    cls = lambda w: int(model.cls[ranks[w]]) if ranks[w] < len(model.cls) else every - 1
    train = [ws for i, ws in words.items() if i % 4]
    count = Counter(w for ws in train for w in ws)

    def steps(ws):
        at = every - 2
        for w in ws:
            yield at, cls(w)
            at = cls(w) if cls(w) < every - 1 else at

    pairs, per = Counter(p for ws in train for p in steps(ws)), Counter()
    for w, n in count.items():
        per[cls(w)] += n
    into, total = Counter(), sum(pairs.values())
    of = Counter()
    for (a, b), n in pairs.items():
        of[a] += n
        into[b] += n
    rare = sum(cls(w) == every - 1 for w in count)
    prior = class_lm.TRANSITION_PRIOR
    rows = class_lm.score(docs, model, counts, keep=(F.col("doc_id"),)).collect()
    assert len(rows) == len(d)
    for r in rows:
        want = 0.0
        for w, (a, b) in zip(words[r["doc_id"]], steps(words[r["doc_id"]]), strict=True):
            share = (into[b] + 0.5) / (total + 0.5 * every)
            want += math.log10((pairs[a, b] + prior * share) / (of[a] + prior))
            want += math.log10(count[w] / per[b]) if b < every - 1 else math.log10((count[w] + 0.5) / (per[b] + 0.5 * (rare + 1)))
        assert r["score"] == pytest.approx(want, rel=1e-9)


def test_class_lm_of_ties(spark, monkeypatch):
    """More words of one count than the table holds, and the end of texts beside them."""
    monkeypatch.setattr(class_lm, "TABLE", 4)
    docs = spark.createDataFrame([("a b c d e f a b c d e f",)], "text string")
    model, counts = class_lm.fit(docs)
    assert model.table.find(np.array([class_lm.END])).tolist() == [0] and len(model.count) < 7
    r = class_lm.score(docs, model, counts, keep=(F.lit("x").alias("n_known"),)).collect()[0]
    assert (r["n_tokens"], r["n_known"]) == (13, 13)
    assert r["base_score"] == pytest.approx(12 * math.log10(2.5 / (13 + 0.5 * 8)) + math.log10(1.5 / (13 + 0.5 * 8)))


def test_class_lm_edges(odd, none):
    model, counts = class_lm.fit(odd)
    got = class_lm.score(odd, model, counts, keep=(F.col("doc_id"),))
    assert got.count() == odd.count() and got.where("score is null or score > 0 or base_score is null").isEmpty()
    assert {r["n_tokens"] for r in got.where("doc_id in (3, 4, 5)").collect()} == {1}
    assert class_lm.score(none, model, counts).isEmpty()
    model, counts = class_lm.fit(none)
    got = class_lm.score(odd, model, counts, keep=(F.col("doc_id"),))
    assert got.count() == odd.count() and {(r["n_known"], r["train_tokens"]) for r in got.collect()} == {(0, 0)}


def removed(docs, n=20):
    """Kept words of each document, by brute force."""
    seen, gone = set(), {}
    for i, text in sorted(docs.items()):
        words = WORD.findall(text or "")
        out = set()
        for k in range(len(words) - n + 1):
            w = tuple(words[k : k + n])
            if w in seen:
                out |= set(range(k, k + n))
            seen.add(w)
        gone[i] = (words, out)
    return gone


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_substring_dedup_against_brute_force(spark, sf, size):
    sf = sf.replace("0.001", size)
    d = documents(sf)
    want = removed(dict(zip(d.doc_id, d.text, strict=True)))
    got = queries.op10_substring_dedup(spark, sf).collect()
    assert len(got) == len(d)
    for r in got:
        words, out = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(words), len(out), sha(" ".join(w for k, w in enumerate(words) if k not in out)))


def test_substring_dedup_of_repetitive_texts(spark):
    """Runs of one word, overlapping repeats within a text, and passages at either end."""
    rng = np.random.default_rng(11)
    part = [f"p{i}" for i in range(30)]
    docs = {0: "a " * 100, 1: "a " * 19, 2: "b a " * 40, 3: " ".join(part), 4: " ".join(part[:20]), 5: " ".join(part[:19]), 6: " ".join(["x"] + part[5:25] + ["y"]), 7: "", 8: None}
    for i in range(9, 60):
        docs[i] = " ".join(rng.choice(["a", "b"], int(rng.integers(1, 80))))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.dedup(frame, texts=True).collect()}
    for i, (words, out) in removed(docs).items():
        kept = " ".join(w for k, w in enumerate(words) if k not in out)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(words), len(out), sha(kept)), i
        assert not out or got[i]["kept_text"] == kept


@pytest.mark.parametrize("length", [4, 40, 64])
def test_substring_dedup_of_other_lengths(spark, length):
    """One doubling and several, with passages of all lengths around the one asked for."""
    assert substring_dedup.levels(length) == {4: [2, 4], 20: [10, 20], 40: [10, 20, 40], 64: [8, 16, 32, 64]}[length]
    rng = np.random.default_rng(length)
    passages = [[f"p{k}w{i}" for i in range(n)] for k, n in enumerate((length - 1, length, length + 1, 2 * length + 3, 12, 25))]
    docs = {i: " ".join(w for _ in range(6) for w in [f"d{i}n{rng.integers(1e9)}", *passages[int(rng.integers(6))]]) for i in range(40)}
    frame = spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["kept_sha256"] for r in substring_dedup.dedup(frame, length=length).collect()}
    assert got == {i: sha(" ".join(w for k, w in enumerate(words) if k not in out)) for i, (words, out) in removed(docs, length).items()}


def test_substring_dedup_of_null_ids(spark):
    """Rows without an id come last, each distinct text as a document of its own."""
    part = " ".join(f"w{i}" for i in range(25))
    rows = [(None, part), (None, part), (None, part + " x"), (None, "y " + part), (3, part + " z")]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got) == [(0, 25, 25), (0, 25, 25), (0, 26, 25), (0, 26, 25), (3, 26, 0)]


def test_substring_dedup_edges(odd, none):
    got = substring_dedup.dedup(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_removed"] == 0 and by[2]["n_removed"] == by[2]["n_words"] and by[3]["n_words"] == 0
    assert substring_dedup.dedup(none).isEmpty()
