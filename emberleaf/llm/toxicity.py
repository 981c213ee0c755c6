"""Toxic passages: maximum-scoring segments of token log-odds, calibrated as extreme values.

Tokens get log-odds between toxic and clean documents under Dirichlet priors: a word's prior is
the log-odds of its six-byte prefix, that one's the five-byte prefix's, and so on, so that unseen forms of a
stem share its evidence. Less a drift, the scores make clean text fall; a linear-time scan
finds all maximal segments of each text. A segment is significant by its expected number among
clean texts of the same length (Karlin-Altschul). A document's evidence is the extreme-value score of its best segment or of its
best several ones together, by their sum's law, and a logistic curve over it gives the probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberleaf.llm._spark import bounded, stored
from emberleaf.llm._text import cut, mix, prefixes, scan

PREFIXES = (4, 5, 6)
#: Labelled rows of each class that the model is fitted on, in expectation.
SAMPLE_ROWS = 4000
#: Most features that are broadcast, 16 MB; a sample of this size has fewer, or else its most frequent ones are taken.
FEATURES = 1 << 20
PRIOR, DRIFT, SIGNIFICANT = 1.0, 1.0, 0.01


@dataclass
class Model:
    """keys: sorted feature hashes; scores: their log-odds. rate and space: the extreme-value law; slope and bias: the curve."""

    keys: np.ndarray
    scores: np.ndarray
    rate: float = 1.0
    space: float = 1.0
    slope: float = 0.0
    bias: float = -50.0

    def token_scores(self, w) -> np.ndarray:
        out = np.zeros(len(w.start))
        done = np.zeros(len(w.start), bool)
        if len(self.keys) and len(out):
            for h in features(w)[::-1]:
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = ~done & (self.keys[at] == h)
                out[hit] = self.scores[at[hit]]
                done |= hit
        return out - DRIFT

    def evidence(self, scores: list[float], n: int) -> float:
        """The extreme-value score of a text of ``n`` tokens with segments of ``scores``.

        It is that of the best segment, or the negative logarithm of how likely clean text has the r best ones
        together, halved for each further r, if that is more.
        """
        low = math.log(self.space * max(n, 1))
        best, total = self.rate * max(scores, default=0.0) - low, 0.0
        for r, s in enumerate(sorted((s for s in scores if self.rate * s > low), reverse=True), 1):
            total += self.rate * s - low
            if r > 1:
                best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
        return best

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.bias, -50, 50)))


def features(w) -> list[np.ndarray]:
    """Feature hashes of each token from the shortest prefix to the whole word."""
    return [*prefixes(w, PREFIXES), mix(w.hash + np.uint64(1))]


def segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time."""
    up = np.flatnonzero(s > 0)
    if not len(up):
        return []
    run = np.flatnonzero(np.diff(up, prepend=-2) > 1)
    starts = up[run]
    ends = up[np.append(run[1:], len(up)) - 1] + 1
    total = np.concatenate([[0.0], np.cumsum(s)])
    low: list[float] = []
    high: list[float] = []
    span: list[tuple[int, int]] = []
    link: list[int] = []
    for a, b, left, right in zip(starts.tolist(), ends.tolist(), total[starts].tolist(), total[ends].tolist(), strict=True):
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= left:
                j = link[j]
            if j < 0 or high[j] >= right:
                low.append(left)
                high.append(right)
                span.append((a, b))
                link.append(j)
                break
            left, a = low[j], span[j][0]
            del low[j:], high[j:], span[j:], link[j:]
    return [(a, b, h - x) for (a, b), x, h in zip(span, low, high, strict=True)]


def documents(col: pa.Array, model: Model) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """Number of tokens and maximal segments of each text."""
    for lo, hi in cut(col):
        w = scan(col.slice(lo, hi - lo), lower=True, letters=True)
        s = model.token_scores(w)
        up = np.concatenate([[0], np.cumsum(s > 0)])[w.off]
        for i, (a, b) in enumerate(zip(w.off[:-1].tolist(), w.off[1:].tolist(), strict=True)):
            yield b - a, segments(s[a:b]) if up[i + 1] > up[i] else []


def _karlin(s: np.ndarray) -> float:
    """The positive root of mean(exp(rate * s)) = 1 for scores of clean tokens."""
    if not len(s) or s.max() <= 0:
        return 1.0
    low, high = 1e-3, 1.0
    f = lambda x: np.exp(np.minimum(x * s, 300)).mean()
    while f(high) < 1 and high < 64:
        high *= 2
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton steps, with a small ridge and smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y, (pos + 1) / (pos + 2), 1 / (neg + 2))
    m, sd = x.mean(), x.std() + 1e-9
    z = np.stack([(x - m) / sd, np.ones(len(x))], 1)
    b = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, z.T @ (t - p) - 1e-3 * b)
        b += np.clip(step, -2, 2)
    slope = max(b[0], 0.0) / sd
    return slope, b[1] - slope * m


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of documents and their 0/1 labels.

    About ``sample_rows`` rows of each class are drawn by a hash of the id, all where there are
    fewer; a bounded set of ids, it is broadcast to the documents. Rows with a null id, label or
    text teach nothing; an id with several labels counts as labelled if any is 1. Without rows of both classes the
    model scores everything 0.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), (F.col(label) > 0).cast("int").alias("y"), (F.crc32(F.concat(F.lit("fit:"), F.col(key).cast("string"))) / 2.0**32).alias("u"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    empty = Model(np.zeros(0, np.uint64), np.zeros(0))
    if len(sizes) < 2:
        return empty
    drawn = known.where(F.when(F.col("y") == 1, F.col("u") < sample_rows / sizes[1]).otherwise(F.col("u") < sample_rows / sizes[0]))
    drawn = drawn.groupBy("id").agg(F.max("y").alias("y"))
    rows = bounded(docs).where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(drawn), "id")
    rows = stored(rows.select("text", "y", (F.crc32(F.concat(F.lit("part:"), F.col("id").cast("string"))) % 3 == 0).alias("hold")).repartition(8))
    sums = {(r["y"], r["hold"]): r["n"] for r in rows.groupBy("y", "hold").agg(F.count("*").alias("n")).collect()}
    if not sums.get((0, False)) or not sums.get((1, False)):
        return empty

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col, y = b.column(0), b.column(1).to_numpy()
            for lo, hi in cut(col, 8 << 20):
                w = scan(col.slice(lo, hi - lo), lower=True, letters=True)
                doc, up = w.doc(), np.zeros(len(w.start), np.uint64)
                for h in features(w):
                    one = np.unique(np.stack([h, doc.astype(np.uint64), up], 1), axis=0) if len(h) else np.zeros((0, 3), np.uint64)
                    toxic = y[lo:hi][one[:, 1].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(one[:, 0].view(np.int64)), pa.array(one[:, 2].view(np.int64)), pa.array(toxic.astype(np.int64)), pa.array(1 - toxic.astype(np.int64))], names=["h", "up", "t", "c"])
                    up = h

    seen = rows.where(~F.col("hold")).select("text", "y").mapInArrow(count, "h long, up long, t long, c long").groupBy("h").agg(F.min("up").alias("up"), F.sum("t").alias("t"), F.sum("c").alias("c")).where("t + c >= 2")
    got = seen.orderBy(F.desc(F.col("t") + F.col("c")), "h").limit(FEATURES).toArrow()
    h, up = (got[c].to_numpy().view(np.uint64) for c in ("h", "up"))
    t, c = (got[x].to_numpy().astype(float) for x in ("t", "c"))
    toxic, clean = sums[1, False], sums[0, False]
    share, at = toxic / (toxic + clean), {x: i for i, x in enumerate(h.tolist())}
    parent = np.array([at.get(x, -1) for x in up.tolist()], np.int64)
    odds = np.zeros(len(h) + 1)
    for _ in range(len(PREFIXES) + 1):  # each round settles one more level
        prior = odds[parent]
        odds[:-1] = np.log((t + PRIOR * share * np.exp(prior / 2)) / (c + PRIOR * (1 - share) * np.exp(-prior / 2))) - np.log(toxic / clean)
    order = np.argsort(h)
    model = Model(h[order], odds[:-1][order])
    # the curve is fitted at the ratio of drawn rows; the bias takes it to the ratio of all labelled rows
    share = {y: min(1.0, sample_rows / n) for y, n in sizes.items()}
    return _calibrated(model, rows, float(np.log(share[0] / share[1])))


def _calibrated(model: Model, rows: DataFrame, shift: float = 0.0) -> Model:
    """``model`` with the extreme-value law of clean texts and the curve, both from rows held back from the counts; ``shift`` is added to the curve's bias."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(documents(b.column(0), model))
            bins = []
            for lo, hi in cut(b.column(0)):
                w = scan(b.column(0).slice(lo, hi - lo), lower=True, letters=True)
                s = np.clip(np.round(model.token_scores(w) * 8), -255, 255).astype(int) + 256
                bins += [np.bincount(s[x:y], minlength=512) for x, y in zip(w.off[:-1], w.off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([n for n, _ in got], pa.int64()), pa.array([[x[2] for x in s] for _, s in got], pa.list_(pa.float64())), pa.array([x.tolist() for x in bins], pa.list_(pa.int64()))], names=["y", "n", "scores", "bins"])

    got = rows.where("hold").select("text", "y").mapInArrow(measure, "y int, n long, scores array<double>, bins array<long>").toArrow()
    y, n, scores = got["y"].to_numpy(), got["n"].to_numpy(), got["scores"].to_pylist()
    best = np.array([max(s, default=0.0) for s in scores])
    if not len(y) or y.min() == y.max():
        return model
    hist = np.asarray(got["bins"].combine_chunks().flatten()).reshape(len(y), 512)[y == 0].sum(0)
    value = (np.arange(512) - 256) / 8
    weights = np.maximum(1, np.round(hist / max(1, hist.sum()) * 200_000)).astype(int) * (hist > 0)
    model.rate = _karlin(np.repeat(value, weights))
    clean = y == 0
    # the maximum likelihood of a Gumbel law of known rate gives its location
    model.space = float(1 / np.exp(np.log(np.mean(np.exp(np.clip(-model.rate * best[clean], -300, 0)) * np.maximum(n[clean], 1)))))
    evidence = np.array([model.evidence(s, int(k)) for s, k in zip(scores, n, strict=True)])
    model.slope, model.bias = _logistic(evidence, y == 1)
    model.bias += shift
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``predicted``, ``n_tokens`` and the significant ``passages``.

    A passage (start, end, score) is a maximal segment in tokens, significant if fewer than
    SIGNIFICANT such are expected in a clean text of this length. A null or empty text has none
    and the score of no evidence. Columns that bear a result's name are replaced, others pass
    through; repeated rows score the same, and whole texts are read.
    """
    kinds = {"score": "double", "predicted": "int", "n_tokens": "bigint", "passages": "array<struct<start:bigint,end:bigint,score:double>>"}
    names = [c for c in docs.columns if c not in kinds or c == text]
    frame = bounded(docs).select(*(F.col("`" + c.replace("`", "``") + "`") for c in names))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            if not b.num_rows:
                continue
            n, evidence, found = [], [], []
            for size, got in documents(b.column(names.index(text)), m):
                n.append(size)
                evidence.append(m.evidence([x[2] for x in got], size))
                low = (np.log(m.space * max(size, 1)) - np.log(SIGNIFICANT)) / m.rate
                found.append([{"start": x, "end": y, "score": z} for x, y, z in got if z >= low])
            p = m.probability(np.array(evidence))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(n, pa.int64()), pa.array(found, passage)], names=[*names, *kinds])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in frame.schema), *(f"{k} {v}" for k, v in kinds.items())])
    return frame.mapInArrow(run, schema)
