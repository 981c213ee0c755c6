"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are folded to lower case and everything but letters to a space; n-grams of one to
three characters are hashed to a fixed number of bins. The matrix of log probabilities, languages
by bins, is broadcast. A batch of texts is a sparse matrix of bin counts whose product with it
is summed row by row in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberleaf.llm._spark import bounded, trimmed
from emberleaf.llm._text import strings

BINS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled rows that a language's model is fitted on, in expectation; all rows where it has fewer.
SAMPLE_ROWS = 2000
#: Cells of the matrix that is broadcast, and most languages that it has room for.
CELLS = 1 << 24
MAX_LANGUAGES = CELLS >> 10
SMOOTHING = 0.5
CHARS = 1 << 18

_fold: np.ndarray | None = None


def folding() -> np.ndarray:
    """Code point to lower-cased letter, or to a space."""
    global _fold
    if _fold is None:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _fold = out
    return _fold


def code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def pieces(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Folded characters of consecutive texts and their offsets, about CHARS at a time.

    A longer text is a piece of its own.
    """
    data, off = strings(col)
    raw, n, lo = data, len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHARS, "right")) - 1)
        part = raw[off[lo] : off[hi]]
        chars = folding()[code_points(part)]
        begins = (part & 0xC0) != 0x80
        at = np.concatenate([[0], np.cumsum(begins)])[off[lo : hi + 1] - off[lo]]
        yield chars, at
        lo = hi


def grams(chars: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the bin of the n-gram that ends at each character, and whether it counts.

    An n-gram counts if it lies in one text and has a letter.
    """
    at = np.arange(len(chars)) - np.repeat(off[:-1], np.diff(off))
    letter = chars != 32
    h = np.zeros(len(chars), np.uint32)
    some = np.zeros(len(chars), bool)
    for k, order in enumerate(ORDERS):
        back = order - 1
        h[back:] = (h[back:] ^ (chars[: len(chars) - back] + np.uint32(k))) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        some[back:] |= letter[: len(chars) - back]
        mixed = h * np.uint32(0x85EBCA6B)
        yield mixed >> np.uint32(16), some & (at >= back)


def counted(col: pa.Array) -> np.ndarray:
    """Bin counts of all texts of ``col`` together."""
    out = np.zeros(BINS, np.int64)
    for chars, off in pieces(col):
        for lo in range(0, len(chars), CHARS * 4):
            part, cut = chars[max(0, lo - 2) : lo + CHARS * 4], np.clip(off - max(0, lo - 2), 0, None)
            for bins, use in grams(part, np.minimum(cut, len(part))):
                use[: lo - max(0, lo - 2)] = False
                out += np.bincount(bins[use], minlength=BINS)
    return out


@dataclass
class Model:
    """log_prob has a row for each bin; prior one value for each language."""

    languages: list[str]
    log_prob: np.ndarray
    prior: np.ndarray

    def log_scores(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Joint log probabilities, texts by languages, and whether each text has a letter."""
        n, done = len(col), 0
        scores = np.zeros((n, len(self.languages)))
        letters = np.zeros(n, bool)
        step = max(1 << 12, CHARS * 8 // max(1, len(self.languages)))
        for chars, off in pieces(col):
            k = len(off) - 1
            rows = np.repeat(np.arange(done, done + k), np.diff(off))
            letters[np.unique(rows[chars != 32])] = True
            for lo in range(0, len(chars), step):
                first = max(0, lo - 2)
                part = chars[first : lo + step]
                cut = np.clip(off - first, 0, len(part))
                for bins, use in grams(part, cut):
                    use[: lo - first] = False
                    row = rows[first : lo + step][use]
                    if len(row):
                        new = np.flatnonzero(np.diff(row, prepend=-1))
                        scores[row[new]] += np.add.reduceat(self.log_prob[bins[use] & (len(self.log_prob) - 1)], new, axis=0)
            done += k
        return scores + self.prior, letters


def fit(docs: DataFrame, text: str, lang: str, key: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the rows whose text and language are not null.

    For each language about ``sample_rows`` rows are drawn by a hash of ``key``, or of the text of a null one, against that
    language's number of rows; priors are over all rows. The matrix is broadcast, so more than 256 languages
    share its cells by fewer bins, and more than MAX_LANGUAGES, 1,024 bins each, are an error. No labelled rows give a model without languages.
    """
    known = bounded(docs).where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.crc32(F.concat(F.lit("fit:"), F.coalesce(F.col(key).cast("string"), F.hex(F.xxhash64(text))))).alias("h"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(sizes)
    if not names:
        return Model([], np.zeros((BINS, 0), np.float32), np.zeros(0))
    bins = min(BINS, 1 << (CELLS // len(names)).bit_length() - 1)
    most = docs.sparkSession.createDataFrame([(x, int(min(1.0, sample_rows / n) * 0xFFFFFFFF)) for x, n in sizes.items()], "lang string, most long")
    drawn = known.join(F.broadcast(most), "lang").where("h <= most")  # a row for each language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.asarray(b.column(1).to_pylist(), object)
            for x in dict.fromkeys(langs):
                got = counted(b.column(0).filter(pa.array(langs == x))).reshape(-1, bins).sum(0)
                total[x] = total.get(x, 0) + got
        for x, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at)), pa.array(at), pa.array(c[at])], names=["lang", "bin", "n"])

    got = drawn.select("text", "lang").repartition(8).mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(names), bins))
    where = {x: i for i, x in enumerate(names)}
    counts[[where[x] for x in got["lang"].to_pylist()], got["bin"].to_numpy()] = got["n"].to_numpy()
    prob = np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * bins))
    prior = np.log(np.array([sizes[x] for x in names]) / sum(sizes.values()))
    return Model(names, np.ascontiguousarray(prob.T.astype(np.float32)), prior)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the language's posterior probability.

    A text that is null, or has no letter, gets ``und`` and 0, as does every text under a model
    without languages; ties go to the language first by code point. Columns that bear a result's name are
    replaced, others pass through; whole texts count, and repeated rows get the same result.
    """
    kinds = {"lang_pred": "string", "score": "double"}
    names = [c for c in docs.columns if c not in kinds or c == text]
    frame = bounded(docs).select(*(F.col("`" + c.replace("`", "``") + "`") for c in names))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            if not b.num_rows:
                continue
            if m.languages:
                logs, letters = m.log_scores(b.column(names.index(text)))
                best = logs.argmax(1)
                top = 1 / np.exp(np.minimum(logs - logs.max(1, keepdims=True), 0)).sum(1)
                lang = [m.languages[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                score = np.where(letters, top, 0.0)
            else:
                lang, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*names, *kinds])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in frame.schema), *(f"{k} {v}" for k, v in kinds.items())])
    return frame.mapInArrow(trimmed(run), schema)
