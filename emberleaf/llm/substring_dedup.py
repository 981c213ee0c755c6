"""Substring deduplication by level-wise doubling.

Windows repeated at one length alone are extended to twice that length. The first level hashes
windows of a part of the length, and of these only the minimizers: in each run of windows that a window of twice
the size spans, those of the smallest hash. Two equal windows pick the same ones, so any repeated
window holds a repeated minimizer. The next level hashes the windows of twice the size around repeated
minimizers alone; from then on a window is a candidate if both of its halves are repeated. Levels end at
the length asked for, or when no candidates survive. At the last one each window that does not start
first in the corpus is removed.

Counting is combined before rows move: at the last level a task sends a window once, however often it holds it,
and marks the later ones itself; at the others few hot windows are broadcast. So no window, however common, gathers
in one task. Levels before the last may tell windows by 64-bit hashes, which at worst leaves a
candidate too many; the last one tells them by 128 bits of two independent hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberleaf.llm._bloom import may_be_in, partnered
from emberleaf.llm._skew import HOT_KEYS, HOT_ROWS, spread
from emberleaf.llm._spark import NULL_ID, bounded, numbered, stored
from emberleaf.llm._text import Words, cut, mix, pair, scan

LENGTH = 20
#: Least words of the windows of the first level.
FIRST = 8
EMPTY = hashlib.sha256(b"").hexdigest()


def levels(length: int) -> list[int]:
    """Window sizes, each twice the one before, from FIRST words or more up to ``length``."""
    out = [length]
    while out[0] % 2 == 0 and out[0] // 2 >= min(FIRST, length // 2):
        out.insert(0, out[0] // 2)
    return out


def _hashes(w: Words, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``half`` words and of twice as many at each word; see Words.windows for which exist."""
    size = 1
    part, out = w.hash.copy(), None
    at, left = 0, half
    n = len(w.hash)
    while True:  # by the binary digits of half
        if left & 1:
            if out is None:
                out = part.copy()
            else:
                joined = out.copy()
                joined[: max(0, n - at)] = pair(out[: max(0, n - at)], part[at:])
                out = joined
            at += size
        left >>= 1
        if not left:
            break
        two = part.copy()
        two[: max(0, n - size)] = pair(part[: max(0, n - size)], part[size:])
        part, size = two, size * 2
    full = out.copy()
    full[: max(0, n - half)] = pair(out[: max(0, n - half)], out[half:])
    return out, full


def minimizers(w: Words, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Words at which a smallest half window of some full window starts, and the half windows' hashes."""
    h, _ = _hashes(w, half)
    key = mix(h) | np.uint64(1)
    valid = w.windows(2 * half)
    low = key.copy()
    span = half + 1  # half windows in a full one
    size = 1
    while size < span:
        step = min(size, span - size)
        low[:-step] = np.minimum(low[:-step], low[step:])
        size += step
    high = np.where(valid, low, np.uint64(0))
    size = 1
    while size < span:
        step = min(size, span - size)
        moved = high.copy()
        moved[step:] = np.maximum(high[step:], high[:-step])
        high, size = moved, size + step
    at = np.flatnonzero((high == key) & w.windows(half))
    return at, h[at]


def _first_level(half: int, rest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in cut(b.column(0)):
                w = scan(b.column(0).slice(lo, hi - lo))
                shas = [hashlib.sha256(t).hexdigest() for t in w.text()]
                at, h = minimizers(w, half) if len(w.start) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                ends = np.searchsorted(at, w.off).astype(np.int32)
                pos = at - np.repeat(w.off[:-1], np.diff(ends))
                marks = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(pos.astype(np.int32))], names=["h", "pos"])
                yield pa.RecordBatch.from_arrays([*(b.column(i + 1).slice(lo, hi - lo) for i in range(rest)), pa.array(np.diff(w.off)), pa.array(shas, pa.string()), pa.array([int(s[:15], 16) for s in shas], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), marks)], names=["ord", "th", "n_words", "sha", "seq", "marks"])

    return run


def _around(w: Words, marks: pa.Array, half: int, first: bool) -> np.ndarray:
    """Words at which a candidate window of twice ``half`` words starts.

    At the first doubling it holds a mark, from then on its halves both start at one.
    """
    n = np.diff(np.frombuffer(marks.buffers()[1], np.int32)[marks.offset : marks.offset + len(marks) + 1])
    doc = np.repeat(np.arange(len(marks)), n)
    at = marks.flatten().to_numpy() + w.off[doc]
    if first:
        cover = np.zeros(len(w.start) + 1, np.int64)  # starts from half words before a mark to the mark
        np.add.at(cover, np.maximum(at - half, w.off[doc]), 1)
        np.add.at(cover, at + 1, -1)
        use = np.cumsum(cover[:-1]) > 0
    else:
        mark = np.zeros(len(w.start) + half, bool)
        mark[at] = True
        use = mark[: len(w.start)] & mark[half:]
    return np.flatnonzero(use & w.windows(2 * half))


def _extended(half: int, first: bool):
    """Hashes and starts of the candidate windows of twice ``half`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in cut(b.column(0)):
                w = scan(b.column(0).slice(lo, hi - lo))
                use = _around(w, b.column(2).slice(lo, hi - lo), half, first)
                doc = w.doc()[use]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo).take(pa.array(doc)), pa.array(_hashes(w, half)[1][use].view(np.int64)), pa.array((use - w.off[doc]).astype(np.int32))], names=["seq", "h", "pos"])

    return run


ROWS = "h long, g long, ord long, th long, start int, later array<int>"


def _last_level(half: int, doubled: bool):
    """Rows of windows that are first in this task (h, g, ord, th, start), and of each text's later ones (spans of starts)."""
    names = ["h", "g", "ord", "th", "start", "later"]

    def drain(held: list[tuple[np.ndarray, ...]], texts: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        h, g, doc, start = (np.concatenate([x[i] for x in held]) for i in range(4))
        ords, ths = (np.array(x, np.int64) for x in zip(*texts, strict=True))
        order = np.lexsort((start, ords[doc], g, h))
        h, g, doc, start = h[order], g[order], doc[order], start[order]
        head = np.ones(len(h), bool)
        head[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        lead = np.repeat(np.flatnonzero(head), np.diff(np.append(np.flatnonzero(head), len(h))))
        first = (ords[doc] == ords[doc[lead]]) & (start == start[lead])  # with those of repeated rows of one document
        yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(g[first].view(np.int64)), pa.array(ords[doc[first]]), pa.array(ths[doc[first]]), pa.array(start[first].astype(np.int32)), pa.nulls(int(first.sum()), pa.list_(pa.int32()))], names=names)
        doc, start = doc[~first], start[~first]
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        own = np.unique(doc)
        ends = np.append(np.searchsorted(doc, own), len(doc)).astype(np.int32)
        key = mix(ords[own].view(np.uint64) ^ ths[own].view(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.nulls(len(own), pa.int64()), pa.array(ords[own]), pa.array(ths[own]), pa.nulls(len(own), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(start.astype(np.int32)))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size = [], [], 0
        for b in batches:
            for lo, hi in cut(b.column(0)):
                col = b.column(0).slice(lo, hi - lo)
                w = scan(col)
                if not len(w.start):
                    continue
                use = _around(w, b.column(3).slice(lo, hi - lo), half, not doubled)
                doc = w.doc()[use]
                full = _hashes(w, half)[1][use]
                held.append((full, _hashes(scan(col, other=True), half)[1][use], doc + len(texts), use - w.off[doc]))
                texts += zip(b.column(1).slice(lo, hi - lo).to_pylist(), b.column(2).slice(lo, hi - lo).to_pylist(), strict=True)
                size += len(use)
                if size > 2_000_000:
                    yield from drain(held, texts)
                    held, texts, size = [], [], 0
        if size:
            yield from drain(held, texts)

    return run


def _repeated(windows: DataFrame) -> DataFrame:
    """``seq`` and the ``marks`` of its windows (seq, h, pos) that are also elsewhere."""
    place = F.xxhash64("seq", "pos")
    found = stored(windows.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a <> b").select("h", "n"))
    # hot windows are fewer than HOT_KEYS: these are broadcast, not shuffled
    least = max(HOT_ROWS, (found.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    told = windows.join(F.broadcast(found.where(F.col("n") > least).select("h", F.lit(True).alias("hot"))), "h", "left")
    rest = told.where("hot is null").join(found.where(F.col("n") <= least), "h")
    return told.where("hot").select("seq", "pos").unionByName(rest.select("seq", "pos")).groupBy("seq").agg(F.collect_set("pos").alias("marks"))


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in cut(b.column(0)):
                w = scan(b.column(0).slice(lo, hi - lo), hashes=False)
                cover = np.zeros(len(w.start) + length + 1, np.int64)
                for i, starts in enumerate(b.column(3).slice(lo, hi - lo).to_pylist()):
                    at = np.unique(np.array(starts, np.int64)) + w.off[i]
                    cover[at] += 1
                    cover[at + length] -= 1
                keep = np.cumsum(cover)[: len(w.start)] == 0
                total = np.concatenate([[0], np.cumsum(~keep)])[w.off]
                shas, kept = [], []
                for t in w.text(keep):
                    shas.append(hashlib.sha256(t).hexdigest())
                    kept.append(t)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(np.diff(total)), pa.array(shas, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], names=["ord", "th", "gone", "new_sha", "kept_text"])

    return run


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, texts: bool = False) -> DataFrame:
    """A row for each document: its id, ``n_words``, ``n_removed``, ``kept_sha256`` and, with ``texts``, ``kept_text`` where words went.

    A word is removed if a window of ``length`` words over it also starts earlier, that is in a
    document of smaller id or before in the same one, judged on the input. ``length`` is even.
    A null text has no words. Ids are below 2^62; a null id counts as a greater number that the row's text gives, and shows
    as null. Rows that share an id, or have none and the same text, count as one document: of equal windows at the same
    start, none is later. Documents of the same words as an earlier one go whole, or stay whole if shorter than a
    window. An empty table gives no rows; other columns, whatever their names, are not read.
    """
    if length < 4 or length % 2:
        raise ValueError("length must be even and at least 4")
    half, *sizes = levels(length)
    body = F.coalesce(F.col(text), F.lit(""))
    known = bounded(docs).select(body.alias("text_"), numbered(F.col(key), body).alias("ord"), F.xxhash64(body).alias("th"))
    slim = stored(known.mapInArrow(_first_level(half, 2), "ord long, th long, n_words long, sha string, seq long, marks array<struct<h:long,pos:int>>"))
    shas = stored(slim.groupBy("sha", "seq").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first <> last").drop("last"))
    # only texts that occur in several documents need to know the first of them
    shared = may_be_in(stored(shas.select("seq")), "seq")
    told = spread(stored(slim.where(shared).drop("marks")), shas.drop("seq"), ["sha"], "left").withColumn("copy", F.coalesce(F.col("ord") > F.col("first"), F.lit(False))).drop("first")
    told = stored(told)
    flagged = slim.where(~shared).drop("marks").withColumn("copy", F.lit(False)).unionByName(told)
    firsts = told.where(~F.col("copy")).select("ord", "th", "seq").dropDuplicates(["ord", "th"])
    marked = slim.select("ord", "th", "seq", "marks")
    alone = marked.where(~shared)
    marked = alone.unionByName(marked.where(shared).join(firsts, ["ord", "th", "seq"], "left_semi"))

    marks = _repeated(marked.select("seq", F.explode("marks").alias("m")).select("seq", "m.h", "m.pos"))
    wanted = stored(alone.select("ord", "th", "seq").unionByName(firsts).dropDuplicates(["ord", "th"]).join(marks, "seq"))
    found = stored(partnered(known, "th", wanted.select("th")).join(wanted, ["ord", "th"]).select("text_", "ord", "th", "seq", "marks"))
    for i, size in enumerate(sizes[:-1]):
        windows = stored(found.select("text_", "seq", "marks").mapInArrow(_extended(size // 2, not i), "seq long, h long, pos int"))
        if windows.isEmpty():
            break
        found = stored(found.drop("marks").join(_repeated(windows), "seq"))

    windows = found.select("text_", "ord", "th", "marks").mapInArrow(_last_level(length // 2, len(sizes) > 1), ROWS)
    by = W.partitionBy("h", "g", F.col("start").isNull()).orderBy("ord", "start")
    later = windows.withColumn("rank_", F.rank().over(by)).where("start is null or rank_ > 1").select("ord", "th", F.coalesce("later", F.array("start")).alias("later"))
    gone = later.groupBy("ord", "th").agg(F.flatten(F.collect_list("later")).alias("later"))
    changed = found.select("text_", "ord", "th").join(gone, ["ord", "th"]).select("text_", "ord", "th", "later").mapInArrow(_remove(length), "ord long, th long, gone long, new_sha string, kept_text string")
    if not texts:
        changed = changed.drop("kept_text")
    changed = changed.dropDuplicates(["ord", "th"])
    whole = F.col("copy") & (F.col("n_words") >= length)
    out = flagged.join(changed, ["ord", "th"], "left").select(
        F.when(F.col("ord") < NULL_ID, F.col("ord")).alias(key),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256"),
        *([F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if texts else []),
    )
    return out


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY hash, key ORDER BY doc_id, i) AS r FROM (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS key, hash(array_to_string(w[i:i + 19], ' ')) AS hash FROM k)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE r > 1),
o AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) ANTI JOIN g USING (doc_id, i)),
t AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM o GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id)
"""
