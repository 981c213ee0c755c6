"""Language-model scoring with Brown classes.

Exchange clustering puts words into classes: a word moves to the class that raises the likelihood of class
bigrams most. The most frequent words are exchanged one by one with all counts up to date. Then all words that
training text has twice or more are placed, and those that occur OFTEN exchanged on, in rounds over the corpus, in which many
words move at once by the counts of the round before; a round that lowers the likelihood is undone. The number of
classes grows with the root of the number of words. A token's probability is a class transition, smoothed to class
frequencies, times the word's emission from its class. Words seen once, and unseen ones, share a class of their
own with add-half emissions, as do the rarest beyond TABLE words; a transition starts from the last token whose class
is not that one.

Counts are over all training text. Words are told by 64-bit hashes. Training text is read twice, for counts and to
replace words by their ranks; all rounds read the ranks. Counts and classes of the TABLE most
frequent words are broadcast, a few tens of MB whatever the input; counts of the others are joined.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberleaf.llm._skew import spread
from emberleaf.llm._spark import bounded, dropped, stored, trimmed
from emberleaf.llm._text import cut, scan

#: Words that are broadcast with their classes, words that are exchanged one by one, and the most classes.
TABLE, SEEDS, MOST_CLASSES = 1 << 20, 2048, 256
#: Passes over the seeds, and rounds over all words: the first places them, the others exchange half of those that occur OFTEN each.
PASSES, ROUNDS, OFTEN = 4, 3, 16
#: Counts whose gains are looked up, words weighed together, rows added up at once, and entries of a count from which a matrix product adds them.
LOOKED_UP, CHUNK, BLOCK, MANY = 16, 2048, 1024, 2048
END = np.uint64(0x454E44)
TRANSITION_PRIOR = 20.0


def classes(words: int) -> int:
    """How many classes a vocabulary of so many words gets."""
    return int(min(MOST_CLASSES, max(4, round(words**0.5 / 3))))


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an END after each text's words, and offsets."""
    w = scan(col, lower=True)
    n = np.diff(w.off) + 1
    off = np.concatenate([[0], np.cumsum(n)])
    out = np.full(off[-1], END)
    out[np.arange(len(w.hash)) + w.doc()] = w.hash
    return out, off


class Tally:
    """Counts of 64-bit keys of one task, handed on whenever they are many."""

    def __init__(self, most: int = 2_000_000) -> None:
        self.most, self.size, self.parts = most, 0, []

    def add(self, keys: np.ndarray) -> None:
        got = np.unique(keys, return_counts=True)
        self.parts.append(got)
        self.size += len(got[0])

    def full(self) -> bool:
        return self.size > self.most

    def drain(self) -> pa.RecordBatch:
        keys = np.concatenate([p[0] for p in self.parts]) if self.parts else np.zeros(0, np.uint64)
        n = np.concatenate([p[1] for p in self.parts]) if self.parts else np.zeros(0, np.int64)
        self.parts, self.size = [], 0
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        new = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)))
        return pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), pa.array(np.add.reduceat(n, new) if len(new) else n)], names=["k", "n"])


def counted(docs: DataFrame, text: str, keys) -> DataFrame:
    """Sums over all rows of how often each key in ``keys(tokens, offsets)`` occurs, as ``k`` and ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for b in batches:
            for lo, hi in cut(b.column(0)):
                tally.add(keys(*tokens(b.column(0).slice(lo, hi - lo))))
                if tally.full():
                    yield tally.drain()
        yield tally.drain()

    return bounded(docs).select(F.col(text)).mapInArrow(trimmed(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


ROWS = "w long, code array<int>, n array<long>"


def _listed(keys: np.ndarray, n: np.ndarray, width: int, below: bool) -> pa.RecordBatch:
    """Counts of sorted ``keys`` as one row for each ``key // width``, with lists; ``below`` zero, as -1 - that, if so asked."""
    w, code = np.divmod(keys, width)
    first = np.flatnonzero(np.diff(w, prepend=-1))
    off = pa.array(np.append(first, len(w)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (code.astype(np.int32), n.astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(-1 - w[first] if below else w[first], pa.int64()), *lists], names=["w", "code", "n"])


def _tallied(df: DataFrame, keys, cells: int, width: int, codes: int = 1) -> DataFrame:
    """How often each key in ``keys(ranks, offsets)`` occurs in a task, over all rows of ``df``, with one list of ranks.

    ``keys`` gives arrays of keys; those of the first one, below ``cells``, are counted in place and become rows below zero, by
    ``width`` of them; others are sorted and become rows by ``codes`` of them. A row for many counts keeps the shuffle
    that adds tasks up cheap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, dense = Tally(), np.zeros(cells, np.int64)

        def drained() -> Iterator[pa.RecordBatch]:
            got = tally.drain()
            k, n = got.column(0).to_numpy(), got.column(1).to_numpy()
            for lo in range(0, len(k), 1 << 20):
                yield _listed(k[lo : lo + (1 << 20)], n[lo : lo + (1 << 20)], codes, False)

        for b in batches:
            if b.num_rows:
                col = b.column(0)
                off = col.offsets.to_numpy().astype(np.int64)
                few, *more = keys(col.flatten().to_numpy().astype(np.int64), off - off[0])
                dense += np.bincount(few, minlength=cells)
                for k in more:
                    tally.add(k.astype(np.uint64))
                if tally.full():
                    yield from drained()
        some = np.flatnonzero(dense)
        for lo in range(0, len(some), 1 << 20):
            yield _listed(some[lo : lo + (1 << 20)], dense[some[lo : lo + (1 << 20)]], width, True)
        yield from drained()

    return df.mapInArrow(trimmed(run), ROWS)


def _added(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows sorted by ``w`` the words, codes and sums of counts, sorted by both, some words at a time and each word whole."""
    none = np.zeros(0, np.int64)
    held, size = [(none, none, none)], 0

    def summed(w: np.ndarray, code: np.ndarray, n: np.ndarray):
        order = np.argsort(w * (code.max(initial=0) + 1) + code)
        w, code = w[order], code[order]
        first = np.flatnonzero((np.diff(w, prepend=w[:1] - 1) != 0) | (np.diff(code, prepend=code[:1]) != 0))
        return w[first], code[first], np.add.reduceat(n[order], first) if len(first) else n

    for b in batches:
        if b.num_rows:
            lists = b.column(1)
            w = np.repeat(b.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            held.append((w, lists.flatten().to_numpy().astype(np.int64), b.column(2).flatten().to_numpy()))
            size += len(w)
        if size > most:
            all_ = summed(*(np.concatenate([x[i] for x in held]) for i in range(3)))
            cut = np.searchsorted(all_[0], all_[0][-1])
            if cut:
                yield tuple(x[:cut] for x in all_)
            held = [tuple(x[cut:] for x in all_)]
            size = len(all_[0]) - cut
    if any(len(x[0]) for x in held):
        yield summed(*(np.concatenate([x[i] for x in held]) for i in range(3)))


#: Shares by which a word's rows of all tasks are first added up.
SHARES = 16


def _fewer(rows: DataFrame) -> DataFrame:
    """``rows`` added up to about SHARES for each word, so that a word of every task is no burden to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, code, n in _added(batches):
            first = np.flatnonzero(np.diff(w, prepend=w[:1] - 1))
            off = pa.array(np.append(first, len(w)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(w[first]), pa.ListArray.from_arrays(off, pa.array(code.astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(n))], names=["w", "code", "n"])

    share = F.pmod(F.xxhash64("code", "n"), F.lit(SHARES))
    return rows.repartition(F.col("w"), share).sortWithinPartitions("w").mapInArrow(trimmed(run), ROWS)


def _cells(rows: DataFrame, width: int) -> DataFrame:
    """``k`` and ``n`` of the keys that tasks counted in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, code, n in _added(batches):
            yield pa.RecordBatch.from_arrays([pa.array((-1 - w) * width + code), pa.array(n)], names=["k", "n"])

    return _fewer(rows.where("w < 0")).repartition("w").sortWithinPartitions("w").mapInArrow(trimmed(run), "k long, n long")


@dataclass
class Table:
    """Sorted word hashes and their ranks: 0 for the end of a text, then from the most frequent word."""

    keys: np.ndarray
    rank: np.ndarray

    @functools.cached_property
    def first(self) -> np.ndarray:
        """Where the keys of each value of their first bits begin; there are one to two such values for each key."""
        bits = len(self.keys).bit_length()
        out = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((self.keys >> np.uint64(64 - bits)).view(np.int64), minlength=1 << bits), out=out[1:])
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ranks of ``h``; words that the table lacks have the number of its words."""
        out = np.full(len(h), len(self.keys), np.int32)
        bucket = (h >> np.uint64(65 - (len(self.first) - 1).bit_length())).astype(np.int64)
        at, stop = self.first[bucket], self.first[bucket + 1]
        todo = np.flatnonzero(at < stop)
        at, stop, need = at[todo], stop[todo], h[todo]
        while len(todo):
            hit = self.keys[at] == need
            out[todo[hit]] = self.rank[at[hit]]
            at += 1
            more = ~hit & (at < stop)
            todo, at, stop, need = todo[more], at[more], stop[more], need[more]
        return out


@dataclass
class Model:
    """count, cls and log_emit are by rank; log_step[g, c] and log_emit are log10; the last two classes hold text ends and words without a class."""

    table: Table
    count: np.ndarray
    cls: np.ndarray
    log_step: np.ndarray
    log_emit: np.ndarray
    tokens: int
    words: int
    rare_tokens: int
    rare_words: int

    def base(self, count):
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


def _h(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def likelihood(pairs: np.ndarray) -> float:
    """The part of the logarithmic likelihood of class bigrams that depends on classes."""
    return float(_h(pairs).sum() - _h(pairs.sum(1)).sum() - _h(pairs.sum(0)).sum())


def exchange(n: np.ndarray, classes: int, passes: int = PASSES) -> np.ndarray:
    """Classes of the words with bigram counts ``n`` that raise the likelihood of class bigrams.

    The last two rows of ``n``, text ends and other words, keep classes of their own.
    """
    size = len(n) - 2
    cls = np.concatenate([np.arange(size) % classes, [classes, classes + 1]])
    one = np.eye(classes + 2)[cls]
    right, left = n @ one, n.T @ one
    pairs = one.T @ right
    diagonal = np.arange(classes)
    for _ in range(passes):
        moved = 0
        for w in range(size):
            a, out, into, own = cls[w], right[w].copy(), left[w].copy(), n[w, w]
            pairs[a] -= out
            pairs[:, a] -= into
            pairs[a, a] += own
            out[a] -= own
            into[a] -= own
            rows, cols = pairs.sum(1)[:classes], pairs.sum(0)[:classes]
            c, g = np.flatnonzero(out), np.flatnonzero(into)
            after, before = pairs[:classes, c], pairs[g, :classes]
            gain = (_h(after + out[c]) - _h(after)).sum(1) + (_h(before + into[g, None]) - _h(before)).sum(0)
            self_pair, x, y = pairs[diagonal, diagonal], out[:classes], into[:classes]
            gain += _h(self_pair + x + y + own) - _h(self_pair + x) - _h(self_pair + y) + _h(self_pair)
            gain -= _h(rows + out.sum() + own) - _h(rows) + _h(cols + into.sum() + own) - _h(cols)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            pairs[b] += out
            pairs[:, b] += into
            pairs[b, b] += own
            if b != a:
                cls[w], moved = b, moved + 1
                right[:, a] -= n[:, w]
                right[:, b] += n[:, w]
                left[:, a] -= n[w]
                left[:, b] += n[w]
        if not moved:
            break
    return cls[:size]


def _gain(base: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What ``m`` more bigrams add to x log x of ``base`` of them."""
    base = np.maximum(base, 1e-3)
    return m * np.log(base + m) + base * np.log1p(m / base)


class Gains:
    """Gains by the class bigrams ``pairs``: those of counts up to LOOKED_UP, nearly all there are, are worked out once."""

    def __init__(self, pairs: np.ndarray) -> None:
        to = len(pairs) - 2
        self.pairs = pairs
        self.sides = (pairs[:, :to], pairs.sum(0)[:to]), (np.ascontiguousarray(pairs[:to].T), pairs.sum(1)[:to])
        self.known: dict[tuple[int, int], np.ndarray] = {}
        self.one = self.sums = np.zeros((0, 0), np.float32)  # kept, since fresh memory costs more than the product

    def rows(self, side: int, m: int) -> np.ndarray:
        """By context, the gains of ``m`` bigrams with it as their word joins each class."""
        if (side, m) not in self.known:
            self.known[side, m] = _gain(self.sides[side][0], np.float64(m)).astype(np.float32)
        return self.known[side, m]

    def add(self, out: np.ndarray, side: int, w: np.ndarray, c: np.ndarray, m: np.ndarray) -> None:
        """Adds to the rows ``w`` of ``out``, ascending, the gains of ``m`` bigrams with contexts ``c``, of no pair twice."""
        level = np.where(m <= LOOKED_UP, m, 0).astype(np.int64)
        for x, entries in enumerate(np.bincount(level, minlength=1)):
            use = np.flatnonzero(level == x) if entries else []
            if x and entries >= MANY:
                if len(self.one) != len(out):
                    self.one, self.sums = np.zeros((len(out), len(self.pairs)), np.float32), np.empty(out.shape, np.float32)
                self.one[w[use], c[use]] = 1
                out += np.matmul(self.one, self.rows(side, x), out=self.sums)
                self.one[w[use], c[use]] = 0
                continue
            for lo in range(0, len(use), BLOCK):
                at = use[lo : lo + BLOCK]
                gain = self.rows(side, x)[c[at]] if x else _gain(self.sides[side][0][c[at]], m[at, None])
                first = np.flatnonzero(np.diff(w[at], prepend=-1))
                out[w[at][first]] += np.add.reduceat(gain, first)


def gains(pairs: np.ndarray | Gains, own_class: np.ndarray, word: np.ndarray, code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How much the likelihood gains, but for a constant of each word, as words join each class, all others staying where they are.

    Of ``word``, ascending from 0, ``n`` counts its bigrams of ``code``: c after class c, ``every`` + c before class c, and
    2 * ``every`` with itself, which count in both others too. Gains are first taken as if the word were in no class yet; then
    the few cells of ``pairs`` that hold its own bigrams are put right.
    """
    by = pairs if isinstance(pairs, Gains) else Gains(pairs)
    every = len(by.pairs)
    size, to = len(own_class), every - 2
    twin, counts = np.zeros(size), np.zeros((2, size, every))
    same = code == 2 * every
    twin[word[same]] = n[same]
    counts[code[~same] // every, word[~same], code[~same] % every] = n[~same]
    counts[:, np.arange(size), own_class] -= twin
    some = counts[:, :, :to] > 0
    placed = np.flatnonzero(own_class < to)
    mine = own_class[placed]
    out = np.zeros((size, to))
    for side, (matrix, sums) in enumerate(by.sides):
        use = np.flatnonzero(code // every == side)
        w, c = word[use], code[use] - side * every
        m = counts[side, w, c]
        w, c, m = w[m > 0], c[m > 0], m[m > 0]
        by.add(out, side, w, c, m)
        a = own_class[w]
        has, home = np.flatnonzero(a < to), np.flatnonzero(c == a)  # the class it leaves, as one joined and as a context
        less = m[has] + np.where(c[has] == a[has], counts[1 - side, w[has], np.minimum(a[has], to - 1)] + twin[w[has]], 0)
        i, j = np.divmod(np.flatnonzero(some[1 - side, w[home]]), to)
        other = j != a[home[i]]
        i, j = home[i[other]], j[other]
        entry, joined = np.concatenate([has, i]), np.concatenate([a[has], j])
        less = np.concatenate([less, counts[1 - side, w[i], j]])
        base = matrix[c[entry], joined]
        np.add.at(out, (w[entry], joined), _gain(base - less, m[entry]) - _gain(base, m[entry]))
        total = counts[side].sum(1) + twin
        times, inverse = np.unique(total, return_inverse=True)
        out -= (_h(sums + times[:, None]) - _h(sums))[inverse]
        base, total = sums[mine], total[placed]
        left = np.maximum(base - total, 0)
        out[placed, mine] += _h(base + total) - _h(base) - _h(left + total) + _h(left)
    i, j = np.divmod(np.flatnonzero(some[0] & some[1] | (twin > 0)[:, None]), to)
    left, right, both = counts[0, i, j], counts[1, i, j], twin[i]
    base = np.maximum(np.diag(by.pairs)[j] - np.where(j == own_class[i], left + right + both, 0), 0)
    out[i, j] += _h(base + left + right + both) - _h(base + left) - _h(base + right) + _h(base)
    return out


def _matrix(rows: pa.Table, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape[0] * shape[1])
    out[rows["k"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(shape)


def _before(off: np.ndarray, ids: np.ndarray, start: int) -> np.ndarray:
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[off[:-1]] = start
    return out


def _steps(cls: np.ndarray, off: np.ndarray, end: int, rare: int) -> np.ndarray:
    """The class that each token's transition starts from: the last one that is not ``rare``."""
    at = np.where(cls != rare, np.arange(len(cls)), -1)
    start = np.repeat(off[:-1], np.diff(off))
    last = np.maximum.accumulate(at)
    prev = np.concatenate([[-1], last[:-1]])
    return np.where(prev >= start, cls[prev], end)


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words of ``counts``, about ``most`` where there are more.

    A histogram of counts tells from which on all words fit. Of those of the next step as many as fit go along, by a hash.
    """
    step = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.floor(F.log2("n") * 256) + 1024).cast("long")
    room = most
    for r in counts.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():  # some thousands of rows, whatever the input
        if r["count"] > room:
            part = F.pmod(F.xxhash64(F.lit("part"), "k"), F.lit(1 << 20)) < int((1 << 20) * 0.98 * room / r["count"])
            return counts.where((step > r["s"]) | ((step == r["s"]) & part))
        room -= r["count"]
    return counts


def fit(train: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """A model of all texts of ``train``, null ones as empty, and the stored counts of all words. No texts give a model that knows no word."""
    ship = train.sparkSession.sparkContext.broadcast
    counts = stored(counted(train, text, lambda h, off: h))
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("k") == int(END), F.col("n"))).alias("ends")).first()
    top = frequent(counts.where((F.col("k") != int(END)) & (F.col("n") > 1)), TABLE - 1).toArrow()
    keys, n = top["k"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.lexsort((keys, -n))
    keys, count = np.concatenate([[END], keys[order]]), np.concatenate([[totals["ends"] or 0], n[order]])
    size = len(keys)
    by_hash = np.argsort(keys)
    table = Table(keys[by_hash], by_hash.astype(np.int32))
    to = classes(size)
    every, end, rare = to + 2, to, to + 1
    shipped = ship(table)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in cut(b.column(0)):
                h, off = tokens(b.column(0).slice(lo, hi - lo))
                ranks = pa.array(shipped.value.find(h).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), ranks)], names=["ranks"])

    ranks = stored(bounded(train).select(F.col(text)).mapInArrow(trimmed(encode), "ranks array<int>"))

    seeds = min(SEEDS, size - 1)
    cell = np.full(size + 1, seeds + 1)
    cell[0], cell[1 : seeds + 1] = seeds, np.arange(seeds)

    def bigrams(x: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        c = cell[x]
        return [_before(off, c, seeds) * (seeds + 2) + c]

    cls = np.full(size + 1, rare)
    cls[0] = end
    cls[1 : seeds + 1] = exchange(_matrix(_cells(_tallied(ranks, bigrams, (seeds + 2) ** 2, seeds + 2), seeds + 2).toArrow(), (seeds + 2, seeds + 2)), to)

    codes, best, before = 2 * every + 1, -np.inf, cls
    times = np.append(count, 0)
    for turn in range(ROUNDS):
        moves = (np.arange(size + 1) % 2 == turn % 2) & (times >= OFTEN) if turn else cls == rare
        moves[[0, size]] = False
        if not moves.any():
            break
        known = ship((cls, moves))

        def contexts(x: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
            cls, moves = known.value  # noqa: B023
            c = cls[x]
            prev, use = _before(off, c, end), np.flatnonzero(moves[x])
            w = x[use] * codes
            twin = _before(off, x, 0)[use] == x[use]
            return [prev * every + c, np.concatenate([w + prev[use], w + every + c[use + 1], w[twin] + 2 * every])]

        seen = stored(_tallied(ranks, contexts, every * every, every, codes))
        pairs = _matrix(_cells(seen, every).toArrow(), (every, every))
        now = likelihood(pairs)
        if now < best:
            cls = before
            break
        best, before = now, cls
        state = ship((cls, pairs))

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cls, pairs = state.value  # noqa: B023
            by = Gains(pairs)
            for w, code, n in _added(batches):
                words, word = np.unique(w, return_inverse=True)
                for lo in range(0, len(words), CHUNK):
                    own = cls[words[lo : lo + CHUNK]]
                    part = slice(*np.searchsorted(word, [lo, lo + CHUNK]))
                    gain = gains(by, own, word[part] - lo, code[part], n[part])
                    new = gain.argmax(1)
                    stay = np.flatnonzero(own < to)
                    stay = stay[gain[stay, new[stay]] <= gain[stay, own[stay]] + 1e-9]
                    new[stay] = own[stay]
                    yield pa.RecordBatch.from_arrays([pa.array(words[lo : lo + CHUNK]), pa.array(new)], names=["w", "c"])

        often = _fewer(seen.where((F.col("w") >= 0) & (F.col("w") < SEEDS)))
        near = seen.where(F.col("w") >= SEEDS).unionByName(often).repartition("w").sortWithinPartitions("w")
        new = near.mapInArrow(trimmed(choose), "w long, c long").toArrow()  # a row for each word of the table
        dropped(seen)
        cls = cls.copy()
        cls[new["w"].to_numpy()] = new["c"].to_numpy()

    final = ship(cls)

    def chain(x: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        c = final.value[x]
        return [_steps(c, off, end, rare) * every + c]

    step = _matrix(_cells(_tallied(ranks, chain, every * every, every), every).toArrow(), (every, every))
    dropped(ranks)
    share = (step.sum(0) + 0.5) / (step.sum() + 0.5 * every)
    log_step = np.log10((step + TRANSITION_PRIOR * share) / (step.sum(1, keepdims=True) + TRANSITION_PRIOR))
    cls = cls[:size]
    per = np.bincount(cls, count, every)
    tokens_, words_ = int(totals["n"] or 0), int(totals["v"])
    rare_tokens, rare_words = tokens_ - int(per[:rare].sum()), words_ - int(((cls != rare) & (count > 0)).sum())
    emit = np.where(cls != rare, np.log10(np.maximum(count, 1) / np.maximum(per[cls], 1)), np.log10((count + 0.5) / (rare_tokens + 0.5 * (rare_words + 1))))
    return Model(table, count, cls, log_step, emit, tokens_, words_, rare_tokens, rare_words), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Scores are log10 probabilities of whole texts with their end, base_score by add-half word
    frequencies. A null text is an empty one: its only token is the end. Repeated rows
    score alike, ties need no rule, and an empty table gives no rows. Kept columns that bear a result's name give way to it; other names do not matter.
    """
    results = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.select(*keep).columns
    kept = [(c, name) for c, name in zip(keep, names, strict=True) if name not in results]
    frame = bounded(docs).select(F.monotonically_increasing_id().alias("row_"), F.col(text).alias("text_"), *(c.alias(f"keep_{i}") for i, (c, _) in enumerate(kept)))
    columns, more = [c for c in frame.columns if c != "text_"], len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        every, size = len(m.log_step), len(m.count)
        base = np.append(m.base(m.count), 0.0)
        emit, cls, seen = np.append(m.log_emit, 0.0), np.append(m.cls, every - 1), np.append(m.count > 0, False)
        for b in batches:
            for lo, hi in cut(b.column(1)):
                h, off = tokens(b.column(1).slice(lo, hi - lo))
                x = m.table.find(h)
                c = cls[x]
                s = m.log_step[_steps(c, off, every - 2, every - 1), c] + emit[x]
                doc = np.repeat(np.arange(hi - lo), np.diff(off))
                new = x == size
                own, word = doc[new], h[new]
                order = np.lexsort((word, own))
                own, word = own[order], word[order]
                first = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(word, prepend=word[:1]) != 0))
                ends = np.searchsorted(own[first], np.arange(hi - lo + 1)).astype(np.int32)
                words = pa.StructArray.from_arrays([pa.array(word[first].view(np.int64)), pa.array(np.diff(first, append=len(own)))], names=["k", "times"])
                sums = [np.add.reduceat(v, off[:-1]) for v in (base[x], s, seen[x].astype(float))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(b.column(i + 2).slice(lo, hi - lo) for i in range(more)), pa.array(np.diff(off)), *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(ends), words)], names=[*columns, "n_tokens", "z", "s", "known", "other"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.drop("text_").schema), "n_tokens long, z double, s double, known double, other array<struct<k:long,times:long>>"])
    rows = stored(frame.mapInArrow(trimmed(run), schema))
    other = stored(rows.where(F.size("other") > 0).select("row_", F.explode("other").alias("o")).select("row_", "o.k", "o.times"))
    n = F.coalesce("n", F.lit(0))
    log = lambda of, words: F.log10((n + 0.5) / (of + 0.5 * (words + 1)))
    added = spread(other, counts, ["k"], "left").groupBy("row_").agg(F.sum(F.col("times") * log(model.tokens, model.words)).alias("z_"), F.sum(F.col("times") * log(model.rare_tokens, model.rare_words)).alias("s_"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("n_"))
    out = rows.drop("other").join(added, "row_", "left")
    total = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0.0))
    return out.select(*(F.col(f"keep_{i}").alias(name) for i, (_, name) in enumerate(kept)), "n_tokens", total("known", "n_").cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), total("z", "z_").alias("base_score"), total("s", "s_").alias("score"))
