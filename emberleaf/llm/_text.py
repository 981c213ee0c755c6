"""Vectorised word scanning over Arrow string columns, shared by the text operators.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; all of these are
single bytes in UTF-8, so scanning bytes is exact. Every function works on whole texts;
batches are only cut between documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_EXACT = np.arange(1, 257, dtype=np.uint64)
_EXACT[_SPACE] = 0
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))
_S = np.uint64(32), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _S[0])
    x *= _C
    x ^= x >> _S[1]
    x *= _B
    x ^= x >> _S[0]
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two hashes in this order."""
    return mix(a * _A + b * _B + _C)


_POWERS = mix(np.arange(1, 4097, dtype=np.uint64) * _A) | np.uint64(1)


_OTHER_POWERS = mix(np.arange(1, 4097, dtype=np.uint64) * _B) | np.uint64(1)


def _powers(n: int, other: bool = False) -> np.ndarray:
    known = _OTHER_POWERS if other else _POWERS
    return known if n <= len(known) else mix(np.arange(1, n + 1, dtype=np.uint64) * (_B if other else _A)) | np.uint64(1)


@dataclass
class Words:
    """off[i]:off[i+1] are the words of document i; start and end are byte positions in data."""

    data: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray | None = None

    def windows(self, size: int) -> np.ndarray:
        """Whether ``size`` words of one document begin at each word."""
        left = np.repeat(self.off[1:], np.diff(self.off)) - np.arange(len(self.start))
        return left >= size

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def text(self, keep: np.ndarray | None = None, sep: bytes = b" ") -> Iterator[bytes]:
        """Each document's kept words joined by ``sep``."""
        raw, start, end = self.data.tobytes(), self.start.tolist(), self.end.tolist()
        for lo, hi in zip(self.off[:-1].tolist(), self.off[1:].tolist(), strict=True):
            at = range(lo, hi) if keep is None else (np.flatnonzero(keep[lo:hi]) + lo).tolist()
            yield sep.join([raw[start[i] : end[i]] for i in at])


def strings(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if offsets and len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.zeros(0, np.uint8)
    return raw, off - off[0]


def scan(col: pa.Array, lower: bool = False, hashes: bool = True, letters: bool = False, other: bool = False) -> Words:
    """The words of each text of ``col``; ``lower`` folds A-Z before hashing.

    With ``letters``, ASCII characters other than letters and digits part words too. ``other`` gives hashes that are
    independent of the usual ones.
    """
    data, off = strings(col)
    n = len(data)
    space = (_PUNCTUATION if letters else _SPACE)[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    begins, ends = ~space, ~space
    begins[1:] &= space[:-1] | first[1:n]
    ends[:-1] &= space[1:] | first[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out = Words(data, np.searchsorted(start, off), start, end)
    if hashes:
        if not len(start):
            out.hash = np.zeros(0, np.uint64)
            return out
        longest = int((end - start).max())
        at = np.arange(start[0], n) - np.repeat(start, np.diff(start, append=n))
        value = (_LOWER if lower else _EXACT)[data[start[0] :]]
        if letters:
            value[space[start[0] :]] = 0
        value *= _powers(longest, other)[np.minimum(at, longest - 1, out=at)]
        out.hash = mix(np.add.reduceat(value, start - start[0]) + (end - start).astype(np.uint64) * _A)
    return out


def prefixes(w: Words, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the first bytes of each word, A-Z folded, for each of the growing ``sizes``."""
    out, h = [], np.zeros(len(w.start), np.uint64)
    for j in range(sizes[-1] if len(w.start) else 0):
        at = w.start + j
        inside = at < w.end
        h += np.where(inside, _LOWER[w.data[np.where(inside, at, 0)]], np.uint64(0)) * _POWERS[j]
        if j + 1 in sizes:
            out.append(mix(h + np.uint64((j + 1) * int(_B) & (1 << 64) - 1)))
    return out or [h] * len(sizes)


def cut(col: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each; a longer document stands alone."""
    _, off = strings(col)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's distinct shingles of ``size`` words, sorted, and their offsets.

    A document of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    n = np.diff(w.off)
    h = w.hash
    if not len(h):
        return h, np.zeros(len(n) + 1, np.int64)
    full = w.windows(size)
    first = w.off[:-1][(n > 0) & (n < size)]
    out = h.copy()
    doc = w.doc()
    for k in range(1, size):
        out[: len(h) - k] = pair(out[: len(h) - k], h[k:])
    use = full
    if len(first):
        use = full.copy()
        for i in first.tolist():
            one = h[i : i + 1].copy()
            for k in range(i + 1, int(w.off[doc[i] + 1])):
                one = pair(one, h[k : k + 1])
            out[i] = one[0]
            use[i] = True
    out, doc = out[use], doc[use]
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[new], doc[new]
    return out, np.searchsorted(doc, np.arange(len(n) + 1))
