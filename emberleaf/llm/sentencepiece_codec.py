"""SentencePiece encoding and decoding by a merge-type prefix table.

For a BPE vocabulary the encoding of each prefix of a text ends in exactly one token. Scanning
left to right, the automaton of all pieces proposes the tokens that end at a position; the one
whose left neighbour (the last token of the prefix before it) survives next to it unmerged is the
last token of this prefix. The ids are then read backwards from the end of the text. Whether two
tokens survive side by side depends on the two alone, so that answer is kept.

No piece of these vocabularies holds a word mark after another character, so no merge crosses the
start of a word and words are encoded one by one; a vocabulary without that property is scanned
as one word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberleaf.llm._spark import bounded, trimmed

MARK = "▁"
#: Bytes of the words whose answers a worker keeps, and pairs of pieces.
CACHED_BYTES, CACHED_PAIRS = 256 << 20, 300_000
#: Bytes that an answer takes besides its texts.
ENTRY_BYTES = 260


class Codec:
    """Encodes as the sentencepiece library does, for BPE models with byte fallback and no text normalisation."""

    def __init__(self, model: bytes, cached_bytes: int = CACHED_BYTES) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(model)
        norm = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or not proto.trainer_spec.byte_fallback or kinds - {1, 2, 3, 6}:
            raise ValueError("only BPE models with byte fallback, a dummy prefix, no normalisation and no user-defined pieces are supported")
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.word = re.compile(f"{MARK}+[^{MARK}]*") if not any(MARK in p.lstrip(MARK) for p in self.ids) else re.compile("(?s).+")
        self.pieces: dict[int, bytes] = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()}
        self.pieces |= {i: bytes([b]) for b, i in self.bytes.items()}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if self.merged(p) == [p]:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, tuple[int, str, bytes]] = {}
        self.cached_bytes, self.used = cached_bytes, 0

    def merged(self, s: str) -> list[str]:
        """``s`` by repeatedly merging the best-scored adjacent pair, leftmost first."""
        out, scores = list(s), self.scores
        while len(out) > 1:
            best, at = None, -1
            for i in range(len(out) - 1):
                score = scores.get(out[i] + out[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def compatible(self, a: str, b: str) -> bool:
        key = (a, b)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(a + b) == [a, b]
        return found

    def tokens(self, s: str) -> list[str]:
        """Tokens of one word; a character outside the vocabulary is a token of its own."""
        last: list[str | None] = [None] * len(s)
        at = 0
        for end, piece in self.automaton.iter(s):
            while at < end:
                last[at] = last[at] or s[at]
                at += 1
            if last[end] is None:
                start = end - len(piece)
                if start < 0 or self.compatible(last[start], piece):  # type: ignore[arg-type]
                    last[end] = piece
        while at < len(s):
            last[at] = last[at] or s[at]
            at += 1
        out, end = [], len(s) - 1
        while end >= 0:
            out.append(last[end])
            end -= len(last[end])  # type: ignore[arg-type]
        return out[::-1]  # type: ignore[return-value]

    def _miss(self, s: str) -> tuple[int, str, bytes]:
        ids: list[int] = []
        for t in self.tokens(s):
            ids += [self.ids[t]] if t in self.ids else [self.bytes[b] for b in t.encode()]
        got = len(ids), ",".join(map(str, ids)), b"".join(map(self.pieces.__getitem__, ids))
        if len(s) <= 64:
            if self.used > self.cached_bytes:
                self.cache.clear()
                self.used = 0
            self.used += ENTRY_BYTES + 2 * len(s) + len(got[1]) + len(got[2])
            self.cache[s] = got
        return got

    def words(self, text: str) -> list[tuple[int, str, bytes]]:
        """Number of ids, ids in decimal joined by commas and decoded bytes, word by word."""
        if not text:
            return []
        get, miss = self.cache.get, self._miss
        return [get(s) or miss(s) for s in self.word.findall(MARK + text.replace(" ", MARK))]

    def encode(self, text: str) -> list[int]:
        return [int(i) for w in self.words(text) for i in w[1].split(",")]

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.pieces.__getitem__, ids))
        return out.removeprefix(b" ").decode(errors="replace")


_codecs: dict[tuple[str, int], Codec] = {}


def codec(model: bytes, cached_bytes: int = CACHED_BYTES) -> Codec:
    """One codec for each model in a Python worker, so that its caches outlive a task."""
    key = hashlib.sha256(model).hexdigest(), cached_bytes
    if key not in _codecs:
        _codecs[key] = Codec(model, cached_bytes)
    return _codecs[key]


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: bool = True, cached_bytes: int = CACHED_BYTES) -> DataFrame:
    """``docs`` with columns ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, unless ``ids`` is off, ``ids`` and ``decoded``.

    The model file is read on the driver and sent along; its size does not depend on the data. A worker keeps the answers of
    words, of about ``cached_bytes`` in all. A
    null text is an empty one and has no ids. Other columns pass through, but for
    such that bear a result's name, which it replaces. Rows are independent: repeated rows and
    ties need no rule, an empty table stays empty, and a long text is encoded whole.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    extra = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    if ids:
        extra |= {"ids": pa.list_(pa.int32()), "decoded": pa.string()}
        kinds |= {"ids": "array<int>", "decoded": "string"}
    kept = [c for c in docs.columns if c not in kinds or c == text]
    names = [c for c in kept if c not in kinds]
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shipped.value, cached_bytes)
        for batch in batches:
            col, step = batch.column(kept.index(text)), 256 if ids else 4096
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                rows = []
                for s in col.slice(lo, step).to_pylist():
                    words = coder.words(s or "")
                    joined = ",".join([w[1] for w in words])
                    decoded = b"".join([w[2] for w in words]).removeprefix(b" ")
                    row = [sum([w[0] for w in words]), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                    rows.append([*row, [int(i) for i in joined.split(",")] if joined else [], decoded.decode()] if ids else row)
                columns = list(map(list, zip(*rows, strict=True))) or [[] for _ in extra]
                yield pa.RecordBatch.from_arrays([*(part.column(kept.index(c)) for c in names), *(pa.array(c, t) for c, t in zip(columns, extra.values(), strict=True))], names=[*names, *extra])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*map(_name, names)).schema), *(f"{k} {v}" for k, v in kinds.items())])
    return bounded(docs).select(*map(_name, kept)).mapInArrow(trimmed(run), schema)


def _name(c: str):
    return F.col("`" + c.replace("`", "``") + "`")
