"""Secret scanning by assignment-aware lexing.

Three token patterns give the base spans. Beside them a lexer reads source and configuration
lines as assignments of literals to names (quoted or bare, joined by ``+``), carries constants
from name to name in reading order, and scores each literal by the sensitive words of the names
that it reaches and by its own look. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberleaf.llm._spark import bounded, trimmed

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.ASCII)
HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)

#: A name is sought once in each run of its characters, never from within, so that long runs take linear time.
PAIR = re.compile(r"""(?<![A-Za-z0-9_.\-])[0-9.\-]*+([A-Za-z_][A-Za-z0-9_.\-]*+)["'\]]{0,2}[ \t]*+(?::=|=>|=(?!=)|:(?!//))""", re.ASCII)
TERM = re.compile(r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([A-Za-z0-9_$./+~-]+=*))""", re.ASCII)
PLUS = re.compile(r"[ \t]*\+(?!\+)", re.ASCII)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.ASCII)
WEIGHTS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "authorization": 0.8, "key": 0.4}
KEY_OF = {"api", "access", "private", "signing", "encryption", "secret", "client", "auth"}
PLACEHOLDER = re.compile(r"(?i)^(?:change_?me|example|placeholder|none|null|true|false|undefined|redacted|dummy|x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%)$", re.ASCII)
SENSITIVE, LOOK = 0.6, 0.5


def name_score(name: str) -> float:
    """How sensitive a name's words are, 0 to 1."""
    parts = [p.lower() for p in PARTS.findall(name)]
    best = max([WEIGHTS.get(p, 0.0) for p in parts], default=0.0)
    return 1.0 if "key" in parts and KEY_OF & set(parts) else best


def literal_score(value: str) -> float:
    """How much a literal looks like a credential, 0 to 1: bits of entropy against 24."""
    if len(value) < 6 or any(c.isspace() for c in value) or PLACEHOLDER.match(value):
        return 0.0
    bits = -sum(n * math.log2(n / len(value)) for n in Counter(value).values())
    mixed = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    return min(1.0, bits / 24) * (0.6 if mixed < 2 else 1.0)


#: Characters of a joined value that are kept as text; of longer ones the counts of characters are.
KEPT = 4096


class Value:
    """What a name is assigned: its own spans and the values of the constants it joins, by reference, with what their score needs."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int]] = []
        self.of: list[Value] = []
        self.size, self.text, self.head, self.tail = 0, "", "", ""
        self.counts: Counter[str] = Counter()

    def add(self, size: int, text: str | None, head: str, tail: str, counts: Counter[str]) -> None:
        self.size += size
        self.text = self.text + text if self.size <= KEPT and self.text is not None and text is not None else None
        self.head, self.tail = (self.head + head)[:2], (self.tail + tail)[-2:]
        self.counts.update(counts)

    def literal(self, span: tuple[int, int], text: str) -> None:
        self.spans.append(span)
        self.add(len(text), text, text[:2], text[-2:], Counter(text))

    def constant(self, value: Value) -> None:
        self.of.append(value)
        self.add(value.size, value.text, value.head, value.tail, value.counts)

    def score(self) -> float:
        """``literal_score`` of the joined text."""
        if self.text is not None:
            return literal_score(self.text)
        every = "".join(self.counts)
        if any(c.isspace() for c in every) or PLACEHOLDER.match(self.head + every * 12 + self.tail):
            return 0.0
        share = [n / self.size for n in self.counts.values()]
        bits = -sum(p * math.log2(p) for p in share if p) * min(self.size, 1 << 60)
        mixed = sum(any(f(c) for c in every) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in every)
        return min(1.0, bits / 24) * (0.6 if mixed < 2 else 1.0)


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name directly or through constants."""
    known: dict[str, Value] = {}
    found: set[tuple[int, int]] = set()
    reached: set[Value] = set()
    for m in PAIR.finditer(text):
        at, own = m.end(), Value()
        while t := TERM.match(text, at):
            k = t.lastindex
            value = t[k]
            if k == 3 and value in known:
                own.constant(known[value])
            elif value:
                own.literal(t.span(k), value)
            at = t.end()
            if not (plus := PLUS.match(text, at)):
                break
            at = plus.end()
        if own.size:
            known[m[1]] = own
            if name_score(m[1]) >= SENSITIVE and own.score() >= LOOK:
                todo = [own]
                while todo:
                    if (one := todo.pop()) not in reached:
                        reached.add(one)
                        found.update(one.spans)
                        todo += one.of
    return sorted(found)


def scan_text(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans of ``text`` as (start, end, kind), by start, then kind as listed."""
    base = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    base += [(*m.span(), "hex") for m in HEX.finditer(text)]
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    every = base + [(a, b, "literal") for a, b in literals(text)] if "=" in text or ":" in text else base
    return sorted(base, key=order), sorted(every, key=order)


def find_secrets(docs: DataFrame, text: str = "text", replacement: str | None = None) -> DataFrame:
    """``docs`` with ``spans`` (array of start, end, kind), ``n_assign``, ``n_access``, ``n_hex`` and ``base``.

    ``base`` is the base spans as ``kind:start:end`` joined by commas. With ``replacement`` the text
    column has every span, overlapping ones as one, replaced by it. A null text is empty and, when
    replaced, stays null. Columns that bear a result's name are replaced, others pass through.
    Rows are independent, so repeated rows, ties and empty tables need no rule.
    """
    kinds = {"n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base": "string", "spans": "array<struct<start:bigint,end:bigint,kind:string>>"}
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    names = [c for c in docs.columns if c not in kinds or c == text]
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                texts = part.column(names.index(text)).to_pylist()
                base, every = map(list, zip(*(scan_text(s or "") for s in texts), strict=True))
                out = [pa.array([sum(s[2] == k for s in row) for row in base], pa.int64()) for k in KINDS[:3]]
                out.append(pa.array([joined(row) for row in base], pa.string()))
                out.append(pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in row] for row in every], span))
                kept = list(part.columns)
                if replacement is not None:
                    kept[names.index(text)] = pa.array([s and masked(s, row, replacement) for s, row in zip(texts, every, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*kept, *out], names=[*names, *kinds])

    frame = bounded(docs).select(*quoted)
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in frame.schema), *(f"{k} {v}" for k, v in kinds.items())])
    return frame.mapInArrow(trimmed(run), schema)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def masked(text: str, spans: list[tuple[int, int, str]], replacement: str) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if b <= at:
            continue
        if a >= at and (a > at or not out):
            out += [text[at:a], replacement]
        at = b
    return "".join([*out, text[at:]])


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
