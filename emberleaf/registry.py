"""All registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("text", "classify", "lifecycle", "search", "vectors", "fingerprint", "merkle", "graph", "supersession", "governance", "context", "sessions", "spatial", "joins", "streaming", "io", "metrics")
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"emberleaf.queries.{_name}")
    QUERIES |= _module.q.functions
    ORACLE |= _module.q.sql
