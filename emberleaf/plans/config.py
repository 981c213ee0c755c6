"""Settings of an engine, checked when made."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from emberleaf.operators.lifecycle import MIN_BYTES, THRESHOLDS

SENSITIVE = ("/etc", "/root/.ssh", "/proc", "/sys", "/dev")


@dataclass
class Config:
    """``sources`` maps labels to folders; ``thresholds`` has hours of age and rest for each tier."""

    sources: dict[str, str] = field(default_factory=dict)
    pattern: str = "*.md"
    thresholds: dict[str, list[float]] = field(default_factory=lambda: {k: list(v) for k, v in THRESHOLDS.items()})
    min_bytes: int = MIN_BYTES
    hide_superseded: bool = True
    budget_tokens: int = 2000
    recycle_days: float = 7.0

    def __post_init__(self) -> None:
        for path in self.sources.values():
            if any(path == s or path.startswith(s + "/") for s in SENSITIVE):
                raise ValueError(f"protected folder: {path}")
        if set(self.thresholds) != set(THRESHOLDS) or any(len(v) != 2 or min(v) < 0 for v in self.thresholds.values()):
            raise ValueError("thresholds need two hours, 0 or more, for each tier")
        if self.min_bytes < 0 or self.budget_tokens < 1 or self.recycle_days < 0:
            raise ValueError("min_bytes, budget_tokens and recycle_days must not be negative")

    @classmethod
    def from_json(cls, text: str) -> Config:
        """Keys that are not settings are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(text).items() if k in known})

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)
