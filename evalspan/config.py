"""Parameters of a run, read from JSON and checked once."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class RunConfig:
    """Sizes of a panel: tasks, candidates of each, continuations of a candidate, and steps of those."""

    tasks: int
    candidates: int = 16
    replicates: int = 4
    steps: int = 8
    seed: str = "panel-1"

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name != "seed" and (isinstance(value, bool) or not isinstance(value, int) or value < 1):
                raise ValueError(f"{f.name} must be a whole number of at least 1")

    @classmethod
    def load(cls, path: str) -> RunConfig:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        unknown = sorted(set(data) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown parameters: {unknown}")
        return cls(**data)
