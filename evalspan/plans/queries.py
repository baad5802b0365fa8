"""The queries of the core operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import metrics, panels, relations, rollouts, rules, storage, studies, texts
from .metrics import candidate_q_wilson

MODULES = (metrics, rollouts, panels, relations, texts, studies, storage, rules)

__all__ = ["candidate_q_wilson", "queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}
