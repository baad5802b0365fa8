"""Row predicates as column expressions; every limit and word is a parameter. Nulls make a predicate false, not unknown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def holds(*conditions: Column) -> Column:
    """Whether all conditions hold; an unknown one doesn't."""
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def one_path(paths: Column, suffix: str, folders: Sequence[str], prefix: str) -> Column:
    """Exactly one path, with the suffix, and without a component, whatever its case, that is one of the folders or begins
    with the prefix."""
    path = F.get(paths, 0)
    parts = F.split(F.lower(path), "/")
    barred = F.exists(parts, lambda x: x.isin(*folders) | F.startswith(x, F.lit(prefix)))
    return holds(F.size(paths) == 1, F.endswith(path, F.lit(suffix)), ~barred)


def within(value: Column, least: float, most: float) -> Column:
    return holds(value.between(least, most))


def not_blank(*texts: Column) -> Column:
    return holds(*[F.trim(t) != "" for t in texts])


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.coalesce(F.contains(text, w), F.lit(False)))


def starts_with_any(text: Column, beginnings: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in beginnings]), lambda w: F.coalesce(F.startswith(text, w), F.lit(False)))


def retry(status: Column, finished: Sequence[str], reason: Column, reasons: Sequence[str]) -> Column:
    """A status that may be taken up again, or a reason that allows it."""
    return holds(status.isin(*finished)) | holds(reason.isin(*reasons))


def resolved(failing: Column, broken: Column, valid: Column) -> Column:
    """A valid state without failing and without broken tests."""
    return holds(valid, failing == 0, broken == 0)


def endpoint_gate(codes: Sequence[Column], curve: Column, agrees: Column) -> Column:
    """All return codes 0, a curve (``failing, valid`` in order) that begins valid with failing tests and ends valid, and an
    observed end that agrees with the declared one."""
    first, last = F.get(curve, 0), F.get(curve, F.size(curve) - 1)
    return holds(*[c == 0 for c in codes], F.size(curve) > 0, first["valid"], first["failing"] > 0, last["valid"], agrees)


def gold_gate(clean_passes: Column, injected_fails: Column) -> Column:
    return holds(clean_passes, injected_fails)
