"""Keyed joins with integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def on_keys(keys: Sequence[str], left: str, right: str) -> list[Column]:
    """Null-safe equality of the keys under two aliases."""
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Full outer join on null-safe keys with a verdict: ``left_only``, ``right_only``, ``differs`` or ``equal``."""
    joined = a.alias("a").join(b.alias("b"), on_keys(keys, "a", "b"), "full")
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    verdict = F.when(F.col("b._in").isNull(), "left_only").when(F.col("a._in").isNull(), "right_only").when(same, "equal").otherwise("differs")
    return joined.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], verdict.alias("verdict"))


def checked_inner(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that raises if a row of ``a`` has no partner."""
    missing = a.join(b.select(*keys), list(keys), "left_anti").limit(1).count()
    if missing:
        raise ValueError("rows without a partner")
    return a.join(b, list(keys))


def with_fallback(rows: DataFrame, exact: DataFrame, key: str, profile: Column, profile_of: Column, order: str, take: Sequence[str]) -> DataFrame:
    """Left join on ``key``; where nothing matches, the first row of ``exact`` of the same profile.

    ``status`` is ``exact``, ``profile`` or ``none``. Each side of both joins has one row per key or profile.
    """
    by_profile = exact.withColumn("_p", profile_of).where("_p is not null").groupBy("_p").agg(
        F.min_by(F.struct(F.col(key).alias("_fk"), *[F.col(c).alias(f"_f{c}") for c in take]), F.col(order)).alias("_f")
    )
    e = exact.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_e{c}") for c in take])
    joined = rows.withColumn("_profile", profile).join(e, F.col(key) == F.col("_k"), "left").join(by_profile, F.col("_profile") == F.col("_p"), "left")
    status = F.when(F.col("_k").isNotNull(), "exact").when(F.col("_p").isNotNull(), "profile").otherwise("none")
    bound = F.coalesce("_k", F.col("_f._fk")).alias("bound_to")
    return joined.select(*rows.columns, status.alias("status"), bound, *[
        F.when(F.col("_k").isNotNull(), F.col(f"_e{c}")).otherwise(F.col(f"_f._f{c}")).alias(c) for c in take
    ])


def expected_grid(groups: DataFrame, axes: dict[str, tuple[int, int]]) -> DataFrame:
    """Each row of ``groups`` for every combination of the axes' numbers (inclusive ranges), by exploding sequences."""
    for name, (lo, hi) in axes.items():
        groups = groups.withColumn(name, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return groups


def missing_and_extra(have: DataFrame, want: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only: ``side`` is ``missing`` or ``extra``."""
    h, w = have.select(*keys).distinct(), want.select(*keys).distinct()
    return (
        w.join(h, list(keys), "left_anti").withColumn("side", F.lit("missing"))
        .unionByName(h.join(w, list(keys), "left_anti").withColumn("side", F.lit("extra")))
    )
