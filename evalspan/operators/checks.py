"""Integrity constraints as queries: a rule holds if its query is empty."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break each rule, counted in one pass: ``rule, broken``. A null condition counts as broken."""
    sums = df.agg(*[F.sum((~F.coalesce(c, F.lit(False))).cast("long")).alias(n) for n, c in rules.items()])
    pairs = ", ".join(f"'{n}', `{n}`" for n in rules)
    return sums.selectExpr(f"stack({len(rules)}, {pairs}) as (rule, broken)").withColumn("broken", F.coalesce("broken", F.lit(0)))


def broken_rows(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the broken ones: for a quarantine table."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]))
    return df.withColumn("broken", names).where(F.size("broken") > 0)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``child`` without a row in ``parent``."""
    return child.join(parent.select(*keys).distinct(), list(keys), "left_anti")


def dependency_breaks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys with more than one different value (null aside), from the extremes alone."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("most"))
    return ends.where("least <> most")


def require_empty(df: DataFrame, message: str) -> None:
    if not df.isEmpty():
        raise ValueError(message)


def forbid_columns(df: DataFrame, names: Sequence[str]) -> None:
    """Guard against leakage: raises if the table has one of the columns."""
    found = sorted(set(names) & set(df.columns))
    if found:
        raise ValueError(f"columns that must not be here: {found}")
