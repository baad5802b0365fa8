"""Deterministic selection: hash order, quotas, schedules. Every order has a total tie-break."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import seeded_digest


def hash_order(df: DataFrame, seed: str, key: str) -> DataFrame:
    """``df`` with ``digest``, by which an order replaces a seeded shuffle: the same on every run and cluster."""
    return df.withColumn("digest", seeded_digest(seed, F.col(key).cast("string")))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``; Spark keeps n rows per group and task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def viable_groups(df: DataFrame, group: str, least: int, n: int, seed: str) -> DataFrame:
    """The first ``n`` groups in hash order among those with ``least`` rows or more."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("rows")).where(F.col("rows") >= least)
    return hash_order(sizes, seed, group).orderBy("digest", group).limit(n)


def anchors_first(df: DataFrame, group: str, key: str, seed: str, n: int, least_groups: int = 3) -> DataFrame:
    """The first row of each group, then the others, all in hash order, cut to ``n``; the position is ``place``.

    Only the first ``n`` in order are kept on the way, so the last numbering has ``n`` rows. Raises if there are fewer
    than ``least_groups`` groups.
    """
    if least_groups and df.select(group).distinct().limit(least_groups).count() < least_groups:
        raise ValueError(f"fewer than {least_groups} groups")
    hashed = hash_order(df.select(group, key), seed, key)
    first = hashed.groupBy(group).agg(F.min(F.struct("digest", key)).alias("f")).select(F.col(group).alias("_g"), F.col("f.digest").alias("_d"))
    marked = hashed.join(first, (F.col(group).eqNullSafe(F.col("_g"))) & (F.col("digest") == F.col("_d")), "left")
    chosen = marked.select(group, key, "digest", F.col("_d").isNotNull().alias("anchor"))
    chosen = chosen.orderBy(F.col("anchor").desc(), "digest", key).limit(n)
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("anchor").desc(), "digest", key)))


def quota_panel(
    df: DataFrame, key: str, repo: str, outcome: str, order: Sequence[str], quotas: Mapping[bool, int], per_repo: int, strict: bool = True,
    edits: str | None = None, min_edits: int = 0, min_repos: int = 0,
) -> DataFrame:
    """Greedy panel: rows in order, skipping outcomes whose quota is full and repositories at their cap.

    Of one repository and outcome only the first ``per_repo`` rows can be taken: a later one finds the cap reached or
    the quota full, for good. A row of those is refused only where the quota is full or the other outcome has used up
    the cap, which the at most ``total`` taken rows can cause for ``total`` repositories. So per outcome the first
    ``quota + total * per_repo`` of them hold every row of the panel, whatever the input; one pass over that bounded
    number decides. If a quota can't be filled, or the
    panel has fewer than ``min_repos`` repositories, ``strict`` raises; else the panel is as large as it gets. Rows with a
    null repository or outcome, or fewer than ``min_edits`` in ``edits`` (null counts as none), are left out.
    """
    total = sum(quotas.values())
    if edits is not None:
        df = df.where(F.coalesce(edits, F.lit(0)) >= min_edits)
    rows = df.where(F.col(repo).isNotNull() & F.col(outcome).isNotNull()).select(key, repo, outcome, *[c for c in order if c not in (key, repo, outcome)])
    rows = top_per_group(rows, [repo, outcome], list(order), per_repo).drop("rank")
    spark, schema = df.sparkSession, df.select(key, repo, outcome).schema
    first = None
    for value, quota in quotas.items():
        part = rows.where(F.col(outcome) == value).orderBy(*order).limit(quota + total * per_repo)
        first = part if first is None else first.unionByName(part)
    left, used, taken = dict(quotas), {}, []
    for r in first.orderBy(*order).collect():  # bounded by the quotas, see above
        if left[r[outcome]] and used.get(r[repo], 0) < per_repo:
            left[r[outcome]] -= 1
            used[r[repo]] = used.get(r[repo], 0) + 1
            taken.append((r[key], r[repo], r[outcome]))
    if strict and any(left.values()):
        raise ValueError(f"the quotas can't be filled: {left} left")
    if strict and len(used) < min_repos:
        raise ValueError(f"{len(used)} repositories, {min_repos} wanted")
    return spark.createDataFrame(pd.DataFrame(taken, columns=schema.names), schema)


def round_robin(df: DataFrame, order: Sequence[str], updates: int, per_update: int) -> DataFrame:
    """``(update, slot)`` to rows of a frozen list, taken in turn and from the start again when used up.

    The schedule has ``updates * per_update`` rows and the frozen list is a panel of tasks, numbered in one window.
    """
    spark = df.sparkSession
    numbered = df.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) - 1)
    count = df.count()
    grid = spark.range(updates * per_update).select(
        F.floor(F.col("id") / per_update).alias("update"), (F.col("id") % per_update).alias("slot"), (F.col("id") % max(count, 1)).alias("_j")
    )
    return grid.join(numbered, F.col("_i") == F.col("_j")).drop("_i", "_j")


def priority_order(column: Column, keywords: Sequence[str]) -> Column:
    """Number of the first keyword that the text holds; one more than the last for none."""
    out = F.lit(len(keywords))
    for k in range(len(keywords) - 1, -1, -1):
        out = F.when(F.contains(column, F.lit(keywords[k])), k).otherwise(out)
    return out
