"""Rank correlation and pairwise ranking accuracy without listing pairs.

Every metric first counts the distinct (score, level) cells of a group, a hash aggregation with partial sums, and then
runs windows over the cells. A group with a third of all rows costs its number of distinct scores, not its square.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "avg_rank") -> DataFrame:
    """``keys, value, n`` and the 1-based mean rank of each distinct value; null values have no rank and are left out."""
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    below = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn(out, F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2.0)


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Tie-aware rank correlation per group over rows where both are known: ``keys, n, rho, reason``.

    ``rho`` is null with a reason: ``fewer_than_two_observations``, ``constant_y``, ``constant_x``, in that order.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = rows.groupBy(*keys, x, y).agg(F.count("*").alias("w"))
    rx = average_ranks(rows, keys, x, "rx").select(*keys, x, "rx")
    ry = average_ranks(rows, keys, y, "ry").select(*keys, y, "ry")
    on_keys = lambda a, b, extra: [a[k].eqNullSafe(b[k]) for k in keys] + [a[extra] == b[extra]]
    ranked = cells.join(rx, on_keys(cells, rx, x)).select(*[cells[k] for k in keys], cells[x], cells[y], "w", "rx")
    ranked = ranked.join(ry, on_keys(ranked, ry, y)).select(*[ranked[k] for k in keys], "w", "rx", "ry")
    # ranks are halves of whole numbers: the doubled sums are exact
    a, b, w = F.col("rx") * 2, F.col("ry") * 2, F.col("w")
    sums = ranked.groupBy(*keys).agg(
        F.sum("w").alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * b).alias("sab"),
        F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"),
    )
    n = F.col("n")
    va, vb = n * F.col("saa") - F.col("sa") ** 2, n * F.col("sbb") - F.col("sb") ** 2
    rho = F.when((n >= 2) & (va > 0) & (vb > 0), F.try_divide(n * F.col("sab") - F.col("sa") * F.col("sb"), F.sqrt(va) * F.sqrt(vb)))
    reason = F.when(n < 2, "fewer_than_two_observations").when(vb <= 0, "constant_y").when(va <= 0, "constant_x")
    return sums.select(*keys, "n", rho.alias("rho"), reason.alias("reason"))


def pair_counts(
    df: DataFrame, keys: Sequence[str], score: str, level: str, levels: Sequence[int], confident: Sequence[tuple[int, int]] = ()
) -> DataFrame:
    """Pairs of rows of different level per group, and how the score orders them.

    ``level`` takes few values, all listed in ``levels``; rows with another or no level don't count. Returns ``keys,
    rows, pairs, scored, correct, tied`` and the same four for the level pairs listed in ``confident``. A row without a
    score has pairs, but none that is scored. Exact ties of the score are counted apart, so that they can be worth a
    half or nothing.
    """
    rows = df.where(F.col(level).isin(*levels))
    at = [F.sum((F.col(level) == v).cast("long")).alias(f"n{i}") for i, v in enumerate(levels)]
    cells = rows.groupBy(*keys, score).agg(*at)
    # without the null score, which is a cell of its own
    known = F.col(score).isNotNull().cast("long")
    below = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    k = range(len(levels))
    cells = cells.select(
        *keys, *[F.col(f"n{i}") for i in k], *[(F.col(f"n{i}") * known).alias(f"s{i}") for i in k],
        *[F.coalesce(F.sum(F.col(f"n{i}") * known).over(below), F.lit(0)).alias(f"b{i}") for i in k],
    )
    pairs = [(i, j) for i in k for j in k if levels[i] < levels[j]]
    sums = cells.groupBy(*keys).agg(
        *[F.sum(f"n{i}").alias(f"n{i}") for i in k], *[F.sum(f"s{i}").alias(f"s{i}") for i in k],
        *[F.sum(F.col(f"s{j}") * F.col(f"b{i}")).alias(f"c{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(f"s{j}") * F.col(f"s{i}")).alias(f"t{i}_{j}") for i, j in pairs],
    )

    def total(prefix: str, chosen) -> Column:
        out = F.lit(0).cast("long")
        for i, j in chosen:
            out = out + {"pairs": F.col(f"n{i}") * F.col(f"n{j}"), "scored": F.col(f"s{i}") * F.col(f"s{j}"),
                         "correct": F.col(f"c{i}_{j}"), "tied": F.col(f"t{i}_{j}")}[prefix]
        return out

    sure = [(i, j) for i, j in pairs if (levels[i], levels[j]) in set(confident)]
    names = ("pairs", "scored", "correct", "tied")
    every = F.lit(0).cast("long")
    for i in k:
        every = every + F.col(f"n{i}")
    return sums.select(
        *keys, every.alias("rows"), *[total(c, pairs).alias(c) for c in names],
        *[total(c, sure).alias(f"confident_{c}") for c in names],
    )


def accuracy(correct: Column, tied: Column, scored: Column, tie: float = 0.5) -> Column:
    """Share of scored pairs in the right order, ties at ``tie``; null without scored pairs."""
    return F.try_divide(correct + tie * tied, scored)


def tie_splits(df: DataFrame, keys: Sequence[str], tied: str, splitter: str) -> DataFrame:
    """Pairs of rows equal in ``tied``, and how many of them ``splitter`` tells apart: ``keys, same, split``.

    From group sizes alone: n (n - 1) / 2 less the pairs that are equal in both. Null counts as a value.
    """
    both = df.groupBy(*keys, tied, splitter).agg(F.count("*").alias("m"))
    one = both.groupBy(*keys, tied).agg(F.sum("m").alias("n"), F.sum(F.col("m") * (F.col("m") - 1)).alias("equal"))
    halves = F.sum(F.col("n") * (F.col("n") - 1)).alias("_all"), F.sum("equal").alias("_equal")
    return one.groupBy(*keys).agg(*halves).select(
        *keys, (F.col("_all") / 2).cast("long").alias("same"), ((F.col("_all") - F.col("_equal")) / 2).cast("long").alias("split")
    )


def replicate_pairs(df: DataFrame, keys: Sequence[str], member: str, columns: Sequence[str]) -> DataFrame:
    """All pairs of members of a small group (a candidate's few replicates): an equi-join on the group with ``a < b``.

    Meant for groups whose size is bounded by the design of the data; pairs grow with the square of that bound only.
    """
    a = df.select(*keys, F.col(member).alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = df.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(member).alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("a") < F.col("b")]
    return a.join(b, on).drop(*[f"_{k}" for k in keys])
