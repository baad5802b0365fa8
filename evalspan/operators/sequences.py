"""Ordered states of a rollout: transitions, first hits, first changes, normalised rewards and returns.

A rollout has few steps by design, so its window is small however many rollouts a task has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values closer than this count as equal along a rollout, and standard deviations up to STD count as none.
EPS, STD = 1e-12, 1e-6


def transition_label(failing: Column, broken: Column, valid: Column, failing0: Column, broken0: Column, valid0: Column) -> Column:
    """From one state to the next: invalid, neutral, positive, negative or mixed by two counts of failing tests."""
    both = F.coalesce(valid, F.lit(False)) & F.coalesce(valid0, F.lit(False))
    return (
        F.when(~both, "invalid")
        .when((failing == failing0) & (broken == broken0), "neutral")
        .when((failing <= failing0) & (broken <= broken0), "positive")
        .when((failing >= failing0) & (broken >= broken0), "negative")
        .otherwise("mixed")
    )


def with_previous(df: DataFrame, keys: Sequence[str], step: str, columns: Sequence[str]) -> DataFrame:
    """The columns of the row before in ``prev_*``."""
    w = Window.partitionBy(*keys).orderBy(step)
    for c in (step, *columns):
        df = df.withColumn(f"prev_{c}", F.lag(c).over(w))
    return df


def first_hit(df: DataFrame, keys: Sequence[str], step: str, hit: str) -> DataFrame:
    """First step that passes, null if none does: partial minimum before the shuffle."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col(hit), F.col(step))).alias("first_hit"))


def first_change(df: DataFrame, keys: Sequence[str], step: str, value: str, eps: float = EPS) -> DataFrame:
    """First step whose value differs from the first state's (not from the one before); null values never differ."""
    w = Window.partitionBy(*keys).orderBy(step)
    start = F.first(value).over(w)
    marked = df.withColumn("_moved", F.when(F.abs(F.col(value) - start) > eps, F.col(step)))
    return marked.groupBy(*keys).agg(F.min("_moved").alias("first_change"))


def group_advantage(df: DataFrame, keys: Sequence[str], reward: str, out: str = "advantage") -> DataFrame:
    """(reward - mean) / population deviation within the group; 0 where the deviation is at most STD; null rewards stay null.

    The group's moments are aggregated first (partial sums), then joined back, so a hot group isn't one window.
    """
    moments = df.groupBy(*keys).agg(F.avg(reward).alias("_mean"), F.stddev_pop(reward).alias("_std"))
    m = moments.select(*[F.col(k).alias(f"_{k}") for k in keys], "_mean", "_std")
    joined = df.join(m, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    z = F.when(F.col("_std") > STD, (F.col(reward) - F.col("_mean")) / F.col("_std")).when(F.col(reward).isNotNull(), 0.0)
    return joined.withColumn(out, z).drop("_mean", "_std", *[f"_{k}" for k in keys])


def step_returns(df: DataFrame, keys: Sequence[str], step: str, potential: str, outcome: str, beta: float = 1.0) -> DataFrame:
    """Outcome plus beta times (last potential - potential before the step)."""
    ordered = Window.partitionBy(*keys).orderBy(step)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last(potential).over(whole)
    return df.withColumn("step_return", F.col(outcome).cast("double") + beta * (last - F.lag(potential).over(ordered)))


def rewards_to_go(df: DataFrame, keys: Sequence[str], step: str, reward: str, discount: float = 1.0) -> DataFrame:
    """Discounted sum of this and all later rewards of the rollout; null rewards count as 0."""
    later = Window.partitionBy(*keys).orderBy(step).rowsBetween(0, Window.unboundedFollowing)
    tail = F.collect_list(F.coalesce(F.col(reward), F.lit(0.0))).over(later)
    return df.withColumn("to_go", F.aggregate(F.reverse(tail), F.lit(0.0), lambda a, r: r + discount * a))


def advantages_to_go(
    df: DataFrame, keys: Sequence[str], step: str, reward: str, value: str, discount: float = 1.0, trace: float = 0.95, out: str = "gae"
) -> DataFrame:
    """Generalised advantages: the sum over this and later steps of the errors ``reward + discount * next value - value``,
    each weighted by ``discount * trace`` for every step in between. After the last step the value is 0; nulls count as 0."""
    ordered = Window.partitionBy(*keys).orderBy(step)
    v, r = F.coalesce(F.col(value), F.lit(0.0)), F.coalesce(F.col(reward), F.lit(0.0))
    error = r + discount * F.coalesce(F.lead(v).over(ordered), F.lit(0.0)) - v
    rows = df.withColumn("_error", error)
    return rewards_to_go(rows, keys, step, "_error", discount * trace).withColumnRenamed("to_go", out).drop("_error")


def silent_moves(df: DataFrame, keys: Sequence[str], step: str, shown: str, solved: str, hidden: str, eps: float = EPS) -> DataFrame:
    """Rollouts with a step at which the hidden value moves while the shown one and the outcome don't."""
    prev = with_previous(df, keys, step, [shown, solved, hidden])
    still = (F.abs(F.col(shown) - F.col(f"prev_{shown}")) <= eps) & (F.col(solved) == F.col(f"prev_{solved}"))
    moved = still & (F.abs(F.col(hidden) - F.col(f"prev_{hidden}")) > eps)
    return prev.groupBy(*keys).agg(F.coalesce(F.bool_or(moved), F.lit(False)).alias("silent"))
