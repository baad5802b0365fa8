import random
from itertools import combinations

import pytest

from evalspan.functions import scalars as fn
from evalspan.operators import ranking

LEVELS = [0, 1, 2, 3, 4]


def rows(spark, data):
    return spark.createDataFrame(data, "task string, p double, q double, level int")


def one(df):
    (r,) = df.collect()
    return r


def test_wilson_of_four(spark):
    lo, hi = fn.wilson(spark.range(1).selectExpr("4 as s")["s"], spark.range(1).selectExpr("4 as s")["s"])
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, 4), (4, 4), (0, 0)], "s int, n int")
    lo, hi = fn.wilson(F.col("s"), F.col("n"))
    got = [tuple(r) for r in df.select(lo, hi).collect()]
    assert got[0] == (0.0, pytest.approx(0.48989, abs=1e-4)) and got[1] == (pytest.approx(0.51011, abs=1e-4), 1.0)
    assert got[2] == (None, None)


def test_constant_level_has_no_correlation(spark):
    df = rows(spark, [("a", 0.1 * i, 0.2 * i, 0) for i in range(3)])
    r = one(ranking.spearman(df, ["task"], "q", "level"))
    assert (r["rho"], r["reason"]) == (None, "constant_y")
    c = one(ranking.pair_counts(df, ["task"], "q", "level", LEVELS))
    assert (c["pairs"], c["scored"]) == (0, 0)


def test_tied_score_is_half(spark):
    df = rows(spark, [("a", 0.5, 0.7, 0), ("a", 0.5, 0.7, 4)])
    c = ranking.pair_counts(df, ["task"], "p", "level", LEVELS, [(0, 4)])
    r = one(c.withColumn("acc", ranking.accuracy(c["correct"], c["tied"], c["scored"])))
    assert (r["acc"], r["confident_pairs"]) == (0.5, 1)


def test_perfect_order(spark):
    df = rows(spark, [("a", (i + 1) / 5, 0.0, x) for i, x in enumerate([0, 1, 3, 4])])
    assert one(ranking.spearman(df, ["task"], "p", "level"))["rho"] == pytest.approx(1.0)
    c = one(ranking.pair_counts(df, ["task"], "p", "level", LEVELS))
    assert (c["pairs"], c["correct"]) == (6, 6)


def test_null_scores_leave_pairs_unscored(spark):
    df = rows(spark, [("a", 0.0, 0.2, 0), ("a", 0.0, None, 2), ("a", 0.0, 0.8, 4), ("a", 0.0, 0.8, None)])
    c = one(ranking.pair_counts(df, ["task"], "q", "level", LEVELS))
    assert (c["rows"], c["pairs"], c["scored"], c["correct"]) == (3, 3, 1, 1)


def test_one_row_and_empty_table(spark):
    df = rows(spark, [("a", 0.1, 0.1, 1), (None, 0.1, 0.1, 1), (None, 0.2, 0.3, 2)])
    got = {r["task"]: (r["rho"], r["reason"]) for r in ranking.spearman(df, ["task"], "p", "level").collect()}
    assert got["a"] == (None, "fewer_than_two_observations") and got[None][0] == pytest.approx(1.0)
    empty = rows(spark, [])
    assert ranking.spearman(empty, ["task"], "p", "level").count() == 0
    assert ranking.pair_counts(empty, ["task"], "p", "level", LEVELS).count() == 0


def test_counts_equal_brute_force(spark):
    rnd = random.Random(3)
    data = [(rnd.choice("ab"), rnd.choice([None, 0.0, 0.25, 0.5]), rnd.random() if rnd.random() < 0.8 else None, rnd.randrange(5)) for _ in range(120)]
    got = {r["task"]: r for r in ranking.pair_counts(rows(spark, data), ["task"], "p", "level", LEVELS).collect()}
    splits = {r["task"]: r for r in ranking.tie_splits(rows(spark, data), ["task"], "p", "q").collect()}
    for task in "ab":
        own = [d for d in data if d[0] == task]
        pairs = [(x, y) if x[3] < y[3] else (y, x) for x, y in combinations(own, 2) if x[3] != y[3]]
        scored = [(x, y) for x, y in pairs if x[1] is not None and y[1] is not None]
        assert got[task]["pairs"] == len(pairs) and got[task]["scored"] == len(scored)
        assert got[task]["correct"] == sum(x[1] < y[1] for x, y in scored)
        assert got[task]["tied"] == sum(x[1] == y[1] for x, y in scored)
        same = [(x, y) for x, y in combinations(own, 2) if x[1] == y[1]]
        assert (splits[task]["same"], splits[task]["split"]) == (len(same), sum(x[2] != y[2] for x, y in same))


def test_sixteen_samples_give_120_pairs(spark):
    df = rows(spark, [("a", 0.0, 0.5 * i / 16, 0) for i in range(16)])
    r = one(ranking.tie_splits(df, ["task"], "p", "q"))
    assert (r["same"], r["split"]) == (120, 120)
    df = rows(spark, [("a", 0.5, 0.25 if i < 8 else 0.75, 0) for i in range(16)])
    assert one(ranking.tie_splits(df, ["task"], "p", "q"))["split"] == 64


def test_reward_out_of_range_fails(spark):
    from pyspark.sql import functions as F

    df = rows(spark, [("a", 1.01, 0.1, 1)])
    with pytest.raises(Exception, match="out of range"):
        df.select(fn.terminal_reward(F.lit(True), F.col("p"))).collect()
