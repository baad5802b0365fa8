import math

import pytest
from pyspark.sql import functions as F

from evalspan.operators import selection, sequences


def test_generalised_advantages_equal_a_loop(spark):
    rows = [("a", i, r, v) for i, (r, v) in enumerate([(0.0, 0.2), (None, 0.5), (1.0, None), (0.5, 0.1)])] + [("b", 0, 1.0, 0.4)]
    df = spark.createDataFrame(rows, "k string, t int, r double, v double")
    got = {(x["k"], x["t"]): x["gae"] for x in sequences.advantages_to_go(df, ["k"], "t", "r", "v", 0.9, 0.8).collect()}
    for k in "ab":
        own, run, after = [x for x in rows if x[0] == k], 0.0, 0.0
        for _, t, r, v in reversed(own):
            run = (r or 0) + 0.9 * after - (v or 0) + 0.72 * run
            after = v or 0
            assert abs(got[k, t] - run) < 1e-12


def test_a_panel_needs_edits_and_repositories(spark):
    rows = [(i, f"r{i % 3}", i % 2 == 0, i, None if i == 0 else i) for i in range(12)]
    df = spark.createDataFrame(rows, "key long, repo string, ok boolean, o long, edits long")
    take = lambda **x: selection.quota_panel(df, "key", "repo", "ok", ["o"], {True: 2, False: 2}, 2, edits="edits", **x)
    assert sorted(r["key"] for r in take(min_edits=4).collect()) == [4, 5, 6, 7]
    assert sorted(r["key"] for r in take(min_edits=1, min_repos=3).collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="repositories"):
        take(min_edits=1, min_repos=4)


def test_transition_labels(spark):
    data = [(2, 0, True, 3, 0, True), (3, 1, True, 3, 0, True), (2, 1, True, 3, 0, True), (3, 0, True, 3, 0, True), (1, 0, True, 3, 0, False), (None, 0, None, 3, 0, True)]
    df = spark.createDataFrame(data, "f int, r int, v boolean, f0 int, r0 int, v0 boolean")
    label = sequences.transition_label(*[F.col(c) for c in ("f", "r", "v", "f0", "r0", "v0")])
    assert [r[0] for r in df.select(label).collect()] == ["positive", "negative", "mixed", "neutral", "invalid", "invalid"]


def test_step_returns(spark):
    phi = [0, 0.2, 0.1, 0.4, 0.4, 0.5, 0.6, 0.7, 0.8]
    df = spark.createDataFrame([("t", i, float(x), False) for i, x in enumerate(phi)], "k string, step int, phi double, y boolean")
    got = {r["step"]: r["step_return"] for r in sequences.step_returns(df, ["k"], "step", "phi", "y", 0.5).collect()}
    assert got[1] == pytest.approx(0.4) and got[2] == pytest.approx(0.3) and got[0] is None


def test_advantages_of_sixteen_and_of_equal_rewards(spark):
    data = [("a", i, i / 16) for i in range(16)] + [("b", i, 0.5) for i in range(4)] + [(None, 0, 1.0), ("b", 9, None)]
    out = sequences.group_advantage(spark.createDataFrame(data, "g string, i int, r double"), ["g"], "r").collect()
    a = [r["advantage"] for r in out if r["g"] == "a"]
    assert math.isclose(sum(a), 0, abs_tol=1e-9) and math.isclose(sum(x * x for x in a), 16)
    assert {r["advantage"] for r in out if r["g"] == "b"} == {0.0, None} and len(out) == 22


def test_first_change_compares_with_the_first_state(spark):
    df = spark.createDataFrame([("k", 0, 0.5), ("k", 1, 0.5), ("k", 2, 0.6), ("k", 3, 0.5)], "k string, step int, v double")
    assert sequences.first_change(df, ["k"], "step", "v").first()["first_change"] == 2


def test_rewards_to_go(spark):
    df = spark.createDataFrame([("k", i, float(i)) for i in (1, 2, 3)], "k string, step int, r double")
    got = {r["step"]: r["to_go"] for r in sequences.rewards_to_go(df, ["k"], "step", "r", 0.5).collect()}
    assert got == {1: pytest.approx(1 + 1 + 0.75), 2: pytest.approx(3.5), 3: 3.0}


def panel_rows(spark, n=40):
    data = [(f"k{i:03d}", f"r{i % 7}", i % 3 == 0) for i in range(n)] + [("x", None, True), ("y", "r1", None)]
    return spark.createDataFrame(data, "key string, repo string, ok boolean")


def greedy(data, quotas, cap):
    left, used, out = dict(quotas), {}, []
    for key, repo, ok in sorted(data):
        if repo is not None and ok is not None and left[ok] and used.get(repo, 0) < cap:
            left[ok] -= 1
            used[repo] = used.get(repo, 0) + 1
            out.append(key)
    return out


@pytest.mark.parametrize("quotas,cap", [({True: 4, False: 4}, 2), ({True: 1, False: 9}, 3), ({True: 7, False: 0}, 1)])
def test_quota_panel_equals_one_long_scan(spark, quotas, cap):
    df = panel_rows(spark)
    got = selection.quota_panel(df, "key", "repo", "ok", ["key"], quotas, cap)
    assert sorted(r["key"] for r in got.collect()) == greedy([tuple(r) for r in df.collect() if r["repo"] and r["ok"] is not None], quotas, cap)


def test_quota_panel_fails_where_it_cannot_be_filled(spark):
    with pytest.raises(ValueError, match="can't be filled"):
        selection.quota_panel(panel_rows(spark, 5), "key", "repo", "ok", ["key"], {True: 9, False: 0}, 1)


def test_anchors_first_needs_groups(spark):
    out = selection.anchors_first(panel_rows(spark).where("repo is not null"), "repo", "key", "s", 10).orderBy("place").collect()
    assert [r["anchor"] for r in out] == [True] * 7 + [False] * 3
    with pytest.raises(ValueError):
        selection.anchors_first(panel_rows(spark).where("repo = 'r1'"), "repo", "key", "s", 10)


def test_round_robin_starts_again(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "t string")
    got = [r["t"] for r in selection.round_robin(df, ["t"], 2, 2).orderBy("update", "slot").collect()]
    assert got == ["a", "b", "c", "a"]
