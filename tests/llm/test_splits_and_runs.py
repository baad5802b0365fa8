import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspan.llm import components, runs, splits


def union_find(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {x: root(x) for x in list(parent)}


def test_components_equal_union_find(spark, work):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1064)]
    pairs += [(500, i) for i in range(2000, 2100)] + [(7, 7), (None, 3), (3, None)] + [(1, 2)] * 5
    df = spark.createDataFrame(pairs, "a int, b int")
    got = {r["node"]: r["component"] for r in components.connected_components(df, "a", "b", work).collect()}
    want = union_find(pairs)
    assert got == want


def test_components_of_heavy_nodes(spark, work, monkeypatch):
    monkeypatch.setattr(components, "HEAVY_FLOOR", 5)
    pairs = [(0, i) for i in range(1, 80)] + [(200, i) for i in range(150, 190)] + [(79, 200)]
    df = spark.createDataFrame(pairs, "a int, b int")
    got = {r["node"]: r["component"] for r in components.connected_components(df, "a", "b", work).collect()}
    assert set(got.values()) == {0} and len(got) == 80 + 41


def test_components_of_nothing(spark, work):
    assert components.connected_components(spark.createDataFrame([], "a string, b string"), "a", "b", work).count() == 0


ROWS = [
    (1, "own__repo.1a2b3c4d.x__1", "lab/bench.x86_64.own_1776_repo.1a2b3c4d", "train"),
    (2, "OWN__Repo.ffff0000.x__2", " reg:5000/lab/bench.arm64.own__re_po.ffff0000@sha256:12", "held_out"),
    (3, "own__re-po.00001111.x__3", None, "Train "),
    (4, "other__repo.00001111.x__4", None, "heldout"),
    (5, None, None, "train"),
    (6, None, None, "heldout"),
    (7, "own__repo.1a2b3c4d.x__1", "lab/bench.x86_64.own_1776_repo.1a2b3c4d", None),
    (8, "", "nothing here", "train"),
]


def grouped(spark, work, rows=ROWS, floor=splits.HEAVY_FLOOR):
    df = spark.createDataFrame(rows, "row_id long, instance_id string, image_name string, split string")
    for name in ("component", "_entity", "_row", "group_id", "n", "hot", "a"):  # columns that clash with those inside
        df = df.withColumn(name, F.lit(1))
    entities = [splits.repository(F.col("instance_id")), splits.repository(F.col("image_name"))]
    return splits.group_records(df, "row_id", entities, work, floor)


@pytest.mark.parametrize("floor", [1, splits.HEAVY_FLOOR])  # entities and groups heavy or not
def test_groups_follow_chains(spark, work, floor):
    got = {r["row_id"]: r["group_id"] for r in grouped(spark, work, floor=floor).collect()}
    assert len({got[i] for i in (1, 2, 3, 7)}) == 1 and len({got[i] for i in (1, 4, 5, 6, 8)}) == 5 and len(got) == len(ROWS)
    broken = splits.broken_groups(grouped(spark, work, floor=floor), "split", len(ROWS), floor)
    assert sorted(r["row_id"] for r in broken.collect()) == [1, 2, 3]


def test_rows_of_a_hot_entity_are_not_shuffled(spark, work):
    # half of all rows name one repository, a quarter none
    df = spark.range(8000).selectExpr("id as row_id", "case when id % 4 = 3 then null when id % 2 = 0 then 'hot' else concat('e', id) end as e", "if(id = 0, 'tied', null) as f")
    out = splits.group_records(df, "row_id", [F.col("e"), F.col("f")], work, 100)
    groups = {r["group_id"]: r["n"] for r in out.groupBy("group_id").agg(F.count("*").alias("n")).collect()}
    assert max(groups.values()) == 4000 and len(groups) == 1 + 2000 + 2000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Union" in plan and plan.count("SortMergeJoin") <= 1  # the join of the other rows


def test_no_rows(spark, work):
    assert grouped(spark, work, []).count() == 0


def test_assigned_shares_and_stability(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("g")).withColumn("s", splits.assign_split(F.col("g")))
    n = {r["s"]: r["count"] for r in df.groupBy("s").count().collect()}
    assert abs(n["train"] / 20000 - 0.8) < 0.02 and abs(n["validation"] / 20000 - 0.1) < 0.02 and sum(n.values()) == 20000


def collapse(spark, work, data, chunk=4):
    df = spark.createDataFrame(data, "a string, step int, text string, sha string, at timestamp, id long")
    for name in ("_extra", "_chunk", "_run", "steps", "seconds"):
        df = df.withColumn(name, F.lit(1))
    out = runs.collapse_runs(df, ["a"], "step", "text", "sha", "at", ["id"], work, chunk=chunk)
    return sorted((r["a"] or "", r["first_step"], r["last_step"], r["steps"], r["seconds"]) for r in out.collect())


def event(k, step, text, sha="", n=0):
    import datetime as dt

    return (k, step, text, sha, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=step or 0), n)


def test_runs_cross_chunks_and_stop_at_gaps(spark, work):
    data = [event("a", s, "x = 1") for s in range(2, 13)] + [event("a", 14, "x = 1"), event("a", 15, "y = 2222")] + [event("a", 5, "x=1", n=9)]
    assert collapse(spark, work, data) == [("a", 2, 12, 11, 10.0), ("a", 14, 14, 1, 0.0), ("a", 15, 15, 1, 0.0)]


def test_near_means_three_edits_of_letters(spark, work):
    data = [event("a", 1, "abcdefgh"), event("a", 2, "A_b c-d:efXYZgh"), event("a", 3, "abcdefQRSTUVgh"), event(None, 1, "p"), event(None, 2, "P;")]
    got = collapse(spark, work, data)
    assert got == [("", 1, 2, 2, 1.0), ("a", 1, 2, 2, 1.0), ("a", 3, 3, 1, 0.0)]


def test_hashes_decide_where_a_text_is_missing(spark, work):
    data = [event("a", 1, None, "AB"), event("a", 2, "zzz", "ab"), event("a", 3, "other text", None), event("a", 4, None, "cd"), event("a", None, "x")]
    assert [x[1:3] for x in collapse(spark, work, data)] == [(1, 2), (3, 3), (4, 4)]
    assert collapse(spark, work, []) == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 30), st.sampled_from(["a", "b", "longer"])), max_size=40))
def test_runs_equal_one_scan(spark, steps):
    from evalspan.runtime import Workspace

    data = [event("k", s, t, n=i) for i, (s, t) in enumerate(steps)]
    first = {}
    for s, t in sorted(((s, i, t) for i, (s, t) in enumerate(steps)), key=lambda x: x[:2]) and [(s, t) for s, i, t in sorted((s, i, t) for i, (s, t) in enumerate(steps))]:
        first.setdefault(s, t)
    want, last = [], None
    for s in sorted(first):
        near = last is not None and s == last + 1 and (first[s] == first[last] or {first[s], first[last]} == {"a", "b"})
        if near:
            want[-1][1] = s
        else:
            want.append([s, s])
        last = s
    assert [list(x[1:3]) for x in collapse(spark, Workspace(spark, "scan"), data)] == want
