import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspan.config import RunConfig
from evalspan.operators import checks, joins, regression
from evalspan.plans import relations
from evalspan.sources import readers, writers
from evalspan.streaming import journal


def test_jsonl(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"a": 1, "b": "x"}\n\n{"a": null, "b": "y", "c": 3}\n')
    df, found = readers.read_jsonl(spark, str(f), "a long, b string")
    assert found and df.count() == 2
    empty, found = readers.read_jsonl(spark, str(tmp_path / "no.jsonl"), "a long")
    assert not found and empty.count() == 0
    f.write_text('{"a": 1}\n[1]\n{bad\n')
    with pytest.raises(Exception, match="a.jsonl:[23]"):
        readers.read_jsonl(spark, str(f), "a long")[0].collect()
    with pytest.raises(Exception):  # nothing is dropped without line numbers either
        readers.read_jsonl(spark, str(f), "a long", strict=False)[0].collect()
    lines = readers.numbered_lines(spark, str(f))
    assert [r["_line_number"] for r in readers.bad_lines(lines, "a long").orderBy("_line_number").collect()] == [2, 3]
    f.write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3')  # written in part
    with pytest.raises(Exception, match="a.jsonl:4"):
        readers.read_jsonl(spark, str(f), "a long")[0].collect()


def test_line_numbers_over_many_blocks(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("".join("\n" if i % 7 == 6 else f"{name}{i}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 2 * (3000 - 428) and all(r["value"][1:] == str(r["_line_number"] - 1) and r["_file"].endswith("/" + r["value"][0]) for r in rows)


def test_objects_csv_and_reports(spark, tmp_path):
    for n in "ab":
        (tmp_path / n).mkdir()
        (tmp_path / n / "summary.json").write_text(json.dumps({"n": n, "k": 1}, indent=1))
    got = readers.read_objects(spark, f"{tmp_path}/*/summary.json", "n string, k int")
    assert sorted(r["n"] for r in got.collect()) == ["a", "b"] and got.where("_file like '%summary.json'").count() == 2
    assert readers.read_object(spark, f"{tmp_path}/a/summary.json", "n string").first()["n"] == "a"
    (tmp_path / "t.csv").write_text("x,y\n1,a\n")
    assert readers.read_csv(spark, f"{tmp_path}/t.csv", "x int, y string").first()["x"] == 1
    (tmp_path / "r.xml").write_text('<testsuite><testcase name="a"/><testcase name="b"><failure>no</failure></testcase><testcase name="c"><error>bad</error></testcase></testsuite>')
    r = readers.report_verdict(readers.test_report(spark, f"{tmp_path}/r.xml"), 3).first()
    assert (r["collected"], r["valid"], r["nonpassing"]) == (3, True, 2)


def test_ranges(spark):
    got = [(r["start"], r["stop"]) for r in readers.byte_ranges(spark, 10, 4).orderBy("part").collect()]
    assert got == [(0, 4), (4, 8), (8, 10)] and readers.byte_ranges(spark, 0, 4).count() == 0


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 0.5)], "k int, a string, z double")
    writers.write_jsonl(df, f"{tmp_path}/j", ["k"])
    text = sorted(line for p in (tmp_path / "j").glob("part-*") for line in p.read_text().splitlines())
    assert text == ['{"a":"a","k":1,"z":null}', '{"a":"b","k":2,"z":0.5}']
    with pytest.raises(Exception):
        writers.write_jsonl(df, f"{tmp_path}/j")
    assert writers.export_public(df, ["k"], f"{tmp_path}/e", 2) == 2
    with pytest.raises(ValueError):
        writers.export_public(df, ["secret"], f"{tmp_path}/e2")
    with pytest.raises(ValueError):
        writers.export_public(df, ["k"], f"{tmp_path}/e3", 5)


def test_journal_is_idempotent(spark, tmp_path):
    path = f"{tmp_path}/log"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    writers.append_journal(df, path, ["k"], "b1")
    writers.append_journal(df.unionByName(spark.createDataFrame([(3, "c")], "k int, v string")), path, ["k"], "b2")
    writers.append_journal(df.unionByName(spark.createDataFrame([(3, "c")], "k int, v string")), path, ["k"], "b2")
    assert sorted(r["k"] for r in writers.read_journal(spark, path, ["k"]).collect()) == [1, 2, 3]


def test_manifest_finds_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    m = writers.manifest("p1", {"b": 1, "a": 2}, {"t": a})
    assert m["tables"]["t"]["rows"] == 2 and writers.check_manifest(m, {"t": a.repartition(3)}) == []
    changed = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert writers.check_manifest(m, {"t": changed}) == ["t"] and writers.check_manifest(m, {}) == ["t"]


def test_file_digests(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"abc")
    (r,) = writers.file_digests(spark, f"{tmp_path}/*.bin").collect()
    assert (r["length"], r["sha256"]) == (3, hashlib.sha256(b"abc").hexdigest())


def test_reports_in_a_column(spark):
    df = spark.createDataFrame([("<s><testcase name='a'/><testcase><failure/></testcase></s>",), (None,)], "x string")
    got = [r["r"] for r in df.select(readers.report_counts(F.col("x")).alias("r")).collect()]
    assert got[0]["collected"] == 2 and got[0]["failures"] == 1


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"tasks": 6}')
    assert RunConfig.load(str(p)).replicates == 4
    for bad in ('{"tasks": true}', '{"tasks": 0}', '{"task": 1}'):
        p.write_text(bad)
        with pytest.raises((ValueError, TypeError)):
            RunConfig.load(str(p))


def test_checks(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 1.5), (None, None)], "k string, p double")
    rules = {"named": F.col("k").isNotNull(), "share": F.col("p").between(0, 1)}
    assert {r["rule"]: r["broken"] for r in checks.violations(df, rules).collect()} == {"named": 1, "share": 2}
    assert sorted(len(r["broken"]) for r in checks.broken_rows(df, rules).collect()) == [1, 2]
    assert checks.violations(df.limit(0), rules).where("broken <> 0").isEmpty()
    assert [r["rows"] for r in checks.repeated_keys(df, ["k"]).collect()] == [2]
    assert checks.dependency_breaks(df, ["k"], "p").count() == 1
    with pytest.raises(ValueError):
        checks.require_empty(df, "not empty")
    with pytest.raises(ValueError):
        checks.forbid_columns(df, ["p", "q"])


def test_joins(spark):
    a = spark.createDataFrame([("x", None, 1), ("y", 1, 2)], "k string, t int, v int").withColumn("_in", F.lit(1))
    b = spark.createDataFrame([("x", None, 1), ("z", 1, 2)], "k string, t int, v int").withColumn("_in", F.lit(1))
    got = {r["k"]: r["verdict"] for r in joins.one_to_one(a, b, ["k", "t"], ["v"]).collect()}
    assert got == {"x": "equal", "y": "left_only", "z": "right_only"}
    with pytest.raises(ValueError):
        joins.checked_inner(a.select("k"), b.select("k", F.col("v").alias("w")), ["k"])
    exact = spark.createDataFrame([("o__r.1.a", 2, 7), ("o__r.2.b", 1, 8), ("p__q.1.c", 3, 9)], "task string, row_id int, n int")
    rows = spark.createDataFrame([("o__r.1.a",), ("o__r.9.z",), ("none",)], "task string")
    prof = F.substring_index("task", ".", 1)
    got = {r["task"]: (r["status"], r["n"]) for r in joins.with_fallback(rows, exact, "task", prof, prof, "row_id", ["n"]).collect()}
    assert got == {"o__r.1.a": ("exact", 7), "o__r.9.z": ("profile", 8), "none": ("none", None)}


def test_ridge_equals_a_direct_solution(spark):
    rng = np.random.default_rng(1)
    x, g = rng.normal(size=(90, 3)), rng.integers(0, 4, 90)
    x[:, 2] = 5.0
    y = x[:, 0] * 2 - x[:, 1] + rng.normal(size=90)
    df = spark.createDataFrame([(int(g[i]), *map(float, x[i]), float(y[i])) for i in range(90)], "g int, a double, b double, c double, y double")
    got = {r["g"]: r for r in regression.leave_one_group_out(df, "g", ["a", "b", "c"], "y").collect()}
    for k in range(4):
        t = g != k
        m, s = x[t].mean(0), x[t].std(0)
        z = (x[t] - m) / np.where(s > 0, s, 1)
        w = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y[t] - y[t].mean())) / np.where(s > 0, s, 1)
        assert np.allclose(got[k]["coefficients"], w, atol=1e-8) and np.isclose(got[k]["intercept"], y[t].mean() - w @ m)


def test_ridge_leaves_out_shared_sources_too(spark):
    rng = np.random.default_rng(2)
    x, g = rng.normal(size=(90, 2)), rng.integers(0, 5, 90)
    task, sha = rng.integers(0, 2, 90), rng.integers(0, 20, 90)
    y = x[:, 0] - x[:, 1] + sha * 0.3
    rows = [(int(g[i]), int(task[i]), f"s{sha[i]}" if sha[i] else None, *map(float, x[i]), float(y[i])) for i in range(90)]
    df = spark.createDataFrame(rows, "g int, task int, sha string, a double, b double, y double")
    folds = regression.leave_one_group_out(df, "g", ["a", "b"], "y", source=["task", "sha"])
    got = {r["g"]: r for r in folds.collect()}
    scores = {}
    for k in range(5):
        held = {r[1:3] for r in rows if r[0] == k and r[2]}
        t = np.array([r[0] != k and r[1:3] not in held for r in rows])
        assert t.sum() < (g != k).sum()
        m, s = x[t].mean(0), x[t].std(0)
        z = (x[t] - m) / s
        w = np.linalg.solve(z.T @ z + 10 * np.eye(2), z.T @ (y[t] - y[t].mean())) / s
        assert np.allclose(got[k]["coefficients"], w, atol=1e-8)
        scores[k] = lambda v, w=w, c=y[t].mean() - w @ m: v @ w + c
    for r in regression.held_out_predictions(df, folds, "g", ["a", "b"]).collect():
        assert np.isclose(r["prediction"], scores[r["g"]](np.array([r["a"], r["b"]])))


def test_stream_of_complete_blocks(spark, tmp_path):
    schema = "task string, sample int, replicate int, step int"
    src = f"{tmp_path}/in"
    spark.createDataFrame([("a", 0, 0, 0), ("a", 0, 0, 1), ("b", 0, 0, 0)], schema).coalesce(1).write.mode("append").parquet(src)
    seen = []
    take = lambda df, n: seen.append(sorted((r["task"], r["step"]) for r in df.collect()))

    def run():
        s = journal.read_stream(spark, src, schema)
        journal.process_complete(s, f"{tmp_path}/kept", ["task", "sample", "replicate"], "step", 2, take, f"{tmp_path}/cp").awaitTermination()

    run()
    spark.createDataFrame([("b", 0, 0, 1)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert seen == [[("a", 0), ("a", 1)], [("b", 0), ("b", 1)]]


def test_stream_progress_and_windows(spark, tmp_path):
    schema = "task string, sample int, replicate int, step int"
    src = f"{tmp_path}/in"
    spark.createDataFrame([("a", 0, 0, s) for s in (4, 2, 2)] + [("b", 0, 0, s) for s in (2, 3, 4)], schema).coalesce(1).write.parquet(src)
    out = journal.run_to_end(journal.progress(journal.read_stream(spark, src, schema), 2, 4), "progress", f"{tmp_path}/cp", "update")
    assert {(r["task"], r["next_step"], r["status"]) for r in out.collect()} == {("a", 3, "gap"), ("b", 5, "complete")}
    ev = f"{tmp_path}/ev"
    spark.sql("select timestamp'2026-01-01 00:00:10' + make_interval(0,0,0,0,0,id) as ts, 'x' as event_type, double(id) as value from range(0, 30, 10)").write.parquet(ev)
    s = journal.read_stream(spark, ev, spark.read.parquet(ev).schema)
    got = journal.run_to_end(journal.windowed_counts(s, "ts", "event_type", "20 minutes", "1 hour"), "win", f"{tmp_path}/cp2", "complete")
    assert sum(r["events"] for r in got.collect()) == 3


def test_pending(spark):
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    assert [r["k"] for r in journal.pending(a, a.limit(1), ["k"]).collect()] == ["y"]


def test_an_outcome_without_states_raises(spark, monkeypatch):
    keys = "task string, sample int, replicate int"
    states = spark.createDataFrame([("a", 0, 0, 2), ("a", 0, 0, 3), ("a", 0, 1, 2)], f"{keys}, step int")
    outcomes = spark.createDataFrame([("a", 0, 0, 0.5), ("b", 0, 0, 0.5)], f"{keys}, p8 double")
    monkeypatch.setattr(relations.views, "states", lambda *_: states)
    monkeypatch.setattr(relations.views, "outcomes", lambda *_: outcomes.where("task = 'a'"))
    assert [tuple(r) for r in relations.checked_inner(spark, "").collect()] == [("a", 0, 0, 3, 0.5)]
    monkeypatch.setattr(relations.views, "outcomes", lambda *_: outcomes)
    with pytest.raises(ValueError, match="without a partner"):
        relations.checked_inner(spark, "")
