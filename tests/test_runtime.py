import pytest
from pyspark.sql import functions as F

from evalspan.runtime import Workspace, shared_folder, skew_safe_join
from evalspan.tables import table


@pytest.mark.parametrize("floor", [0, 5, 1000])
def test_skew_safe_join_equals_a_join(spark, floor):
    edges = spark.createDataFrame([(0, i) for i in range(50)] + [(i % 7, i) for i in range(20)] + [(None, 1), (99, 2)], "k int, x int")
    values = edges.where("k <> 99").groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("m"))
    heavy = values.where(F.col("n") > floor).drop("n")
    got = skew_safe_join(edges, values.drop("n"), "k", heavy).collect()
    want = edges.join(values.drop("n"), "k").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(skew_safe_join(edges, values.drop("n"), "k", None).collect()) == len(want)


def test_a_name_may_be_written_again(spark):
    work = Workspace(spark, "again")
    one = work.write(spark.range(3).toDF("a"), "t")
    two = work.write(spark.range(5).toDF("a"), "t")
    assert (one.count(), two.count()) == (3, 5)
    work.drop("t")
    assert one.count() == 3
    assert work.write(spark.range(0).toDF("a"), "none").columns == ["a"]


def test_shared_folder_follows_the_setting(spark):
    assert shared_folder(spark) == (spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark)).rstrip("/")


def test_scans_read_the_needed_columns_only(spark, tmp_path, capsys):
    from evalspan.operators import views

    spark.sql(
        "select 'a' instance_id, 0 sample, 0 replicate, 2 step, 1L state_id, 'x' source, 'h' source_sha256, 'p' prior_source_sha256, 0.5D p_t, true solved, "
        "false invalid_body, false hit_token_cap, 1L generated_tokens, 'scored' public_status, 0.1D public_seconds, 'f' feedback_given, timestamp'2026-01-01' recorded_at"
    ).write.parquet(f"{tmp_path}/states.parquet")
    assert table(spark, str(tmp_path), "states").count() == 1
    views.states(spark, str(tmp_path)).where("step = 2").select("task", "p_t").explain("formatted")
    plan = capsys.readouterr().out
    read = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    assert "source:" not in read and "feedback" not in read and "p_t" in read
    assert "EqualTo(step,2)" in plan  # the filter reaches the scan through the window, since step is a key of it
