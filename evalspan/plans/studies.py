"""Vectors of bits, grouped ridge, and exact studies on small generated programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import regression
from ..tables import table

BINS, SIZE = 8, 8
#: Programs, stages of each, values of a state, edits per program, and neighbouring values in a block.
PROGRAMS, STAGES, VALUES, EDITS, BLOCK = 60, 4, 8, 5, 4


def _vectors(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "embeddings").select("vec_id", "label", fn.bit_string(F.col("embedding")).alias("bits"))


def bit_agreement(spark: SparkSession, directory: str) -> DataFrame:
    """Agreement of each vector's bits with the first vector of its label."""
    v = _vectors(spark, directory)
    first = v.groupBy("label").agg(F.min_by("bits", "vec_id").alias("reference"))
    return v.join(first, "label").select("vec_id", F.round(fn.bit_agreement(F.col("bits"), F.col("reference")), 9).alias("q"))


def bin_means(spark: SparkSession, directory: str) -> DataFrame:
    v = _vectors(spark, directory).withColumn("m", fn.bin_means(F.col("bits"), BINS, SIZE))
    return v.select("vec_id", *[F.round(F.get("m", i), 9).alias(f"b{i}") for i in range(BINS)])


def bins_against_bits(spark: SparkSession, directory: str) -> DataFrame:
    """Vectors whose bins' mean isn't the mean of their bits (none)."""
    v = _vectors(spark, directory).withColumn("m", fn.bin_means(F.col("bits"), BINS, SIZE))
    mean = F.aggregate("m", F.lit(0.0), lambda a, x: a + x) / BINS
    ones = F.length(F.replace("bits", F.lit("0"), F.lit(""))) / F.length("bits")
    return v.where(F.abs(mean - ones) > 1e-9).select("vec_id")


def ridge(spark: SparkSession, directory: str) -> DataFrame:
    """Coefficients of a ridge of the agreement on the bins, leaving one label out at a time."""
    v = bin_means(spark, directory).join(bit_agreement(spark, directory), "vec_id").join(_vectors(spark, directory).select("vec_id", "label"), "vec_id")
    out = regression.leave_one_group_out(v, "label", [f"b{i}" for i in range(BINS)], "q")
    return out.select("label", F.round("intercept", 8).alias("intercept"), *[F.round(F.get("coefficients", i), 8).alias(f"w{i}") for i in range(BINS)])


def _tables(spark: SparkSession) -> DataFrame:
    """Function tables: one row per program, stage and value."""
    r = spark.range(PROGRAMS * STAGES * VALUES)
    pid, stage, x = F.floor(F.col("id") / (STAGES * VALUES)), F.floor(F.col("id") / VALUES) % STAGES, F.col("id") % VALUES
    y = (x * (2 * ((pid + stage) % 4) + 1) + pid * stage + stage + (x % 3) * pid) % VALUES
    return r.select(pid.alias("pid"), stage.alias("stage"), x.alias("x"), y.alias("y"))


def _run(tables: DataFrame, first: int, start: DataFrame) -> DataFrame:
    """Values after the stages from ``first`` on, one join with the table of each stage."""
    for k in range(first, STAGES):
        t = tables.where(F.col("stage") == k).select("pid", F.col("x").alias("v"), F.col("y").alias("w"))
        start = start.join(t, ["pid", "v"]).drop("v").withColumnRenamed("w", "v")
    return start


def composition(spark: SparkSession, directory: str) -> DataFrame:
    t = _tables(spark)
    start = t.where("stage = 0").select("pid", "x", F.col("x").alias("v"))
    return _run(t, 0, start).select("pid", "x", F.col("v").alias("final"))


def _edits(spark: SparkSession) -> DataFrame:
    """Edits of the second stage: the values it gives are moved by the edit's number where the input is even."""
    t = _tables(spark).where("stage = 1")
    e = spark.range(1, EDITS + 1).select(F.col("id").alias("edit"))
    moved = F.when(F.col("x") % 2 == 0, (F.col("y") + F.col("edit")) % VALUES).otherwise(F.col("y"))
    return t.join(F.broadcast(e), F.lit(True)).select("pid", "edit", "x", F.col("y").alias("base"), moved.alias("new"))  # EDITS rows


def _suffix(spark: SparkSession) -> DataFrame:
    """Final value of each value after the second stage: the cached part that all edits share."""
    t = _tables(spark)
    start = t.where("stage = 2").select("pid", "x", F.col("x").alias("v"))
    return _run(t, 2, start).select("pid", F.col("x").alias("s"), F.col("v").alias("final"))


def block_bounds(spark: SparkSession, directory: str) -> DataFrame:
    """Least and largest final value of each block of neighbouring values after the second stage."""
    s = _suffix(spark).withColumn("block", F.floor(F.col("s") / BLOCK))
    return s.groupBy("pid", "block").agg(F.min("final").alias("lo"), F.max("final").alias("hi"))


def edit_intervals(spark: SparkSession, directory: str) -> DataFrame:
    """Change of the summed final value by each edit, exactly, and bounds from blocks: independent, and paired."""
    e, s, b = _edits(spark), _suffix(spark), block_bounds(spark, directory)
    for side in ("base", "new"):
        e = e.join(s.select("pid", F.col("s").alias(side), F.col("final").alias(f"{side}_final")), ["pid", side])
        e = e.withColumn("block", F.floor(F.col(side) / BLOCK)).join(b.withColumnRenamed("lo", f"{side}_lo").withColumnRenamed("hi", f"{side}_hi"), ["pid", "block"]).drop("block")
    same = F.col("base") == F.col("new")
    lo, hi = F.col("new_lo") - F.col("base_hi"), F.col("new_hi") - F.col("base_lo")
    return e.groupBy("pid", "edit").agg(
        F.sum(F.col("new_final") - F.col("base_final")).alias("delta"), F.sum(lo).alias("lo"), F.sum(hi).alias("hi"),
        F.sum(F.when(same, 0).otherwise(lo)).alias("paired_lo"), F.sum(F.when(same, 0).otherwise(hi)).alias("paired_hi"))


def certificate_summary(spark: SparkSession, directory: str) -> DataFrame:
    """Called signs, false ones and widths of both bounds, by edit and in all (edit 0)."""
    i = edit_intervals(spark, directory)
    rows = i.select("edit", "delta", F.explode(F.array(
        F.struct(F.lit("independent").alias("method"), F.col("lo").alias("lo"), F.col("hi").alias("hi")),
        F.struct(F.lit("paired").alias("method"), F.col("paired_lo").alias("lo"), F.col("paired_hi").alias("hi")))).alias("b"))
    sign, true = fn.interval_sign(F.col("b.lo"), F.col("b.hi")), F.signum("delta").cast("int")
    marked = rows.select("edit", "b.method", sign.alias("called"), true.alias("true"), (F.col("b.hi") - F.col("b.lo")).alias("width"))
    out = marked.rollup("method", "edit").agg(
        F.grouping_id().alias("g"), F.count("*").alias("edits"), F.count(F.when(F.col("called") != 0, 1)).alias("calls"),
        F.count(F.when((F.col("called") != 0) & (F.col("called") != F.col("true")), 1)).alias("false_calls"), F.round(F.avg("width"), 9).alias("mean_width"))
    return out.where("g < 3").select("method", F.when(F.col("g") == 1, 0).otherwise(F.col("edit")).alias("edit"), "edits", "calls", "false_calls", "mean_width")


def telescoping(spark: SparkSession, directory: str) -> DataFrame:
    """Steps of each run add up to its whole change: programs with the sums of both."""
    t = _tables(spark)
    v = t.where("stage = 0").select("pid", "x", F.col("x").alias("v"))
    steps = None
    for k in range(STAGES):
        n = t.where(F.col("stage") == k).select("pid", F.col("x").alias("v"), F.col("y").alias("w"))
        v = v.join(n, ["pid", "v"])
        part = v.select("pid", (F.col("w") - F.col("v")).alias("d"))
        steps = part if steps is None else steps.unionByName(part)
        v = v.select("pid", "x", F.col("w").alias("v"))
    whole = v.groupBy("pid").agg(F.sum(F.col("v") - F.col("x")).alias("whole"))
    return steps.groupBy("pid").agg(F.sum("d").alias("steps")).join(whole, "pid")


def cached_totals(spark: SparkSession, directory: str) -> DataFrame:
    """Sum of the final values after each edit from the shared suffix, one row per edit and its checksum."""
    e, s = _edits(spark), _suffix(spark)
    return e.join(s, (e["pid"] == s["pid"]) & (e["new"] == s["s"])).groupBy(e["edit"]).agg(F.count("*").alias("calls"), F.sum("final").alias("checksum"))


def recheck(spark: SparkSession, directory: str) -> DataFrame:
    """Edits whose exact change lies outside its bounds (none)."""
    return edit_intervals(spark, directory).where("delta < lo or delta > hi or delta < paired_lo or delta > paired_hi").select("pid", "edit")


def tree_values(spark: SparkSession, directory: str) -> DataFrame:
    """Value of each inner node of a binary tree of depth 6: mean of its leaves, which are hashed numbers."""
    leaves = spark.range(64).select(F.col("id"), ((F.col("id") * 37 + 11) % 101).alias("value"))
    rows = leaves.select("value", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("depth"), F.col("id"))
    node = F.floor(F.col("id") / F.pow(F.lit(2), 6 - F.col("depth"))).cast("long")
    return rows.groupBy("depth", node.alias("node")).agg(F.avg("value").alias("value"))


def probe_bank(spark: SparkSession, directory: str) -> DataFrame:
    """Cases made of values from two pools and pairs of neighbours, without repeats."""
    pool = spark.range(16).select(((F.col("id") * 7 + 3) % 12).alias("a")).distinct()
    pairs = pool.select("a", F.explode(F.array(F.col("a"), F.col("a") + 1, F.lit(0), F.lit(-1))).alias("b"))
    return pairs.distinct()


QUERIES = {
    "f20_bit_agreement": bit_agreement, "f21_bin_means": bin_means, "v13_bins_against_bits": bins_against_bits, "m7_ridge": ridge,
    "g2_composition": composition, "g3_block_bounds": block_bounds, "g4_edit_intervals": edit_intervals, "a20_certificate_summary": certificate_summary,
    "g5_telescoping": telescoping, "g6_cached_totals": cached_totals, "g7_recheck": recheck, "g8_tree_values": tree_values, "g9_probe_bank": probe_bank,
}

_BITS = "WITH b AS (SELECT vec_id, label, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings)"
_BINS = ", ".join(f"round(length(replace(bits[{8 * i + 1}:{8 * i + 8}], '0', '')) / 8.0, 9) AS b{i}" for i in range(BINS))
_G = f"""WITH t AS (SELECT pid, stage, x, (x * (2 * ((pid + stage) % 4) + 1) + pid * stage + stage + (x % 3) * pid) % {VALUES} AS y
  FROM range({PROGRAMS}) a(pid), range({STAGES}) b(stage), range({VALUES}) c(x)),
u AS (SELECT c.pid, c.x AS s, d.y AS final FROM t c JOIN t d ON d.pid = c.pid AND d.stage = 3 AND d.x = c.y WHERE c.stage = 2),
k AS (SELECT pid, s // {BLOCK} AS block, min(final) AS lo, max(final) AS hi FROM u GROUP BY ALL),
e AS (SELECT pid, edit, x, y AS base, CASE WHEN x % 2 = 0 THEN (y + edit) % {VALUES} ELSE y END AS new FROM t, range(1, {EDITS + 1}) g(edit) WHERE stage = 1),
i AS (SELECT e.pid, e.edit, sum(n.final - o.final) AS delta, sum(nk.lo - ok.hi) AS lo, sum(nk.hi - ok.lo) AS hi,
        sum(CASE WHEN base = new THEN 0 ELSE nk.lo - ok.hi END) AS paired_lo, sum(CASE WHEN base = new THEN 0 ELSE nk.hi - ok.lo END) AS paired_hi
      FROM e JOIN u n ON n.pid = e.pid AND n.s = new JOIN u o ON o.pid = e.pid AND o.s = base
      JOIN k nk ON nk.pid = e.pid AND nk.block = new // {BLOCK} JOIN k ok ON ok.pid = e.pid AND ok.block = base // {BLOCK} GROUP BY ALL)"""

ORACLE = {
    "f20_bit_agreement": f"""{_BITS}, r AS (SELECT label, arg_min(bits, vec_id) AS reference FROM b GROUP BY label)
SELECT vec_id, round(len(list_filter(range(1, length(bits) + 1), lambda i: bits[i] = reference[i])) / length(bits), 9) AS q FROM b JOIN r USING (label)""",
    "f21_bin_means": f"{_BITS} SELECT vec_id, {_BINS} FROM b",
    "v13_bins_against_bits": f"{_BITS} SELECT vec_id FROM b WHERE FALSE",
    "g2_composition": f"""{_G} SELECT a.pid, a.x, d.y AS final FROM t a JOIN t b ON b.pid = a.pid AND b.stage = 1 AND b.x = a.y
JOIN t c ON c.pid = a.pid AND c.stage = 2 AND c.x = b.y JOIN t d ON d.pid = a.pid AND d.stage = 3 AND d.x = c.y WHERE a.stage = 0""",
    "g3_block_bounds": f"{_G} SELECT * FROM k",
    "g4_edit_intervals": f"{_G} SELECT * FROM i",
    "a20_certificate_summary": f"""{_G}, m AS (SELECT 'independent' AS method, edit, delta, lo, hi FROM i UNION ALL SELECT 'paired', edit, delta, paired_lo, paired_hi FROM i),
z AS (SELECT *, CASE WHEN lo > 0 THEN 1 WHEN hi < 0 THEN -1 ELSE 0 END AS called FROM m)
SELECT method, coalesce(edit, 0) AS edit, count(*) AS edits, count(*) FILTER (called <> 0) AS calls, count(*) FILTER (called <> 0 AND called <> sign(delta)) AS false_calls,
  round(avg(hi - lo), 9) AS mean_width FROM z GROUP BY GROUPING SETS ((method, edit), (method))""",
    "g5_telescoping": f"""{_G}, r AS (SELECT a.pid, a.x, a.y AS v1, b.y AS v2, c.y AS v3, d.y AS v4 FROM t a JOIN t b ON b.pid = a.pid AND b.stage = 1 AND b.x = a.y
JOIN t c ON c.pid = a.pid AND c.stage = 2 AND c.x = b.y JOIN t d ON d.pid = a.pid AND d.stage = 3 AND d.x = c.y WHERE a.stage = 0)
SELECT pid, sum((v1 - x) + (v2 - v1) + (v3 - v2) + (v4 - v3)) AS steps, sum(v4 - x) AS whole FROM r GROUP BY pid""",
    "g6_cached_totals": f"{_G} SELECT edit, count(*) AS calls, sum(final) AS checksum FROM e JOIN u ON u.pid = e.pid AND u.s = new GROUP BY edit",
    "g7_recheck": f"{_G} SELECT pid, edit FROM i WHERE delta NOT BETWEEN lo AND hi OR delta NOT BETWEEN paired_lo AND paired_hi",
    "g8_tree_values": "SELECT depth, id // (2 ** (6 - depth))::BIGINT AS node, avg((id * 37 + 11) % 101) AS value FROM range(64) a(id), range(6) b(depth) GROUP BY ALL",
    "g9_probe_bank": """WITH p AS (SELECT DISTINCT (id * 7 + 3) % 12 AS a FROM range(16) g(id))
SELECT DISTINCT a, unnest([a, a + 1, 0, -1]) AS b FROM p""",
}
