"""Selection of tasks and candidates: hash order, quotas, schedules, frequency reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import selection, views
from ..tables import table

SEED = "panel-1"
QUOTAS, PER_REPO = {True: 6, False: 6}, 2
KEYWORDS = ["graph", "query", "pack"]


def _tasks(spark: SparkSession, directory: str) -> DataFrame:
    t = views.tasks(spark, directory)
    return t.withColumn("repo", fn.repo_key(F.col("task"))).withColumn("digest", fn.seeded_digest(SEED, F.col("task")))


def hash_shuffle(spark: SparkSession, directory: str) -> DataFrame:
    """Order of the catalogue in place of a seeded shuffle."""
    return _tasks(spark, directory).select("task", "digest")


def hash_rank(spark: SparkSession, directory: str) -> DataFrame:
    """The first three tasks of each repository in hash order; the first two are for training."""
    top = selection.top_per_group(_tasks(spark, directory), ["repo"], ["digest", "task"], 3)
    return top.select("repo", "task", "rank", F.when(F.col("rank") <= 2, "train").otherwise("heldout").alias("part"))


def viable_groups(spark: SparkSession, directory: str) -> DataFrame:
    return selection.viable_groups(_tasks(spark, directory), "repo", 3, 8, SEED).select("repo", "rows")


def anchors_first(spark: SparkSession, directory: str) -> DataFrame:
    out = selection.anchors_first(_tasks(spark, directory).drop("digest"), "repo", "task", SEED, 28, least_groups=0)
    return out.select("repo", "task", F.col("anchor").cast("int").alias("anchor"), "place")


def quota_panel(spark: SparkSession, directory: str) -> DataFrame:
    """Greedy panel of candidates, as many solved as unsolved, with a cap per repository."""
    c = views.candidates(spark, directory).where("solved is not null").withColumn("repo", fn.repo_key(F.col("task")))
    c = selection.hash_order(c.withColumn("key", F.concat_ws("/", "task", F.col("sample").cast("string"))), SEED, "key")
    out = selection.quota_panel(c, "key", "repo", "solved", ["digest", "key"], QUOTAS, PER_REPO, strict=False)
    return out.select("key", "repo", F.col("solved").cast("int").alias("solved"))


def priority_limit(spark: SparkSession, directory: str) -> DataFrame:
    rows = views.tasks(spark, directory).select("task", selection.priority_order(F.col("task"), KEYWORDS).alias("priority"))
    return rows.orderBy("priority", "task").limit(20)


def casefold_order(spark: SparkSession, directory: str) -> DataFrame:
    """The first spelling of each source in an order that ignores letter case."""
    rows = table(spark, directory, "documents").where("source is not null").select("source").distinct()
    low = rows.select("source", F.lower(F.trim("source")).alias("folded"))
    return low.groupBy("folded").agg(F.min("source").alias("first_spelling"), F.count("*").alias("spellings"))


def control_rows(spark: SparkSession, directory: str) -> DataFrame:
    """Per task the candidate with the largest q, the smaller sample in a tie."""
    c = views.candidates(spark, directory).where("q is not null")
    return c.groupBy("task").agg(F.max_by("sample", F.struct("q", -F.col("sample"))).alias("sample"), F.max("q").alias("q"))


def schedule(spark: SparkSession, directory: str) -> DataFrame:
    """A frozen panel in hash order, cut into updates of four tasks."""
    w = Window.partitionBy(F.lit(1)).orderBy("digest", "task")
    panel = _tasks(spark, directory).select("task", "digest").orderBy("digest", "task").limit(40)
    return panel.withColumn("i", F.row_number().over(w) - 1).select("task", F.floor(F.col("i") / 4).cast("int").alias("update"), (F.col("i") % 4).alias("slot"))


def round_robin(spark: SparkSession, directory: str) -> DataFrame:
    panel = views.tasks(spark, directory).select("task").orderBy("task").limit(7)
    return selection.round_robin(panel, ["task"], 5, 4).select(F.col("update").cast("int"), F.col("slot").cast("int"), "task")


def frozen_prefix(spark: SparkSession, directory: str) -> DataFrame:
    """The first ten listed tasks: a prefix of a frozen list is the feature."""
    return views.tasks(spark, directory).orderBy("row_id").limit(10).select("row_id", "task")


def scan_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return views.tasks(spark, directory).select("row_id", "task")


def frequency(spark: SparkSession, directory: str) -> DataFrame:
    c = table(spark, directory, "candidates")
    return c.groupBy(F.lower(F.trim("model")).alias("model"), "q_origin").agg(F.count("*").alias("rows"))


def solved_rollup(spark: SparkSession, directory: str) -> DataFrame:
    """Candidates by outcome and in all; ``outcome`` is -1 for all and null for unknown."""
    c = views.candidates(spark, directory).withColumn("y", F.col("solved").cast("int"))
    out = c.rollup("y").agg(F.grouping_id().alias("g"), F.count("*").alias("rows"), F.count_distinct("task").alias("tasks"))
    return out.select(F.when(F.col("g") == 1, -1).otherwise(F.col("y")).alias("outcome"), "rows", "tasks")


def describe(spark: SparkSession, directory: str) -> DataFrame:
    """Count, least, median, mean and most of the generated tokens by outcome."""
    c = views.candidates(spark, directory).where("generated_tokens is not null")
    return c.groupBy(F.col("solved").cast("int").alias("outcome")).agg(
        F.count("*").alias("n"), F.min("generated_tokens").alias("least"), F.percentile("generated_tokens", F.lit(0.5)).alias("median"),
        F.round(F.avg("generated_tokens"), 6).alias("mean"), F.max("generated_tokens").alias("most"))


def conditional_rate(spark: SparkSession, directory: str) -> DataFrame:
    """Share of solved candidates among the valid ones; null for a model without any."""
    c = table(spark, directory, "candidates").withColumn("model", F.lower(F.trim("model")))
    valid = F.when(~F.col("invalid_body"), 1)
    hit = F.when(~F.col("invalid_body") & F.col("solved"), 1)
    return c.groupBy("model").agg(F.count(valid).alias("valid"), F.count(hit).alias("solved"), F.round(F.try_divide(F.count(hit), F.count(valid)), 9).alias("rate"))


def complete_groups(spark: SparkSession, directory: str) -> DataFrame:
    """Candidates whose replicates are exactly 0 to 3."""
    o = views.outcomes(spark, directory).groupBy("task", "sample").agg(
        F.count("*").alias("n"), F.count_distinct("replicate").alias("d"), F.min("replicate").alias("lo"), F.max("replicate").alias("hi"))
    return o.where("n = 4 and d = 4 and lo = 0 and hi = 3").select("task", "sample")


def completeness(spark: SparkSession, directory: str) -> DataFrame:
    """Expected and present rollouts and steps of the tasks."""
    s, o, c = views.states(spark, directory), views.outcomes(spark, directory), views.candidates(spark, directory)
    a = c.agg(F.count("*").alias("candidates"), (F.count("*") * views.REPLICATES).alias("expected_outcomes"))
    b = o.agg(F.count("*").alias("outcomes"))
    d = s.select("task", "sample", "replicate").distinct().agg(F.count("*").alias("rollouts"))
    e = s.agg(F.count("*").alias("states"))
    out = a
    for x in (b, d, e):  # each has one row
        out = out.join(x, F.lit(True))
    return out


def pass_at_one(spark: SparkSession, directory: str) -> DataFrame:
    """Share of solved candidates and of solved rollouts over the held-out tasks."""
    t = views.tasks(spark, directory).select("task", F.regexp_replace(F.lower("split"), "[^a-z]", "").alias("part"))
    c = views.candidates(spark, directory).join(t, "task").groupBy("part").agg(F.count("*").alias("candidates"), F.round(F.avg(F.col("solved").cast("double")), 9).alias("pass_at_1"))
    o = views.outcomes(spark, directory).join(t, "task").groupBy("part").agg(F.count("*").alias("rollouts"), F.round(F.avg(F.col("solved").cast("double")), 9).alias("solved_at_end"))
    o = o.withColumnRenamed("part", "_part")
    both = c.join(o, F.col("part").eqNullSafe(F.col("_part")), "full")
    return both.select(F.coalesce("part", "_part").alias("part"), "candidates", "pass_at_1", "rollouts", "solved_at_end")


def update_statistics(spark: SparkSession, directory: str) -> DataFrame:
    """Groups of candidates of one task: distinct rewards, whether any differ, solved and invalid ones."""
    c = views.candidates(spark, directory)
    per = c.groupBy("task").agg(F.count_distinct("p").alias("rewards"), F.sum(F.col("solved").cast("int")).alias("solved"),
                                F.sum(F.col("invalid_body").cast("int")).alias("invalid"), F.count("*").alias("n"))
    return per.select(F.substring_index("task", "__", 1).alias("owner"), "rewards", "solved", "invalid", "n").groupBy("owner").agg(
        F.count("*").alias("groups"), F.count(F.when(F.col("rewards") > 1, 1)).alias("informative"), F.sum("solved").alias("solved"),
        F.sum("invalid").alias("invalid"), F.sum("n").alias("rows"))


QUERIES = {
    "s6_hash_shuffle": hash_shuffle, "w7_hash_rank": hash_rank, "o3_viable_groups": viable_groups, "w9_anchors_first": anchors_first,
    "o1_quota_panel": quota_panel, "o5_priority_limit": priority_limit, "o6_casefold_order": casefold_order,
    "o7_control_rows": control_rows, "o8_schedule": schedule, "o10_round_robin": round_robin, "o9_frozen_prefix": frozen_prefix,
    "w15_scan_dedup": scan_dedup, "a1_frequency": frequency, "a2_solved_rollup": solved_rollup, "a3_describe": describe,
    "a4_conditional_rate": conditional_rate, "a8_complete_groups": complete_groups, "a18_completeness": completeness,
    "a24_pass_at_one": pass_at_one, "a23_update_statistics": update_statistics,
}

_T = f"""WITH RECURSIVE {views.SQL}, h AS (
  SELECT *, split_part(task, '.', 1) AS repo, sha256('{SEED}' || chr(0) || task) AS digest FROM t
)"""

ORACLE = {
    "s6_hash_shuffle": f"{_T} SELECT task, digest FROM h",
    "w7_hash_rank": f"""{_T}, r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY digest, task) AS rank FROM h)
SELECT repo, task, rank, CASE WHEN rank <= 2 THEN 'train' ELSE 'heldout' END AS part FROM r WHERE rank <= 3""",
    "o3_viable_groups": f"""{_T} SELECT repo, count(*) AS rows FROM h GROUP BY repo HAVING count(*) >= 3
ORDER BY sha256('{SEED}' || chr(0) || repo), repo LIMIT 8""",
    "w9_anchors_first": f"""{_T}, r AS (SELECT *, (row_number() OVER (PARTITION BY repo ORDER BY digest, task) = 1)::INT AS anchor FROM h)
SELECT repo, task, anchor, row_number() OVER (ORDER BY anchor DESC, digest, task) AS place FROM r QUALIFY place <= 28""",
    "o1_quota_panel": f"""{_T}, k AS (
  SELECT task || '/' || sample AS key, split_part(task, '.', 1) AS repo, solved FROM c WHERE solved IS NOT NULL
), f AS (SELECT *, row_number() OVER (ORDER BY sha256('{SEED}' || chr(0) || key), key) AS i FROM k),
walk AS (
  SELECT 0::BIGINT AS i, '' AS key, '' AS repo, FALSE AS solved, FALSE AS took, 0 AS yes, 0 AS no, MAP {{}}::MAP(VARCHAR, INT) AS used
  UNION ALL
  SELECT i, key, repo, solved, ok, yes + (ok AND solved)::INT, no + (ok AND NOT solved)::INT,
         CASE WHEN ok THEN map_concat(used, MAP {{repo: n + 1}}) ELSE used END
  FROM (SELECT f.*, w.yes, w.no, w.used, coalesce(w.used[f.repo], 0) AS n,
               coalesce(w.used[f.repo], 0) < {PER_REPO} AND CASE WHEN f.solved THEN w.yes < 6 ELSE w.no < 6 END AS ok
        FROM walk w JOIN f ON f.i = w.i + 1 WHERE w.yes < 6 OR w.no < 6)
) SELECT key, repo, solved::INT AS solved FROM walk WHERE took""",
    "o5_priority_limit": f"""{_T} SELECT task, CASE WHEN contains(task, 'graph') THEN 0 WHEN contains(task, 'query') THEN 1
  WHEN contains(task, 'pack') THEN 2 ELSE 3 END AS priority FROM t ORDER BY priority, task LIMIT 20""",
    "o6_casefold_order": "SELECT lower(trim(source)) AS folded, min(source) AS first_spelling, count(DISTINCT source) AS spellings FROM documents WHERE source IS NOT NULL GROUP BY 1",
    "o7_control_rows": f"{_T} SELECT task, sample, q FROM c WHERE q IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task ORDER BY q DESC, sample) = 1",
    "o8_schedule": f"""{_T}, k AS (SELECT task, row_number() OVER (ORDER BY digest, task) - 1 AS i FROM h QUALIFY i < 40)
SELECT task, (i // 4)::INT AS update, i % 4 AS slot FROM k""",
    "o10_round_robin": f"""{_T}, k AS (SELECT task, row_number() OVER (ORDER BY task) - 1 AS j FROM t QUALIFY j < 7)
SELECT (i // 4)::INT AS update, (i % 4)::INT AS slot, task FROM range(20) g(i) JOIN k ON j = i % 7""",
    "o9_frozen_prefix": f"{_T} SELECT row_id, task FROM t ORDER BY row_id LIMIT 10",
    "w15_scan_dedup": f"{_T} SELECT row_id, task FROM t",
    "a1_frequency": "SELECT lower(trim(model)) AS model, q_origin, count(*) AS rows FROM candidates GROUP BY ALL",
    "a2_solved_rollup": f"""{_T} SELECT CASE WHEN grouping(y) = 1 THEN -1 ELSE y END AS outcome, count(*) AS rows, count(DISTINCT task) AS tasks
FROM (SELECT *, solved::INT AS y FROM c) GROUP BY ROLLUP (y)""",
    "a3_describe": f"""{_T} SELECT solved::INT AS outcome, count(*) AS n, min(generated_tokens) AS least, quantile_cont(generated_tokens, 0.5) AS median,
  round(avg(generated_tokens), 6) AS mean, max(generated_tokens) AS most FROM c WHERE generated_tokens IS NOT NULL GROUP BY 1""",
    "a4_conditional_rate": """SELECT lower(trim(model)) AS model, count(*) FILTER (NOT invalid_body) AS valid, count(*) FILTER (NOT invalid_body AND solved) AS solved,
  round(count(*) FILTER (NOT invalid_body AND solved) / nullif(count(*) FILTER (NOT invalid_body), 0), 9) AS rate FROM candidates GROUP BY 1""",
    "a8_complete_groups": f"{_T} SELECT task, sample FROM o GROUP BY ALL HAVING count(*) = 4 AND count(DISTINCT replicate) = 4 AND min(replicate) = 0 AND max(replicate) = 3",
    "a18_completeness": f"""{_T} SELECT (SELECT count(*) FROM c) AS candidates, 4 * (SELECT count(*) FROM c) AS expected_outcomes, (SELECT count(*) FROM o) AS outcomes,
  (SELECT count(DISTINCT (task, sample, replicate)) FROM s) AS rollouts, (SELECT count(*) FROM s) AS states""",
    "a24_pass_at_one": f"""{_T}, p AS (SELECT task, regexp_replace(lower(split), '[^a-z]', '', 'g') AS part FROM t),
a AS (SELECT part, count(*) AS candidates, round(avg(solved::INT), 9) AS pass_at_1 FROM c JOIN p USING (task) GROUP BY part),
b AS (SELECT part, count(*) AS rollouts, round(avg(solved::INT), 9) AS solved_at_end FROM o JOIN p USING (task) GROUP BY part)
SELECT coalesce(a.part, b.part) AS part, candidates, pass_at_1, rollouts, solved_at_end FROM a FULL JOIN b ON a.part IS NOT DISTINCT FROM b.part""",
    "a23_update_statistics": f"""{_T}, g AS (SELECT task, count(DISTINCT p) AS rewards, sum(solved::INT) AS solved, sum(invalid_body::INT) AS invalid, count(*) AS n FROM c GROUP BY task)
SELECT split_part(task, '__', 1) AS owner, count(*) AS groups, count(*) FILTER (rewards > 1) AS informative, sum(solved) AS solved, sum(invalid) AS invalid,
  sum(n) AS rows FROM g GROUP BY 1""",
}
