"""Joins, set operations and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import checks, joins, views
from ..tables import table

KEYS = ["task", "sample", "replicate"]


def profile_fallback(spark: SparkSession, directory: str) -> DataFrame:
    """Tasks with candidates bound to the catalogue: exactly, or by the first listed task of their repository."""
    rows = views.candidates(spark, directory).select("task").distinct()
    t = views.tasks(spark, directory)
    return joins.with_fallback(rows, t, "task", fn.repo_key(F.col("task")), fn.repo_key(F.col("task")), "row_id", ["f2p_count"])


def checked_inner(spark: SparkSession, directory: str) -> DataFrame:
    """Outcomes with their rollout's last step; raises if an outcome has no states. Rollouts without outcome aren't
    asked for here: ``j13_pending`` and ``j5_one_to_one`` show them."""
    last = views.states(spark, directory).groupBy(*KEYS).agg(F.max("step").alias("last_step"))
    return joins.checked_inner(views.outcomes(spark, directory).select(*KEYS, "p8"), last, KEYS).select(*KEYS, "last_step", "p8")


def one_to_one(spark: SparkSession, directory: str) -> DataFrame:
    """Outcomes against last states, by verdict."""
    last = views.states(spark, directory).where("step = 8").select(*KEYS, "solved", F.lit(1).alias("_in"))
    ends = views.outcomes(spark, directory).select(*KEYS, "solved", F.lit(1).alias("_in"))
    return joins.one_to_one(ends, last, KEYS, ["solved"]).groupBy("verdict").agg(F.count("*").alias("rows"))


def aligned(spark: SparkSession, directory: str) -> DataFrame:
    """Candidates whose first state repeats their source, and whether p and the outcome agree with it."""
    s = views.states(spark, directory).where("step = 2").select("task", "sample", "replicate", F.col("sha").alias("s_sha"), "p_t", F.col("solved").alias("s_solved"))
    c = views.candidates(spark, directory).where("sha is not null")
    return c.join(s, ["task", "sample"]).select("task", "sample", "replicate", (F.col("sha") == F.col("s_sha")).cast("int").alias("same_source"),
                                               (F.abs(F.col("p") - F.col("p_t")) <= 1e-12).cast("int").alias("same_p"), (F.col("solved") == F.col("s_solved")).cast("int").alias("same_outcome"))


def reuse(spark: SparkSession, directory: str) -> DataFrame:
    """p of a step by its source: measured at the same source of the task's candidates, else its own."""
    known = views.candidates(spark, directory).where("sha is not null and q is not null").groupBy("task", "sha").agg(F.min("q").alias("q"))
    s = views.states(spark, directory).where("step = 2")
    return s.join(known, ["task", "sha"], "left").select(*KEYS, F.coalesce("q", "p_t").alias("value"), F.when(F.col("q").isNotNull(), "reused").otherwise("own").alias("origin"))


def residual_panel(spark: SparkSession, directory: str) -> DataFrame:
    """Second steps that are unsolved and valid, of unsolved candidates with q, with their outcome and later hits."""
    s = views.states(spark, directory)
    later = s.where("step >= 3").groupBy(*KEYS).agg(F.bool_or("solved").cast("int").alias("future_hit"))
    c = views.candidates(spark, directory).where("not solved and q is not null").select("task", "sample", "q")
    two = s.where("step = 2 and not solved and not invalid_body")
    return two.join(c, ["task", "sample"]).join(views.outcomes(spark, directory).select(*KEYS, "p8"), KEYS).join(later, KEYS, "left").select(
        *KEYS, "p_t", "q", "p8", F.coalesce("future_hit", F.lit(0)).alias("future_hit"))


def semi_join(spark: SparkSession, directory: str) -> DataFrame:
    """Catalogued tasks that have candidates."""
    return views.tasks(spark, directory).join(views.candidates(spark, directory).select("task"), "task", "left_semi").select("row_id", "task")


def pending(spark: SparkSession, directory: str) -> DataFrame:
    """Rollouts with states whose outcome is still to come."""
    return views.states(spark, directory).select(*KEYS).distinct().join(views.outcomes(spark, directory), KEYS, "left_anti")


def orphans(spark: SparkSession, directory: str) -> DataFrame:
    return checks.orphans(views.outcomes(spark, directory), views.candidates(spark, directory), ["task", "sample"]).select(*KEYS)


def set_operations(spark: SparkSession, directory: str) -> DataFrame:
    """Sizes of the intersection, differences and union of the tasks in two tables."""
    a, b = views.tasks(spark, directory).select("task"), views.candidates(spark, directory).select("task").distinct()
    parts = {"intersect": a.intersect(b), "only_catalogue": a.exceptAll(b), "only_candidates": b.exceptAll(a), "union": a.union(b).distinct()}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("tasks")).select(F.lit(name).alias("operation"), "tasks")
        out = row if out is None else out.unionByName(row)
    return out


def ordered_union(spark: SparkSession, directory: str) -> DataFrame:
    """Candidates as step 1 before the states of each rollout."""
    s = views.states(spark, directory).select(*KEYS, "step", F.col("p_t").alias("p"))
    c = views.candidates(spark, directory).select("task", "sample", "p").join(s.select(*KEYS).distinct(), ["task", "sample"])
    return s.unionByName(c.select(*KEYS, F.lit(1).alias("step"), "p"))


def disjointness(spark: SparkSession, directory: str) -> DataFrame:
    """Tasks listed in both splits, in whatever spelling."""
    t = table(spark, directory, "candidate_index").select(F.lower(F.trim("instance_id")).alias("task"), F.regexp_replace(F.lower("split"), "[^a-z]", "").alias("part"))
    return t.groupBy("task").agg(F.count_distinct("part").alias("parts")).where("parts > 1").select("task", F.col("parts").cast("long").alias("parts"))


def repeated_keys(spark: SparkSession, directory: str) -> DataFrame:
    c = table(spark, directory, "candidates").select(F.lower(F.trim("instance_id")).alias("task"), "sample")
    return checks.repeated_keys(c, ["task", "sample"])


def row_rules(spark: SparkSession, directory: str) -> DataFrame:
    """Broken rules of the raw candidates in one pass."""
    c = table(spark, directory, "candidates")
    return checks.violations(c, {
        "named": F.col("instance_id").isNotNull() & (F.trim("instance_id") != ""),
        "sample_not_negative": F.col("sample") >= 0, "p_is_share": F.col("p").between(0, 1),
        "q_is_share_or_unknown": F.col("q").isNull() | F.col("q").between(0, 1),
        "valid_means_q": F.col("proxy_valid") == F.col("q").isNotNull(),
        "hash_is_hex": F.col("source_sha256").rlike("^[0-9a-fA-F]{64}$"),
        "tokens_positive": F.col("generated_tokens") >= 0,
    })


def hash_breaks(spark: SparkSession, directory: str) -> DataFrame:
    """States whose hash isn't that of their source, where both are known."""
    s = table(spark, directory, "states").where("source is not null and source_sha256 is not null")
    return s.where(F.sha2(F.col("source").cast("binary"), 256) != F.lower("source_sha256")).select("state_id")


def dependency_breaks(spark: SparkSession, directory: str) -> DataFrame:
    """Sources of one task with more than one q."""
    c = views.candidates(spark, directory).where("sha is not null")
    return checks.dependency_breaks(c, ["task", "sha"], "q").select("task", "sha", F.col("least"), F.col("most"))


def formula_replay(spark: SparkSession, directory: str) -> DataFrame:
    """Rewards computed twice in two ways: rows that differ by more than 1e-8 (none)."""
    c = views.candidates(spark, directory).where("p is not null and solved is not null")
    c = c.withColumn("reward", fn.terminal_reward(F.col("solved"), F.col("p")))
    again = F.when(F.col("solved"), 1.0).otherwise(0.0) + F.col("p") / 2
    return c.where(F.abs(F.col("reward") - again) > 1e-8).select("task", "sample")


QUERIES = {
    "j1_profile_fallback": profile_fallback, "j2_checked_inner": checked_inner, "j5_one_to_one": one_to_one, "j6_aligned": aligned,
    "j7_reuse": reuse, "j8_residual_panel": residual_panel, "j12_semi_join": semi_join, "j13_pending": pending, "j4_orphans": orphans,
    "u1_set_operations": set_operations, "u3_ordered_union": ordered_union, "u5_disjointness": disjointness, "v2_repeated_keys": repeated_keys,
    "v1_row_rules": row_rules, "v5_hash_breaks": hash_breaks, "v7_dependency_breaks": dependency_breaks, "v9_formula_replay": formula_replay,
}

_V = f"WITH {views.SQL}"
_RULES = {
    "named": "trim(instance_id) <> ''", "sample_not_negative": "sample >= 0", "p_is_share": "p BETWEEN 0 AND 1",
    "q_is_share_or_unknown": "q IS NULL OR q BETWEEN 0 AND 1", "valid_means_q": "proxy_valid = (q IS NOT NULL)",
    "hash_is_hex": "regexp_full_match(source_sha256, '[0-9a-fA-F]{64}')", "tokens_positive": "generated_tokens >= 0",
}

ORACLE = {
    "j1_profile_fallback": f"""{_V}, k AS (SELECT DISTINCT task FROM c), f AS (
  SELECT split_part(task, '.', 1) AS repo, task, f2p_count FROM t QUALIFY row_number() OVER (PARTITION BY split_part(task, '.', 1) ORDER BY row_id) = 1)
SELECT k.task, CASE WHEN t.task IS NOT NULL THEN 'exact' WHEN f.task IS NOT NULL THEN 'profile' ELSE 'none' END AS status,
  coalesce(t.task, f.task) AS bound_to, CASE WHEN t.task IS NOT NULL THEN t.f2p_count ELSE f.f2p_count END AS f2p_count
FROM k LEFT JOIN t ON t.task = k.task LEFT JOIN f ON f.repo = split_part(k.task, '.', 1)""",
    "j2_checked_inner": f"{_V} SELECT task, sample, replicate, max(step) AS last_step, any_value(p8) AS p8 FROM s JOIN o USING (task, sample, replicate) GROUP BY ALL",
    "j5_one_to_one": f"""{_V} SELECT CASE WHEN b.task IS NULL THEN 'left_only' WHEN o.task IS NULL THEN 'right_only' WHEN o.solved IS NOT DISTINCT FROM b.solved
  THEN 'equal' ELSE 'differs' END AS verdict, count(*) AS rows
FROM o FULL JOIN (SELECT * FROM s WHERE step = 8) b ON o.task = b.task AND o.sample = b.sample AND o.replicate = b.replicate GROUP BY 1""",
    "j6_aligned": f"""{_V} SELECT c.task, c.sample, replicate, (c.sha = s.sha)::INT AS same_source, (abs(p - p_t) <= 1e-12)::INT AS same_p,
  (c.solved = s.solved)::INT AS same_outcome FROM c JOIN s ON c.task = s.task AND c.sample = s.sample WHERE step = 2 AND c.sha IS NOT NULL""",
    "j7_reuse": f"""{_V}, k AS (SELECT task, sha, min(q) AS q FROM c WHERE sha IS NOT NULL AND q IS NOT NULL GROUP BY ALL)
SELECT s.task, sample, replicate, coalesce(q, p_t) AS value, CASE WHEN q IS NOT NULL THEN 'reused' ELSE 'own' END AS origin
FROM s LEFT JOIN k ON k.task = s.task AND k.sha = s.sha WHERE step = 2""",
    "j8_residual_panel": f"""{_V}, l AS (SELECT task, sample, replicate, bool_or(solved)::INT AS y FROM s WHERE step >= 3 GROUP BY ALL)
SELECT s.task, s.sample, s.replicate, p_t, c.q, o.p8, coalesce(y, 0) AS future_hit FROM s JOIN c ON c.task = s.task AND c.sample = s.sample
JOIN o ON o.task = s.task AND o.sample = s.sample AND o.replicate = s.replicate LEFT JOIN l ON l.task = s.task AND l.sample = s.sample AND l.replicate = s.replicate
WHERE step = 2 AND NOT s.solved AND NOT s.invalid_body AND NOT c.solved AND c.q IS NOT NULL""",
    "j12_semi_join": f"{_V} SELECT row_id, task FROM t WHERE task IN (SELECT task FROM c)",
    "j13_pending": f"{_V} SELECT DISTINCT task, sample, replicate FROM s ANTI JOIN o USING (task, sample, replicate)",
    "j4_orphans": f"{_V} SELECT task, sample, replicate FROM o ANTI JOIN c USING (task, sample)",
    "u1_set_operations": f"""{_V}, a AS (SELECT task FROM t), b AS (SELECT DISTINCT task FROM c)
SELECT 'intersect' AS operation, count(*) AS tasks FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'only_catalogue', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'only_candidates', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""",
    "u3_ordered_union": f"""{_V} SELECT task, sample, replicate, step, p_t AS p FROM s
UNION ALL SELECT DISTINCT c.task, c.sample, s.replicate, 1, c.p FROM c JOIN s ON c.task = s.task AND c.sample = s.sample""",
    "u5_disjointness": """SELECT lower(trim(instance_id)) AS task, count(DISTINCT regexp_replace(lower(split), '[^a-z]', '', 'g')) AS parts
FROM candidate_index GROUP BY 1 HAVING parts > 1""",
    "v2_repeated_keys": "SELECT lower(trim(instance_id)) AS task, sample, count(*) AS rows FROM candidates GROUP BY ALL HAVING count(*) > 1",
    "v1_row_rules": " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (NOT coalesce({x}, FALSE)) AS broken FROM candidates" for n, x in _RULES.items()),
    "v5_hash_breaks": "SELECT state_id FROM states WHERE source IS NOT NULL AND sha256(source) <> lower(source_sha256)",
    "v7_dependency_breaks": f"{_V} SELECT task, sha, min(q) AS least, max(q) AS most FROM c WHERE sha IS NOT NULL GROUP BY ALL HAVING min(q) <> max(q)",
    "v9_formula_replay": f"{_V} SELECT task, sample FROM c WHERE abs((solved::INT + 0.5 * p) - (CASE WHEN solved THEN 1.0 ELSE 0.0 END + p / 2)) > 1e-8",
}
