"""Steps of rollouts: transitions, first hits, changes, rewards and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import joins, sequences, views

KEYS = ["task", "sample", "replicate"]
TESTS = 20  # public tests of a task, from which a share of passed ones gives a number of failed ones


def _curve(spark: SparkSession, directory: str) -> DataFrame:
    """States with two counts of failing tests and whether the state can be judged."""
    s = views.states(spark, directory)
    return s.select(*KEYS, "step", F.round((1 - F.col("p_t")) * TESTS).cast("int").alias("f"),
                    F.col("hit_token_cap").cast("int").alias("r"), (F.col("public_status") == "scored").alias("valid"))


def transitions(spark: SparkSession, directory: str) -> DataFrame:
    rows = sequences.with_previous(_curve(spark, directory), KEYS, "step", ["f", "r", "valid"]).where("prev_step is not null")
    label = sequences.transition_label(*[F.col(c) for c in ("f", "r", "valid", "prev_f", "prev_r", "prev_valid")])
    return rows.select(*KEYS, F.col("prev_step").alias("from_step"), F.col("step").alias("to_step"), label.alias("label"))


def curve_totals(spark: SparkSession, directory: str) -> DataFrame:
    """Transitions by label, with the number of rollouts that have such a one."""
    rows = transitions(spark, directory).groupBy(*KEYS, "label").agg(F.count("*").alias("n"))
    return rows.groupBy("label").agg(F.sum("n").alias("transitions"), F.count("*").alias("rollouts"))


def _hits(spark: SparkSession, directory: str) -> DataFrame:
    """First step at which a rollout is solved; 1 if its candidate is."""
    hits = sequences.first_hit(views.states(spark, directory), KEYS, "step", "solved")
    c = views.candidates(spark, directory).select("task", "sample", F.col("solved").alias("at_once"))
    return hits.join(c, ["task", "sample"], "left").withColumn("first_hit", F.when(F.col("at_once"), 1).otherwise(F.col("first_hit")))


def first_hit_histogram(spark: SparkSession, directory: str) -> DataFrame:
    """Rollouts by first solved step, steps without any as 0."""
    counts = _hits(spark, directory).groupBy("first_hit").agg(F.count("*").alias("n"))
    grid = spark.range(1, views.LAST_STEP + 1).select(F.col("id").cast("int").alias("step"))
    return grid.join(counts, F.col("step") == F.col("first_hit"), "left").select("step", F.coalesce("n", F.lit(0)).alias("rollouts"))


def hit_labels(spark: SparkSession, directory: str) -> DataFrame:
    """Share of a candidate's rollouts that are solved at some step."""
    return _hits(spark, directory).groupBy("task", "sample").agg(
        F.count("*").alias("rollouts"), F.count("first_hit").alias("hits"), F.round(F.count("first_hit") / F.count("*"), 9).alias("share"))


def future_hits(spark: SparkSession, directory: str) -> DataFrame:
    s = views.states(spark, directory).where("step >= 3")
    return s.groupBy(*KEYS).agg(F.coalesce(F.bool_or("solved"), F.lit(False)).cast("int").alias("hit"))


def strict_means(spark: SparkSession, directory: str) -> DataFrame:
    """Mean of p at step 2 over the replicates, null unless all have it; and its gain over the candidate's p."""
    s = views.states(spark, directory).where("step = 2").groupBy("task", "sample").agg(
        F.count("p_t").alias("known"), F.avg("p_t").alias("mean"))
    strict = F.when(F.col("known") == views.REPLICATES, F.col("mean"))
    c = views.candidates(spark, directory).select("task", "sample", "p")
    return c.join(s, ["task", "sample"]).select("task", "sample", F.round(strict, 9).alias("mean_p2"), (F.round(strict - F.col("p"), 9) + 0.0).alias("gain"))


def first_changes(spark: SparkSession, directory: str) -> DataFrame:
    """First step whose p, and whose length, differs from the first state's; whether the length moved before p did."""
    s = views.states(spark, directory).withColumn("size", F.col("generated_tokens").cast("double"))
    p = sequences.first_change(s, KEYS, "step", "p_t").withColumnRenamed("first_change", "p_change")
    q = sequences.first_change(s, KEYS, "step", "size").withColumnRenamed("first_change", "size_change")
    early = F.col("size_change").isNotNull() & (F.col("p_change").isNull() | (F.col("size_change") < F.col("p_change")))
    return p.join(q, KEYS).select(*KEYS, "p_change", "size_change", early.cast("int").alias("early"))


def silent_moves(spark: SparkSession, directory: str) -> DataFrame:
    s = views.states(spark, directory).withColumn("size", F.col("generated_tokens").cast("double"))
    return sequences.silent_moves(s, KEYS, "step", "p_t", "solved", "size").select(*KEYS, F.col("silent").cast("int").alias("silent"))


def advantages(spark: SparkSession, directory: str) -> DataFrame:
    """Candidates' rewards, 1 if solved plus half of p, normalised within the task."""
    c = views.candidates(spark, directory).where("p is not null and solved is not null")
    c = c.withColumn("reward", fn.terminal_reward(F.col("solved"), F.col("p")))
    return sequences.group_advantage(c, ["task"], "reward").select("task", "sample", F.round("reward", 9).alias("reward"), (F.round("advantage", 7) + 0.0).alias("advantage"))


def step_advantages(spark: SparkSession, directory: str) -> DataFrame:
    """p of each step normalised over the rollouts of the task at that step."""
    s = views.states(spark, directory)
    return sequences.group_advantage(s, ["task", "step"], "p_t").select(*KEYS, "step", (F.round("advantage", 7) + 0.0).alias("advantage"))


def reward_variance(spark: SparkSession, directory: str) -> DataFrame:
    """Population variances of two rewards per task, and whether they tell candidates apart at all."""
    c = views.candidates(spark, directory)
    out = c.groupBy("task").agg(F.var_pop(F.col("solved").cast("double")).alias("terminal"), F.var_pop("p").alias("test"),
                                F.count_distinct("p").alias("values"))
    return out.select("task", F.round("terminal", 9).alias("terminal"), F.round("test", 9).alias("test"),
                      (F.col("terminal") <= 1e-12).cast("int").alias("terminal_tied"), (F.col("values") > 1).cast("int").alias("informative"))


def step_returns(spark: SparkSession, directory: str) -> DataFrame:
    s = views.states(spark, directory).join(views.outcomes(spark, directory).select(*KEYS, F.col("solved").alias("end")), KEYS)
    return sequences.step_returns(s, KEYS, "step", "p_t", "end", 0.5).select(*KEYS, "step", (F.round("step_return", 9) + 0.0).alias("step_return"))


def rewards_to_go(spark: SparkSession, directory: str) -> DataFrame:
    s = views.states(spark, directory).withColumn("reward", F.col("p_t"))
    return sequences.rewards_to_go(s, KEYS, "step", "reward", 0.9).select(*KEYS, "step", F.round("to_go", 8).alias("to_go"))


def spread_score(spark: SparkSession, directory: str) -> DataFrame:
    """The rollout's last p at each of its steps."""
    w = Window.partitionBy(*KEYS).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return views.states(spark, directory).select(*KEYS, "step", F.last("p_t").over(w).alias("final_p"))


def chain_breaks(spark: SparkSession, directory: str) -> DataFrame:
    """Steps whose prior hash isn't the hash of the step before, where both are known."""
    rows = sequences.with_previous(views.states(spark, directory), KEYS, "step", ["sha"])
    return rows.where("prev_step = step - 1 and prior_sha <> prev_sha").select(*KEYS, "step")


def prior_states(spark: SparkSession, directory: str) -> DataFrame:
    """p before each step: of the step before, or of the candidate at the first step."""
    rows = sequences.with_previous(views.states(spark, directory), KEYS, "step", ["p_t"])
    c = views.candidates(spark, directory).select("task", "sample", "p")
    prior = F.when(F.col("step") == views.FIRST_STEP, F.col("p")).when(F.col("prev_step") == F.col("step") - 1, F.col("prev_p_t"))
    return rows.join(c, ["task", "sample"], "left").select(*KEYS, "step", prior.alias("prior_p"))


def missing_steps(spark: SparkSession, directory: str) -> DataFrame:
    """Steps that a rollout should have and hasn't."""
    s = views.states(spark, directory)
    grid = joins.expected_grid(s.select(*KEYS).distinct(), {"step": (views.FIRST_STEP, views.LAST_STEP)})
    return joins.missing_and_extra(s, grid, [*KEYS, "step"])


def public_status(spark: SparkSession, directory: str) -> DataFrame:
    """Passed and total tests read from the feedback, and how often they agree with p."""
    s = views.states(spark, directory)
    got = F.regexp_extract("feedback_given", r"(\d+)/(\d+) passed; exitcode=(\d+)", 0)
    n = lambda k: F.expr(f"try_cast(regexp_extract(feedback_given, '([0-9]+)/([0-9]+) passed; exitcode=([0-9]+)', {k}) as int)")
    rows = s.where(got != "").select("public_status", n(1).alias("passed"), n(2).alias("total"), n(3).alias("exitcode"), "p_t")
    agrees = F.abs(F.try_divide("passed", "total") - F.col("p_t")) <= 1e-9
    return rows.groupBy("public_status").agg(
        F.count("*").alias("states"), F.sum("passed").alias("passed"), F.sum("total").alias("total"),
        F.count(F.when(F.col("exitcode").isin(0, 1) & (F.col("total") > 0), 1)).alias("valid"), F.count(F.when(agrees, 1)).alias("agree"))


QUERIES = {
    "w3_transitions": transitions, "a17_curve_totals": curve_totals, "a14_first_hit_histogram": first_hit_histogram,
    "m9_hit_labels": hit_labels, "a15_future_hits": future_hits, "a16_strict_means": strict_means, "w4_first_changes": first_changes,
    "w6_silent_moves": silent_moves, "w10_advantages": advantages, "w11_step_advantages": step_advantages,
    "a10_reward_variance": reward_variance, "w13_step_returns": step_returns, "w14_rewards_to_go": rewards_to_go,
    "w12_spread_score": spread_score, "v6_chain_breaks": chain_breaks, "j11_prior_states": prior_states,
    "j15_missing_steps": missing_steps, "a19_public_status": public_status,
}

_W = "WINDOW w AS (PARTITION BY task, sample, replicate ORDER BY step)"
_TRANSITIONS = f"""WITH {views.SQL}, k AS (
  SELECT task, sample, replicate, step, round((1 - p_t) * {TESTS})::INT AS f, hit_token_cap::INT AS r, coalesce(public_status = 'scored', FALSE) AS v FROM s
), l AS (SELECT *, lag(step) OVER w AS ps, lag(f) OVER w AS pf, lag(r) OVER w AS pr, lag(v) OVER w AS pv FROM k {_W})
SELECT task, sample, replicate, ps AS from_step, step AS to_step, CASE WHEN NOT (v AND pv) THEN 'invalid' WHEN f = pf AND r = pr THEN 'neutral'
  WHEN f <= pf AND r <= pr THEN 'positive' WHEN f >= pf AND r >= pr THEN 'negative' ELSE 'mixed' END AS label FROM l WHERE ps IS NOT NULL"""
_HITS = f"""WITH {views.SQL}, h AS (
  SELECT task, sample, replicate, CASE WHEN bool_or(c.solved) THEN 1 ELSE min(step) FILTER (s.solved) END AS hit
  FROM s LEFT JOIN c USING (task, sample) GROUP BY ALL)"""
_CHANGE = "min(step) FILTER (abs({v} - f_{n}) > 1e-12)"

ORACLE = {
    "w3_transitions": _TRANSITIONS,
    "a17_curve_totals": f"SELECT label, count(*) AS transitions, count(DISTINCT (task, sample, replicate)) AS rollouts FROM ({_TRANSITIONS}) GROUP BY label",
    "a14_first_hit_histogram": f"{_HITS} SELECT g.step::INT AS step, count(h.hit) AS rollouts FROM range(1, 9) g(step) LEFT JOIN h ON h.hit = g.step GROUP BY g.step",
    "m9_hit_labels": f"{_HITS} SELECT task, sample, count(*) AS rollouts, count(hit) AS hits, round(count(hit) / count(*), 9) AS share FROM h GROUP BY ALL",
    "a15_future_hits": f"WITH {views.SQL} SELECT task, sample, replicate, coalesce(bool_or(solved), FALSE)::INT AS hit FROM s WHERE step >= 3 GROUP BY ALL",
    "a16_strict_means": f"""WITH {views.SQL}, g AS (SELECT task, sample, CASE WHEN count(p_t) = 4 THEN avg(p_t) END AS m FROM s WHERE step = 2 GROUP BY ALL)
SELECT task, sample, round(m, 9) AS mean_p2, round(m - p, 9) + 0.0 AS gain FROM c JOIN g USING (task, sample)""",
    "w4_first_changes": f"""WITH {views.SQL}, k AS (
  SELECT *, first(p_t) OVER w AS f_p, first(generated_tokens) OVER w AS f_q FROM s {_W}),
g AS (SELECT task, sample, replicate, {_CHANGE.format(v="p_t", n="p")} AS p_change, {_CHANGE.format(v="generated_tokens", n="q")} AS size_change FROM k GROUP BY ALL)
SELECT *, (size_change IS NOT NULL AND (p_change IS NULL OR size_change < p_change))::INT AS early FROM g""",
    "w6_silent_moves": f"""WITH {views.SQL}, k AS (
  SELECT *, lag(p_t) OVER w AS pp, lag(solved) OVER w AS ps, lag(generated_tokens) OVER w AS pq FROM s {_W})
SELECT task, sample, replicate, coalesce(bool_or(abs(p_t - pp) <= 1e-12 AND solved = ps AND abs(generated_tokens - pq) > 1e-12), FALSE)::INT AS silent FROM k GROUP BY ALL""",
    "w10_advantages": f"""WITH {views.SQL}, k AS (SELECT task, sample, solved::INT + 0.5 * p AS r FROM c WHERE p IS NOT NULL AND solved IS NOT NULL),
m AS (SELECT *, avg(r) OVER (PARTITION BY task) AS a, stddev_pop(r) OVER (PARTITION BY task) AS d FROM k)
SELECT task, sample, round(r, 9) AS reward, round(CASE WHEN d > 1e-6 THEN (r - a) / d ELSE 0.0 END, 7) + 0.0 AS advantage FROM m""",
    "w11_step_advantages": f"""WITH {views.SQL}, m AS (SELECT *, avg(p_t) OVER w AS a, stddev_pop(p_t) OVER w AS d FROM s WINDOW w AS (PARTITION BY task, step))
SELECT task, sample, replicate, step, round(CASE WHEN p_t IS NULL THEN NULL WHEN d > 1e-6 THEN (p_t - a) / d ELSE 0.0 END, 7) + 0.0 AS advantage FROM m""",
    "a10_reward_variance": f"""WITH {views.SQL} SELECT task, round(var_pop(solved::INT), 9) AS terminal, round(var_pop(p), 9) AS test,
  (var_pop(solved::INT) <= 1e-12)::INT AS terminal_tied, (count(DISTINCT p) > 1)::INT AS informative FROM c GROUP BY task""",
    "w13_step_returns": f"""WITH {views.SQL}, k AS (SELECT s.*, o.solved AS y,
  last(p_t) OVER (PARTITION BY task, sample, replicate ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, lag(p_t) OVER w AS b
  FROM s JOIN o USING (task, sample, replicate) {_W})
SELECT task, sample, replicate, step, round(y::INT + 0.5 * (l - b), 9) + 0.0 AS step_return FROM k""",
    "w14_rewards_to_go": f"""WITH {views.SQL}, k AS (SELECT *, row_number() OVER w AS i FROM s {_W})
SELECT a.task, a.sample, a.replicate, a.step, round(sum(coalesce(b.p_t, 0) * pow(0.9, b.i - a.i)), 8) AS to_go
FROM k a JOIN k b ON a.task = b.task AND a.sample = b.sample AND a.replicate = b.replicate AND b.i >= a.i GROUP BY ALL""",
    "w12_spread_score": f"""WITH {views.SQL} SELECT task, sample, replicate, step,
  last(p_t) OVER (PARTITION BY task, sample, replicate ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final_p FROM s""",
    "v6_chain_breaks": f"""WITH {views.SQL}, k AS (SELECT *, lag(step) OVER w AS ps, lag(sha) OVER w AS ph FROM s {_W})
SELECT task, sample, replicate, step FROM k WHERE ps = step - 1 AND prior_sha <> ph""",
    "j11_prior_states": f"""WITH {views.SQL}, k AS (SELECT *, lag(step) OVER w AS ps, lag(p_t) OVER w AS pp FROM s {_W})
SELECT k.task, k.sample, replicate, step, CASE WHEN step = 2 THEN c.p WHEN ps = step - 1 THEN pp END AS prior_p FROM k LEFT JOIN c ON c.task = k.task AND c.sample = k.sample""",
    "j15_missing_steps": f"""WITH {views.SQL}, g AS (SELECT DISTINCT task, sample, replicate, g.step::INT AS step FROM s, range(2, 9) g(step))
SELECT *, 'missing' AS side FROM (SELECT * FROM g EXCEPT SELECT task, sample, replicate, step FROM s)
UNION ALL SELECT *, 'extra' FROM (SELECT task, sample, replicate, step FROM s EXCEPT SELECT * FROM g)""",
    "a19_public_status": f"""WITH {views.SQL}, k AS (SELECT public_status, p_t, regexp_extract(feedback_given, '([0-9]+)/([0-9]+) passed; exitcode=([0-9]+)', 1) AS a,
  regexp_extract(feedback_given, '([0-9]+)/([0-9]+) passed; exitcode=([0-9]+)', 2) AS b, regexp_extract(feedback_given, '([0-9]+)/([0-9]+) passed; exitcode=([0-9]+)', 3) AS e FROM s)
SELECT public_status, count(*) AS states, sum(a::INT) AS passed, sum(b::INT) AS total, count(*) FILTER (e IN ('0', '1') AND b::INT > 0) AS valid,
  count(*) FILTER (abs(a::INT / nullif(b::INT, 0) - p_t) <= 1e-9) AS agree FROM k WHERE a <> '' GROUP BY public_status""",
}
