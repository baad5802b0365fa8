"""Success rates, rank correlation and pairwise ranking accuracy of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import ranking, views

K = views.REPLICATES
LEVELS = list(range(K + 1))
CONFIDENT = fn.confident_levels(K)


def success_rates(spark: SparkSession, directory: str) -> DataFrame:
    """Candidates with their number of outcomes and successes; ``rate`` only where all K outcomes exist."""
    done = views.outcomes(spark, directory).groupBy("task", "sample").agg(
        F.count("*").alias("trials"), F.sum(F.col("solved").cast("int")).alias("successes")
    )
    rows = views.candidates(spark, directory).join(done, ["task", "sample"], "left")
    full = F.col("trials") == K
    return rows.withColumn("trials", F.coalesce("trials", F.lit(0))).withColumn(
        "level", F.when(full, F.col("successes"))
    ).withColumn("rate", F.when(full, F.col("successes") / K))


def candidate_q_wilson(spark: SparkSession, directory: str) -> DataFrame:
    lo, hi = fn.wilson(F.col("successes"), F.col("trials"))
    return success_rates(spark, directory).select(
        "task", "sample", "trials", F.coalesce("successes", F.lit(0)).alias("successes"), F.round("rate", 9).alias("rate"),
        F.round(lo, 9).alias("lower"), F.round(hi, 9).alias("upper"),
    )


def candidate_average_rank(spark: SparkSession, directory: str) -> DataFrame:
    return ranking.average_ranks(success_rates(spark, directory), ["task"], "p").select("task", F.col("p"), "n", "avg_rank")


def _spearman(score: str):
    def query(spark: SparkSession, directory: str) -> DataFrame:
        rows = success_rates(spark, directory).where("rate is not null")
        return ranking.spearman(rows, ["task"], score, "level").select("task", "n", (F.round("rho", 9) + 0.0).alias("rho"), "reason")

    return query


def _accuracy(score: str):
    def query(spark: SparkSession, directory: str) -> DataFrame:
        c = ranking.pair_counts(success_rates(spark, directory), ["task"], score, "level", LEVELS, CONFIDENT)
        return c.select(
            "task", "pairs", "scored", "correct", "tied",
            F.round(ranking.accuracy(F.col("correct"), F.col("tied"), F.col("scored")), 9).alias("accuracy"),
            F.round(F.try_divide("scored", "pairs"), 9).alias("coverage"), "confident_pairs", "confident_correct",
        )

    return query


def matched_comparison(spark: SparkSession, directory: str) -> DataFrame:
    """p and q on the rows where both are known, and their difference."""
    rows = success_rates(spark, directory).dropna(subset=["p", "q", "level"])
    out = None
    for s in ("p", "q"):
        c = ranking.pair_counts(rows, ["task"], s, "level", LEVELS)
        a = c.select("task", "scored", ranking.accuracy(F.col("correct"), F.col("tied"), F.col("scored")).alias(s))
        out = a if out is None else out.join(a.select("task", s), "task")
    return out.select("task", F.col("scored").alias("pairs"), F.round("p", 9).alias("p_accuracy"), F.round("q", 9).alias("q_accuracy"),
                      (F.round(F.col("q") - F.col("p"), 9) + 0.0).alias("difference"))


def same_p_unsolved(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of unsolved candidates of exactly equal p, ordered by q."""
    rows = success_rates(spark, directory).where("not solved and p is not null")
    c = ranking.pair_counts(rows, ["task", "p"], "q", "level", LEVELS)
    s = c.groupBy("task").agg(*[F.sum(x).alias(x) for x in ("rows", "pairs", "scored", "correct", "tied")])
    return s.select("task", F.col("rows").alias("candidates"), "pairs", "scored",
                    F.round(ranking.accuracy(F.col("correct"), F.col("tied"), F.col("scored")), 9).alias("accuracy"))


def concordance(spark: SparkSession, directory: str) -> DataFrame:
    """Candidates' p against being solved at the end of each rollout: ties of the score left out; pooled and per task."""
    ends = views.outcomes(spark, directory).select("task", "sample", F.col("solved").cast("int").alias("end"))
    rows = views.candidates(spark, directory).select("task", "sample", "p").join(ends, ["task", "sample"])
    c = ranking.pair_counts(rows, ["task"], "p", "end", [0, 1])
    per = c.select("task", "correct", (F.col("scored") - F.col("correct") - F.col("tied")).alias("wrong"))
    return per.groupBy(F.lit("all").alias("scope")).agg(
        F.sum("correct").alias("concordant"), F.sum("wrong").alias("discordant"),
        F.round(F.try_divide(F.sum("correct"), F.sum("correct") + F.sum("wrong")), 9).alias("pooled"),
        F.round(F.avg(F.try_divide("correct", F.col("correct") + F.col("wrong"))), 9).alias("task_macro"),
    )


def positive_negative_auc(spark: SparkSession, directory: str) -> DataFrame:
    """Every later hit against every other state of one candidate, by p_t at step 2; candidate means, then task means."""
    keys = ["task", "sample", "replicate"]
    s = views.states(spark, directory)
    later = s.where("step >= 3").groupBy(*keys).agg(F.bool_or("solved").cast("int").alias("y"))
    rows = s.where("step = 2").select(*keys, "p_t").join(later, keys)
    c = ranking.pair_counts(rows, ["task", "sample"], "p_t", "y", [0, 1]).where("scored > 0")
    auc = c.select("task", ranking.accuracy(F.col("correct"), F.col("tied"), F.col("scored")).alias("auc"))
    per = auc.groupBy("task").agg(F.avg("auc").alias("auc"), F.count("*").alias("candidates"))
    return per.groupBy(F.lit("all").alias("scope")).agg(
        F.round(F.avg("auc"), 9).alias("task_macro"), F.count("*").alias("tasks"), F.sum("candidates").alias("candidates"),
        F.round(F.sum(F.col("auc") * F.col("candidates")) / F.sum("candidates"), 9).alias("candidate_macro"),
    )


def tie_splits(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of candidates that p can't tell apart, and those of them that q can."""
    return ranking.tie_splits(views.candidates(spark, directory), ["task"], "p", "q")


def macro_means(spark: SparkSession, directory: str) -> DataFrame:
    """Mean over tasks of each correlation where it exists, with the number of tasks, and over tasks that have both."""
    p = _spearman("p")(spark, directory).select("task", F.col("rho").alias("p"))
    q = _spearman("q")(spark, directory).select("task", F.col("rho").alias("q"))
    both = F.col("p").isNotNull() & F.col("q").isNotNull()
    return p.join(q, "task", "full").agg(
        F.round(F.avg("p"), 8).alias("p_mean"), F.count("p").alias("p_tasks"), F.round(F.avg("q"), 8).alias("q_mean"),
        F.count("q").alias("q_tasks"), F.round(F.avg(F.when(both, F.col("p"))), 8).alias("paired_p"),
        F.round(F.avg(F.when(both, F.col("q"))), 8).alias("paired_q"),
        F.round(F.avg(F.col("q") - F.col("p")), 8).alias("paired_difference"), F.count(F.when(both, 1)).alias("paired_tasks"),
    )


def replicate_pairs(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of continuations of one candidate that ended differently: at most six per candidate."""
    pairs = ranking.replicate_pairs(views.outcomes(spark, directory), ["task", "sample"], "replicate", ["solved", "p8"])
    return pairs.where("solved_a <> solved_b").select(
        "task", "sample", "a", "b", F.col("solved_a").cast("int").alias("solved_a"),
        F.signum(F.col("p8_a") - F.col("p8_b")).cast("int").alias("p_sign"),
    )


QUERIES = {
    "candidate_q_wilson": candidate_q_wilson, "w1_average_rank": candidate_average_rank,
    "w2_spearman_p": _spearman("p"), "w2_spearman_q": _spearman("q"), "m1_accuracy_p": _accuracy("p"),
    "m1_accuracy_q": _accuracy("q"), "m2_matched_comparison": matched_comparison, "m3_same_p_unsolved": same_p_unsolved,
    "m5_concordance": concordance, "m6_positive_negative_auc": positive_negative_auc, "a9_tie_splits": tie_splits,
    "a11_macro_means": macro_means, "j9_replicate_pairs": replicate_pairs,
}

_RATES = f"""WITH {views.SQL}, d AS (
  SELECT task, sample, count(*) AS trials, sum(solved::INT) AS successes FROM o GROUP BY ALL
), r AS (
  SELECT c.*, coalesce(trials, 0) AS trials, successes, CASE WHEN trials = {K} THEN successes END AS level
  FROM c LEFT JOIN d USING (task, sample)
)"""

_RHO = f"""{_RATES}, x AS (
  SELECT task, {{s}} AS v, level, rank() OVER (PARTITION BY task ORDER BY {{s}}) + (count(*) OVER (PARTITION BY task, {{s}}) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY task ORDER BY level) + (count(*) OVER (PARTITION BY task, level) - 1) / 2.0 AS ry
  FROM r WHERE level IS NOT NULL AND {{s}} IS NOT NULL
), y AS (
  SELECT task, count(*) AS n, corr(rx, ry) AS rho, count(DISTINCT v) AS dv, count(DISTINCT level) AS dl FROM x GROUP BY task
)
SELECT task, n, CASE WHEN n >= 2 AND dv > 1 AND dl > 1 THEN round(rho, 9) + 0.0 END AS rho,
       CASE WHEN n < 2 THEN 'fewer_than_two_observations' WHEN dl = 1 THEN 'constant_y' WHEN dv = 1 THEN 'constant_x' END AS reason
FROM y"""

_PAIRS = f"""{_RATES}, p AS (
  SELECT a.task, a.level AS la, b.level AS lb, a.{{s}} AS sa, b.{{s}} AS sb FROM r a JOIN r b ON a.task = b.task AND a.level < b.level
), g AS (
  SELECT task, count(*) AS pairs, count(sa + sb) AS scored, count(*) FILTER (sa < sb) AS correct, count(*) FILTER (sa = sb) AS tied,
         count(*) FILTER (la = 0 AND lb = 4) AS confident_pairs, count(*) FILTER (la = 0 AND lb = 4 AND sa < sb) AS confident_correct
  FROM p GROUP BY task
)
SELECT t.task, coalesce(pairs, 0) AS pairs, coalesce(scored, 0) AS scored, coalesce(correct, 0) AS correct, coalesce(tied, 0) AS tied,
       CASE WHEN scored > 0 THEN round((correct + 0.5 * tied) / scored, 9) END AS accuracy,
       CASE WHEN pairs > 0 THEN round(scored / pairs, 9) END AS coverage,
       coalesce(confident_pairs, 0) AS confident_pairs, coalesce(confident_correct, 0) AS confident_correct
FROM (SELECT DISTINCT task FROM r WHERE level IS NOT NULL) t LEFT JOIN g ON g.task = t.task"""

_MACRO = ", ".join(f"{n} AS (SELECT task, rho FROM ({_RHO.format(s=n)}))" for n in ("p", "q"))

ORACLE = {
    "candidate_q_wilson": f"""{_RATES}, w AS (
  SELECT *, successes / trials::DOUBLE AS f, {fn.Z95} AS z, 1 + {fn.Z95} * {fn.Z95} / trials AS below FROM r)
SELECT task, sample, trials, coalesce(successes, 0) AS successes, round(level / 4.0, 9) AS rate,
  CASE WHEN trials > 0 THEN round(greatest(0.0, (f + z * z / (2 * trials) - z * sqrt(f * (1 - f) / trials + z * z / (4.0 * trials * trials))) / below), 9) END AS lower,
  CASE WHEN trials > 0 THEN round(least(1.0, (f + z * z / (2 * trials) + z * sqrt(f * (1 - f) / trials + z * z / (4.0 * trials * trials))) / below), 9) END AS upper
FROM w""",
    "w1_average_rank": f"""{_RATES} SELECT DISTINCT task, p, count(*) OVER (PARTITION BY task, p) AS n,
  rank() OVER (PARTITION BY task ORDER BY p) + (count(*) OVER (PARTITION BY task, p) - 1) / 2.0 AS avg_rank FROM r WHERE p IS NOT NULL""",
    "w2_spearman_p": _RHO.format(s="p"), "w2_spearman_q": _RHO.format(s="q"),
    "m1_accuracy_p": _PAIRS.format(s="p"), "m1_accuracy_q": _PAIRS.format(s="q"),
    "m2_matched_comparison": f"""{_RATES}, m AS (SELECT * FROM r WHERE p IS NOT NULL AND q IS NOT NULL AND level IS NOT NULL),
g AS (SELECT a.task, count(*) AS n, avg(CASE WHEN a.p < b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS pa,
             avg(CASE WHEN a.q < b.q THEN 1.0 WHEN a.q = b.q THEN 0.5 ELSE 0 END) AS qa
      FROM m a JOIN m b ON a.task = b.task AND a.level < b.level GROUP BY a.task)
SELECT t.task, coalesce(n, 0) AS pairs, round(pa, 9) AS p_accuracy, round(qa, 9) AS q_accuracy, round(qa - pa, 9) + 0.0 AS difference
FROM (SELECT DISTINCT task FROM m) t LEFT JOIN g ON g.task = t.task""",
    "m3_same_p_unsolved": f"""{_RATES}, m AS (SELECT * FROM r WHERE NOT solved AND p IS NOT NULL AND level IS NOT NULL),
g AS (SELECT a.task, count(*) AS n, count(a.q + b.q) AS scored, count(*) FILTER (a.q < b.q) AS ok, count(*) FILTER (a.q = b.q) AS tied
      FROM m a JOIN m b ON a.task = b.task AND a.p = b.p AND a.level < b.level GROUP BY a.task)
SELECT t.task, t.n AS candidates, coalesce(g.n, 0) AS pairs, coalesce(scored, 0) AS scored,
       CASE WHEN scored > 0 THEN round((ok + 0.5 * tied) / scored, 9) END AS accuracy
FROM (SELECT task, count(*) AS n FROM m GROUP BY task) t LEFT JOIN g ON g.task = t.task""",
    "m5_concordance": f"""WITH {views.SQL}, e AS (SELECT task, sample, p, o.solved AS y FROM c JOIN o USING (task, sample)),
g AS (SELECT a.task, count(*) FILTER (a.p < b.p) AS ok, count(*) FILTER (a.p > b.p) AS bad FROM e a JOIN e b ON a.task = b.task AND NOT a.y AND b.y GROUP BY a.task)
SELECT 'all' AS scope, sum(ok) AS concordant, sum(bad) AS discordant, round(sum(ok) / nullif(sum(ok) + sum(bad), 0), 9) AS pooled,
       round(avg(ok / nullif(ok + bad, 0)), 9) AS task_macro FROM g""",
    "m6_positive_negative_auc": f"""WITH {views.SQL}, l AS (SELECT task, sample, replicate, bool_or(solved) AS y FROM s WHERE step >= 3 GROUP BY ALL),
e AS (SELECT task, sample, replicate, p_t, y FROM s JOIN l USING (task, sample, replicate) WHERE step = 2),
g AS (SELECT a.task, a.sample, avg(CASE WHEN a.p_t < b.p_t THEN 1.0 WHEN a.p_t = b.p_t THEN 0.5 ELSE 0 END) AS auc
      FROM e a JOIN e b ON a.task = b.task AND a.sample = b.sample AND NOT a.y AND b.y WHERE a.p_t IS NOT NULL AND b.p_t IS NOT NULL GROUP BY ALL),
k AS (SELECT task, avg(auc) AS auc, count(*) AS n FROM g GROUP BY task)
SELECT 'all' AS scope, round(avg(auc), 9) AS task_macro, count(*) AS tasks, sum(n) AS candidates, round(sum(auc * n) / sum(n), 9) AS candidate_macro FROM k""",
    "a9_tie_splits": f"""WITH {views.SQL}, g AS (SELECT a.task, count(*) AS same, count(*) FILTER (a.q IS DISTINCT FROM b.q) AS split
  FROM c a JOIN c b ON a.task = b.task AND a.sample < b.sample AND a.p IS NOT DISTINCT FROM b.p GROUP BY a.task)
SELECT t.task, coalesce(same, 0) AS same, coalesce(split, 0) AS split FROM (SELECT DISTINCT task FROM c) t LEFT JOIN g ON g.task = t.task""",
    "a11_macro_means": f"""WITH {_MACRO}, j AS (SELECT p.rho AS p, q.rho AS q FROM p FULL JOIN q USING (task))
SELECT round(avg(p), 8) AS p_mean, count(p) AS p_tasks, round(avg(q), 8) AS q_mean, count(q) AS q_tasks,
  round(avg(p) FILTER (q IS NOT NULL), 8) AS paired_p, round(avg(q) FILTER (p IS NOT NULL), 8) AS paired_q,
  round(avg(q - p), 8) AS paired_difference, count(q + p) AS paired_tasks FROM j""",
    "j9_replicate_pairs": f"""WITH {views.SQL} SELECT a.task, a.sample, a.replicate AS a, b.replicate AS b, a.solved::INT AS solved_a,
  sign(a.p8 - b.p8)::INT AS p_sign FROM o a JOIN o b ON a.task = b.task AND a.sample = b.sample AND a.replicate < b.replicate
  WHERE a.solved <> b.solved""",
}
