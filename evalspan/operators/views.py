"""Clean views of the trajectory tables: one row per key, names in one spelling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import table

#: Continuations of one candidate.
REPLICATES = 4
#: Steps of a rollout after the candidate's first edit.
FIRST_STEP, LAST_STEP = 2, 8


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in a total order: a key that occurs often is one window of that key only."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def candidates(spark: SparkSession, directory: str) -> DataFrame:
    """One row per (task, sample), the one with the smallest candidate_id."""
    rows = table(spark, directory, "candidates").select(
        F.lower(F.trim("instance_id")).alias("task"), "sample", "candidate_id", "p", "q", "q_origin", "solved",
        "proxy_valid", "invalid_body", F.lower("source_sha256").alias("sha"), "generated_tokens",
    )
    return first_by_key(rows, ["task", "sample"], ["candidate_id"])


def states(spark: SparkSession, directory: str, *extra: str) -> DataFrame:
    """One row per (task, sample, replicate, step), the one with the smallest state_id; texts only if asked for."""
    rows = table(spark, directory, "states").select(
        F.lower(F.trim("instance_id")).alias("task"), "sample", "replicate", "step", "state_id",
        F.lower("source_sha256").alias("sha"), F.lower("prior_source_sha256").alias("prior_sha"), "p_t", "solved",
        "invalid_body", "hit_token_cap", "generated_tokens", "public_status", "public_seconds", "feedback_given", *extra,
    )
    return first_by_key(rows, ["task", "sample", "replicate", "step"], ["state_id"])


def outcomes(spark: SparkSession, directory: str) -> DataFrame:
    """One row per (task, sample, replicate); rows written twice are merged."""
    rows = table(spark, directory, "outcomes").withColumn("task", F.lower(F.trim("instance_id")))
    return rows.groupBy("task", "sample", "replicate").agg(
        F.bool_or("solved").alias("solved"), F.max("p8").alias("p8"), F.bool_or("public_valid").alias("public_valid")
    )


def tasks(spark: SparkSession, directory: str) -> DataFrame:
    """One row per task of the catalogue, the first listed."""
    rows = table(spark, directory, "candidate_index").withColumn("task", F.lower(F.trim("instance_id")))
    return first_by_key(rows, ["task"], ["row_id"]).select("task", "row_id", "image_name", "split", "f2p_count", "p2p_count")


#: The same views for the SQL of the queries.
SQL = r"""
c AS (
  SELECT * EXCLUDE (n) FROM (
    SELECT lower(trim(instance_id)) AS task, sample, candidate_id, p, q, q_origin, solved, proxy_valid, invalid_body,
           lower(source_sha256) AS sha, generated_tokens,
           row_number() OVER (PARTITION BY lower(trim(instance_id)), sample ORDER BY candidate_id) AS n
    FROM candidates) WHERE n = 1
), s AS (
  SELECT * EXCLUDE (n) FROM (
    SELECT lower(trim(instance_id)) AS task, sample, replicate, step, state_id, lower(source_sha256) AS sha,
           lower(prior_source_sha256) AS prior_sha, p_t, solved, invalid_body, hit_token_cap, generated_tokens,
           public_status, public_seconds, feedback_given, source,
           row_number() OVER (PARTITION BY lower(trim(instance_id)), sample, replicate, step ORDER BY state_id) AS n
    FROM states) WHERE n = 1
), o AS (
  SELECT lower(trim(instance_id)) AS task, sample, replicate, bool_or(solved) AS solved, max(p8) AS p8,
         bool_or(public_valid) AS public_valid
  FROM outcomes GROUP BY ALL
), t AS (
  SELECT * EXCLUDE (n) FROM (
    SELECT lower(trim(instance_id)) AS task, row_id, image_name, split, f2p_count, p2p_count,
           row_number() OVER (PARTITION BY lower(trim(instance_id)) ORDER BY row_id) AS n
    FROM candidate_index) WHERE n = 1
)
"""
