"""Round trips through sources and sinks, integrity of stored tables, and the batch side of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code
from ..functions import scalars as fn
from ..operators import ranking, views
from ..runtime import Workspace
from ..sources import readers, writers
from ..streaming import journal
from ..tables import table
from .metrics import K, LEVELS

FIELDS = ["task", "sample", "p", "q"]


def jsonl_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    """Candidates written as sorted-key JSON lines and read again strictly."""
    path = f"{Workspace(spark, 'jsonl').root}/rows"
    writers.write_jsonl(views.candidates(spark, directory).select(*FIELDS), path, ["task", "sample"])
    return readers.read_jsonl(spark, path, "task string, sample int, p double, q double")[0].drop("_line_number")


def jsonl_bytes(spark: SparkSession, directory: str) -> DataFrame:
    """Hash of each row's sorted-key JSON: equal rows give equal bytes."""
    rows = views.tasks(spark, directory).select("task", "f2p_count")
    named = F.struct(F.col("f2p_count").alias("a"), F.col("task").alias("b"))
    return rows.select("task", F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256).alias("sha"))


def object_files(spark: SparkSession, directory: str) -> DataFrame:
    """One JSON object per repository's owner in a folder of its own, read back through a glob."""
    root = f"{Workspace(spark, 'objects').root}/runs"
    owners = views.tasks(spark, directory).groupBy(F.substring(F.col("task"), 1, 1).alias("letter")).agg(F.count("*").alias("tasks"))
    rows = owners.select("letter", F.to_json(F.struct("letter", "tasks")).alias("value"))
    rows.repartition("letter").write.partitionBy("letter").text(root)
    return readers.read_jsonl(spark, f"{root}/*/*.txt", "letter string, tasks long", strict=False)[0]


def csv_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    path = f"{Workspace(spark, 'csv').root}/rows"
    views.tasks(spark, directory).select("row_id", "task", "f2p_count").write.option("header", True).csv(path)
    return readers.read_csv(spark, path, "row_id long, task string, f2p_count int")


def journal_batches(spark: SparkSession, directory: str) -> DataFrame:
    """Outcomes journalled in two batches, the second with rows of the first: each key once."""
    path = f"{Workspace(spark, 'journal').root}/log"
    o = views.outcomes(spark, directory)
    keys = ["task", "sample", "replicate"]
    writers.append_journal(o.where("replicate < 2"), path, keys, "first")
    writers.append_journal(o, path, keys, "second")
    return writers.read_journal(spark, path, keys).groupBy("batch").agg(F.count("*").alias("rows"))


def public_export(spark: SparkSession, directory: str) -> DataFrame:
    """Candidates without q, as they may be shown."""
    path = f"{Workspace(spark, 'export').root}/public"
    writers.export_public(views.candidates(spark, directory), ["task", "sample", "p", "solved"], path)
    return spark.read.parquet(path).withColumn("solved", F.col("solved").cast("int"))


def manifest_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Rows of each table in a manifest whose digests still hold."""
    tables = {"candidates": views.candidates(spark, directory).select(*FIELDS), "outcomes": views.outcomes(spark, directory)}
    saved = writers.manifest("panel-1", {"replicates": K}, tables)
    changed = writers.check_manifest(saved, tables)
    return spark.createDataFrame([(n, t["rows"], int(n in changed)) for n, t in saved["tables"].items()], "name string, rows long, changed int")


def byte_ranges(spark: SparkSession, directory: str) -> DataFrame:
    return readers.byte_ranges(spark, 1_000_003, 65_536)


def reports(spark: SparkSession, directory: str) -> DataFrame:
    """XML test reports made of the second steps of each candidate's few rollouts, counted again."""
    s = views.states(spark, directory).where("step = 2")
    case = F.when(F.col("solved"), F.lit('<testcase name="t"/>')).when(F.col("invalid_body"), F.lit('<testcase name="t"><error>e</error></testcase>')).otherwise(F.lit('<testcase name="t"><failure>f</failure></testcase>'))
    documents = s.groupBy("task", "sample").agg(F.concat(F.lit("<testsuite>"), F.array_join(F.collect_list(case), ""), F.lit("</testsuite>")).alias("xml"))
    return documents.select("task", "sample", readers.report_counts(F.col("xml")).alias("r")).select("task", "sample", "r.*")


def canonical_json(spark: SparkSession, directory: str) -> DataFrame:
    e = table(spark, directory, "events")
    return e.select("event_id", code.canonical_json_of("props").alias("props"))


def removed_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Lines that a small diff made of each task's counts removes."""
    t = views.tasks(spark, directory).where("f2p_count is not null")
    patch = F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -"), F.col("f2p_count").cast("string"), F.lit(",3 +1,2 @@\n keep\n-gone\n-too\n+new\n"))
    return t.select("task", F.array_join(F.transform(code.removed_lines_of(patch), lambda x: x.cast("string")), ",").alias("lines"))


def complete_blocks(spark: SparkSession, directory: str) -> DataFrame:
    return journal.complete_blocks(views.outcomes(spark, directory), ["task", "sample"], "replicate", K).select("task", "sample", "replicate")


def windowed_events(spark: SparkSession, directory: str) -> DataFrame:
    """Events per day and type; the same plan runs on a stream."""
    e = table(spark, directory, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = journal.windowed_counts(e, "at", "event_type", "1 day", "1 hour")
    return out.select(F.date_format(F.col("window.start"), "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("mean_value", 8).alias("mean_value"))


def sign_accuracy(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of candidates by the sign of the gain of p at the second step times that of the hits: right, tied."""
    from .rollouts import hit_labels, strict_means

    rows = hit_labels(spark, directory).join(strict_means(spark, directory).select("task", "sample", "gain"), ["task", "sample"])
    c = ranking.pair_counts(rows.withColumn("level", F.col("hits").cast("int")), ["task"], "gain", "level", LEVELS)
    return c.select("task", "scored", "correct", "tied", F.round(ranking.accuracy(F.col("correct"), F.col("tied"), F.col("scored")), 9).alias("accuracy"))


def source_digests(spark: SparkSession, directory: str) -> DataFrame:
    """Digest of each task's parts, and the seed in it, against the same from the file of the catalogue."""
    d = fn.seeded_digest("files-1", F.col("task"))
    return views.tasks(spark, directory).select("task", d.alias("digest"), fn.seed_of(d).alias("seed"))


QUERIES = {
    "s1_jsonl_round_trip": jsonl_round_trip, "s10_jsonl_bytes": jsonl_bytes, "s4_object_files": object_files, "s9_csv_round_trip": csv_round_trip,
    "s11_journal_batches": journal_batches, "s13_public_export": public_export, "s14_manifest_counts": manifest_counts, "s16_byte_ranges": byte_ranges,
    "s7_reports": reports, "f16_canonical_json": canonical_json, "f14_removed_lines": removed_lines, "r2_complete_blocks": complete_blocks,
    "r_windowed_events": windowed_events, "m4_sign_accuracy": sign_accuracy, "f5_source_digests": source_digests,
}

_V = f"WITH {views.SQL}"

ORACLE = {
    "s1_jsonl_round_trip": f"{_V} SELECT task, sample, p, q FROM c",
    "s10_jsonl_bytes": f"""{_V} SELECT task, sha256('{{"a":' || coalesce(f2p_count::VARCHAR, 'null') || ',"b":"' || task || '"}}') AS sha FROM t""",
    "s4_object_files": f"{_V} SELECT task[1:1] AS letter, count(*) AS tasks FROM t GROUP BY 1",
    "s9_csv_round_trip": f"{_V} SELECT row_id, task, f2p_count FROM t",
    "s11_journal_batches": f"{_V} SELECT CASE WHEN replicate < 2 THEN 'first' ELSE 'second' END AS batch, count(*) AS rows FROM o GROUP BY 1",
    "s13_public_export": f"{_V} SELECT task, sample, p, solved::INT AS solved FROM c",
    "s14_manifest_counts": f"{_V} SELECT 'candidates' AS name, count(*) AS rows, 0 AS changed FROM c UNION ALL SELECT 'outcomes', count(*), 0 FROM o",
    "s16_byte_ranges": "SELECT i AS part, i * 65536 AS start, least((i + 1) * 65536, 1000003) AS stop FROM range(16) g(i)",
    "s7_reports": f"""{_V} SELECT task, sample, count(*) AS collected, count(*) FILTER (NOT solved AND NOT invalid_body) AS failures,
  count(*) FILTER (NOT solved AND invalid_body) AS errors, 0 AS skipped FROM s WHERE step = 2 GROUP BY ALL""",
    "f16_canonical_json": "SELECT event_id, replace(props, ' ', '') AS props FROM events",
    "f14_removed_lines": f"{_V} SELECT task, (f2p_count + 1) || ',' || (f2p_count + 2) AS lines FROM t WHERE f2p_count IS NOT NULL",
    "r2_complete_blocks": f"{_V} SELECT task, sample, replicate FROM o QUALIFY count(*) OVER (PARTITION BY task, sample) = 4 AND max(replicate) OVER (PARTITION BY task, sample) = 3",
    "r_windowed_events": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, round(avg(value), 8) AS mean_value FROM events GROUP BY ALL""",
    "m4_sign_accuracy": f"""{_V}, h AS (SELECT task, sample, count(*) FILTER (c.solved OR hit IS NOT NULL) AS hits FROM
  (SELECT task, sample, replicate, min(step) FILTER (solved) AS hit FROM s GROUP BY ALL) LEFT JOIN c USING (task, sample) GROUP BY ALL),
g AS (SELECT task, sample, CASE WHEN count(p_t) = 4 THEN avg(p_t) END AS m FROM s WHERE step = 2 GROUP BY ALL),
k AS (SELECT task, sample, hits, round(m - p, 9) AS gain FROM h JOIN g USING (task, sample) JOIN c USING (task, sample)),
x AS (SELECT a.task, count(*) AS scored, count(*) FILTER (a.gain < b.gain) AS correct, count(*) FILTER (a.gain = b.gain) AS tied
      FROM k a JOIN k b ON a.task = b.task AND a.hits < b.hits WHERE a.gain IS NOT NULL AND b.gain IS NOT NULL GROUP BY a.task)
SELECT t.task, coalesce(scored, 0) AS scored, coalesce(correct, 0) AS correct, coalesce(tied, 0) AS tied,
  CASE WHEN scored > 0 THEN round((correct + 0.5 * tied) / scored, 9) END AS accuracy FROM (SELECT DISTINCT task FROM k) t LEFT JOIN x USING (task)""",
    "f5_source_digests": f"{_V} SELECT task, sha256('files-1' || chr(0) || task) AS digest, ('0x' || sha256('files-1' || chr(0) || task)[1:8])::BIGINT AS seed FROM t",
}
