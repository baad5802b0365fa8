"""Predicates with parameters, checks on planted breaks, replayed edits, and broken lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code
from ..functions import scalars as fn
from ..operators import checks, predicates, sequences, views
from ..runtime import Workspace
from ..sources import readers, writers
from ..tables import table
from .rollouts import KEYS, TESTS, _curve, transitions

FOLDERS, PREFIX, SUFFIX = ("test", "tests", "testing"), "test_", ".py"
FAMILIES, WORDS = ("func_", "lm_rewrite", "combine_"), ("arm64", "x86_64")


def single_path(spark: SparkSession, directory: str) -> DataFrame:
    """Tasks by the rule of one changed source file, on a patch made of the task's name and its counts of tests."""
    t = views.tasks(spark, directory)
    repo, family = fn.slug(fn.repo_key(F.col("task"))), fn.slug(fn.family(F.col("task")))
    path = F.concat(F.when(F.col("f2p_count") % 5 == 0, "Tests/").otherwise("src/"), repo, F.lit("/"), F.when(F.col("row_id") % 7 == 0, "test_").otherwise(""), family, F.lit(".py"))
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n"))
    paths = fn.patch_paths(F.when(F.col("p2p_count") % 3 == 0, F.concat(head, head)).otherwise(head))
    ok = predicates.holds(
        predicates.one_path(paths, SUFFIX, FOLDERS, PREFIX), predicates.not_blank(F.col("task"), F.col("image_name")),
        predicates.within(F.col("f2p_count"), 1, 10), predicates.within(F.col("p2p_count"), 1, 100), F.length(head) <= 6000,
    )
    return t.select("task", ok.cast("int").alias("eligible"))


def pool(spark: SparkSession, directory: str) -> DataFrame:
    """Tasks of some families whose image names one of the words."""
    t = views.tasks(spark, directory)
    ok = predicates.starts_with_any(fn.family(F.col("task")), FAMILIES) & predicates.contains_any(F.lower("image_name"), WORDS)
    return t.select("task", ok.cast("int").alias("in_pool"))


def retries(spark: SparkSession, directory: str) -> DataFrame:
    """States that may be tried again: by status, or because they hit the limit of tokens."""
    s = views.states(spark, directory)
    reason = F.when(F.col("hit_token_cap"), "token_cap").when(F.col("invalid_body"), "invalid_body")
    return s.where(predicates.retry(F.col("public_status"), ["timeout", "error"], reason, ["token_cap"])).select(*KEYS, "step")


def headroom(spark: SparkSession, directory: str) -> DataFrame:
    """Vectors by how many of their signs differ from all positive, within room on both sides."""
    e = table(spark, directory, "embeddings")
    differ = F.size(F.filter("embedding", lambda x: x <= 0))
    return e.select("vec_id", differ.alias("differ"), predicates.within(differ, 26, 38).cast("int").alias("has_room"))


def _curves(spark: SparkSession, directory: str) -> DataFrame:
    state = F.struct("step", F.col("f").alias("failing"), F.col("r").alias("broken"), F.coalesce("valid", F.lit(False)).alias("valid"))
    return _curve(spark, directory).groupBy(*KEYS).agg(F.sort_array(F.collect_list(state)).alias("curve"))


def endpoint_gates(spark: SparkSession, directory: str) -> DataFrame:
    """Rollouts with an outcome: whether the observed end agrees with it, and the gate over the whole curve."""
    c = _curves(spark, directory).join(views.outcomes(spark, directory).select(*KEYS, F.col("solved").alias("declared")), KEYS)
    last = F.get("curve", F.size("curve") - 1)
    observed = predicates.resolved(last["failing"], last["broken"], last["valid"])
    c = c.withColumn("observed", observed).withColumn("agrees", F.col("observed") == F.col("declared"))
    gate = predicates.endpoint_gate([F.lit(0), F.lit(0)], F.col("curve"), F.col("agrees"))
    return c.select(*KEYS, *[F.col(x).cast("int").alias(x) for x in ("observed", "agrees")], gate.cast("int").alias("gate"))


def first_status(spark: SparkSession, directory: str) -> DataFrame:
    """The first status that holds for each candidate's rollouts."""
    ends = views.outcomes(spark, directory).groupBy("task", "sample").agg(F.count("*").alias("ends"), F.count("p8").alias("known"), F.sum(F.col("solved").cast("int")).alias("hits"))
    c = views.candidates(spark, directory).select("task", "sample", "proxy_valid").join(ends, ["task", "sample"], "left")
    status = fn.first_label([
        (~F.coalesce("proxy_valid", F.lit(False)) & F.col("ends").isNull(), "failed"), (F.col("ends").isNull(), "pending"), (F.col("ends") < views.REPLICATES, "incomplete"),
        (F.col("hits").isin(0, views.REPLICATES), "inconclusive")], "descriptive")
    return c.select("task", "sample", status.alias("status"))


def gold_gates(spark: SparkSession, directory: str) -> DataFrame:
    """Rollouts that begin failing and end solved."""
    s = views.states(spark, directory).groupBy(*KEYS).agg(F.min_by("solved", "step").alias("first"), F.max_by("solved", "step").alias("last"))
    return s.select(*KEYS, predicates.gold_gate(F.col("last"), ~F.col("first")).cast("int").alias("gold"))


def compact_index(spark: SparkSession, directory: str) -> DataFrame:
    """The catalogue with sizes in place of lists, after a check that no task occurs twice."""
    t = views.tasks(spark, directory)
    checks.require_empty(checks.repeated_keys(t, ["task"]), "a task occurs twice")
    return t.select("task", F.sha2("task", 256).alias("digest"), F.size(F.split("task", "[._]")).alias("parts"))


def curve_report(spark: SparkSession, directory: str) -> DataFrame:
    """Sums over all curves: states, valid ones, mutations, and rollouts with an invalid state or a negative step."""
    s = _curve(spark, directory).groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("valid"), F.lit(False)).cast("int")).alias("v"))
    negative = transitions(spark, directory).where("label = 'negative'").select(*KEYS).distinct().withColumn("neg", F.lit(1))
    return s.join(negative, KEYS, "left").agg(
        F.count("*").alias("rollouts"), F.sum("n").alias("states"), F.sum("v").alias("valid_states"), F.sum(F.col("n") - 1).alias("mutations"),
        F.count(F.when(F.col("v") < F.col("n"), 1)).alias("with_invalid"), F.count("neg").alias("with_negative"))


def gae(spark: SparkSession, directory: str) -> DataFrame:
    s = views.states(spark, directory).withColumn("reward", F.col("solved").cast("double"))
    return sequences.advantages_to_go(s, KEYS, "step", "reward", "p_t", 0.9, 0.8).select(*KEYS, "step", (F.round("gae", 8) + 0.0).alias("gae"))


def feedback(spark: SparkSession, directory: str) -> DataFrame:
    """The feedback of each state, made of its share of passed tests."""
    s = views.states(spark, directory)
    passed = F.round(F.col("p_t") * TESTS).cast("int")
    said = fn.feedback_text(F.col("public_status") == "scored", passed, F.lit(TESTS), F.when(passed == TESTS, 0).otherwise(1), F.col("public_status"), F.col("invalid_body"))
    return s.select("state_id", said.alias("feedback"))


def broken_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of a written file that were cut, found by their text; every third task's line is planted as such."""
    path = f"{Workspace(spark, 'lines').root}/rows"
    line = F.concat(F.lit('{"task":"'), F.col("task"), F.lit('","n":'), F.col("row_id").cast("string"))
    t = views.tasks(spark, directory).select(F.when(F.col("row_id") % 3 == 0, line).otherwise(F.concat(line, F.lit("}"))).alias("value"))
    t.write.text(path)
    return readers.bad_lines(readers.numbered_lines(spark, path), "task string, n long").select("value")


def object_rows(spark: SparkSession, directory: str) -> DataFrame:
    """One JSON object over several lines per file, read through a glob."""
    root = f"{Workspace(spark, 'whole-objects').root}/runs"
    counts = views.tasks(spark, directory).groupBy(F.substring("task", 1, 1).alias("letter")).agg(F.count("*").alias("tasks"))
    text = F.concat(F.lit('{\n "first": "'), F.col("letter"), F.lit('",\n "tasks": '), F.col("tasks").cast("string"), F.lit("\n}"))
    counts.select("letter", text.alias("value")).repartition("letter").write.partitionBy("letter").text(root)
    rows = readers.read_objects(spark, f"{root}/*/*.txt", "first string, tasks long")
    return rows.select(F.regexp_extract("_file", "letter=([^/]+)/", 1).alias("folder"), "first", "tasks")


def replayed(spark: SparkSession, directory: str) -> DataFrame:
    """Files after a rollout's edits, made of its steps: one creation, then a line before all others for each step; the
    creations of sample 0 leave the root and fail."""
    s = views.states(spark, directory).select(*KEYS, "step")
    edits = sequences.with_previous(s, KEYS, "step", []).select(
        *KEYS, "step", F.when(F.col("prev_step").isNull(), "create").otherwise("insert").alias("command"),
        F.when(F.col("sample") == 0, "../../etc/x").otherwise("/testbed/src/./a.py").alias("path"),
        F.when(F.col("prev_step").isNull(), "end").otherwise(F.col("step").cast("string")).alias("text"),
        F.lit(None).cast("string").alias("old"), F.lit(0).alias("line"))
    return code.replay_edits(edits, KEYS, ["step"])


def planted_breaks(spark: SparkSession, directory: str) -> DataFrame:
    """Each check on tables with planted breaks: how many it finds."""
    s, c, o, t = (f(spark, directory) for f in (views.states, views.candidates, views.outcomes, views.tasks))
    text = table(spark, directory, "states").where("source is not null and source_sha256 is not null")
    spoilt = F.when(F.col("state_id") % 97 == 0, F.reverse(F.lower("source_sha256"))).otherwise(F.lower("source_sha256"))
    chain = sequences.with_previous(s.withColumn("prior_sha", F.when(F.col("state_id") % 50 == 0, "x").otherwise(F.col("prior_sha"))), KEYS, "step", ["sha"])
    shared = c.where("sha is not null and q is not null").select("task", "sha", "q")
    twice = shared.unionByName(shared.where("q < 0.3").withColumn("q", F.col("q") + 0.5))
    reward = c.where("p is not null and solved is not null").withColumn("reward", fn.terminal_reward(F.col("solved"), F.col("p")) + F.when(F.col("candidate_id") % 10 == 0, 0.001).otherwise(0.0))
    bits = table(spark, directory, "embeddings").select(fn.bit_string(F.col("embedding")).alias("bits"), "vec_id")
    means = fn.bin_means(F.col("bits"), 8, 8)
    mean = F.aggregate(means, F.lit(0.0), lambda a, x: a + x) / 8
    told = F.length(F.replace("bits", F.lit("0"), F.lit(""))) / 64.0 + F.when(F.col("vec_id") % 9 == 0, 0.01).otherwise(0.0)
    both = t.where("split is not null").select("task", F.regexp_replace(F.lower("split"), "[^a-z]", "").alias("part"), "row_id")
    both = both.select("task", "part").unionByName(both.where("row_id % 5 = 0").select("task", F.when(F.col("part") == "train", "heldout").otherwise("train").alias("part")))
    saved = writers.manifest("p", {}, {"o": o})
    changed = writers.check_manifest(saved, {"o": o.withColumn("p8", F.coalesce("p8", F.lit(0.0)))})
    parts = {
        "hash": text.where(F.sha2(F.col("source").cast("binary"), 256) != spoilt),
        "chain": chain.where("prev_step = step - 1 and prior_sha <> prev_sha"),
        "dependency": checks.dependency_breaks(twice, ["task", "sha"], "q"),
        "formula": reward.where(F.abs(F.col("reward") - (F.col("solved").cast("int") + F.col("p") / 2)) > 1e-8),
        "orphan": checks.orphans(o.withColumn("sample", F.when(F.col("replicate") == 3, F.col("sample") + 1000).otherwise(F.col("sample"))), c, ["task", "sample"]),
        "bins": bits.where(F.abs(mean - told) > 1e-9),
        "splits": both.groupBy("task").agg(F.count_distinct("part").alias("n")).where("n > 1"),
    }
    out = spark.createDataFrame([("manifest", len(changed))], "check string, broken long")
    for name, rows in parts.items():
        out = out.unionByName(rows.agg(F.count("*").alias("broken")).select(F.lit(name).alias("check"), "broken"))
    return out


QUERIES = {
    "op_p3_single_path": single_path, "op_p4_pool": pool, "op_p12_retries": retries, "op_p13_headroom": headroom, "op_p15_endpoint_gates": endpoint_gates,
    "op_p17_first_status": first_status, "op_p19_gold_gates": gold_gates, "op_p20_compact_index": compact_index, "a17_curve_report": curve_report,
    "w14_gae": gae, "f19_feedback": feedback, "s2_broken_lines": broken_lines, "s3_object_rows": object_rows, "f28_replayed": replayed, "v_planted_breaks": planted_breaks,
}

_V = f"WITH {views.SQL}"
_W = "WINDOW w AS (PARTITION BY task, sample, replicate ORDER BY step)"
_K = f"k AS (SELECT task, sample, replicate, step, round((1 - p_t) * {TESTS})::INT AS f, hit_token_cap::INT AS r, coalesce(public_status = 'scored', FALSE) AS v FROM s)"
_SLUG = "trim(regexp_replace({}, '[^A-Za-z0-9]+', '_', 'g'), '_')"
_FAMILY = "split_part(regexp_extract(task, '[^.]*$'), '__', 1)"
ORACLE = {
    # the family's path component begins with test_ by the planted prefix, or by its own name
    "op_p3_single_path": f"""{_V} SELECT task, (coalesce(f2p_count % 5 <> 0, TRUE) AND row_id % 7 <> 0 AND {_SLUG.format(_FAMILY)} NOT LIKE 'test\\_%' ESCAPE '\\'
  AND {_SLUG.format("split_part(task, '.', 1)")} NOT IN ('test', 'tests', 'testing') AND {_SLUG.format("split_part(task, '.', 1)")} NOT LIKE 'test\\_%' ESCAPE '\\'
  AND coalesce(p2p_count % 3 <> 0, TRUE) AND trim(task) <> '' AND coalesce(trim(image_name) <> '', FALSE) AND coalesce(f2p_count BETWEEN 1 AND 10, FALSE)
  AND coalesce(p2p_count BETWEEN 1 AND 100, FALSE))::INT AS eligible FROM t""",
    "op_p4_pool": f"""{_V} SELECT task, ((starts_with({_FAMILY}, 'func_') OR starts_with({_FAMILY}, 'lm_rewrite') OR starts_with({_FAMILY}, 'combine_'))
  AND coalesce(contains(lower(image_name), 'arm64') OR contains(lower(image_name), 'x86_64'), FALSE))::INT AS in_pool FROM t""",
    "op_p12_retries": f"{_V} SELECT task, sample, replicate, step FROM s WHERE public_status IN ('timeout', 'error') OR hit_token_cap",
    "op_p13_headroom": """SELECT vec_id, len(list_filter(embedding, lambda x: x <= 0)) AS differ,
  (len(list_filter(embedding, lambda x: x <= 0)) BETWEEN 26 AND 38)::INT AS has_room FROM embeddings""",
    "op_p15_endpoint_gates": f"""{_V}, {_K}, e AS (SELECT task, sample, replicate, arg_min(f, step) AS f0, arg_min(v, step) AS v0, arg_max(f, step) AS f1, arg_max(r, step) AS r1,
  arg_max(v, step) AS v1 FROM k GROUP BY ALL), x AS (SELECT e.*, (v1 AND coalesce(f1 = 0 AND r1 = 0, FALSE)) AS observed, o.solved AS declared FROM e JOIN o USING (task, sample, replicate))
SELECT task, sample, replicate, observed::INT AS observed, (observed = declared)::INT AS agrees,
  (v0 AND coalesce(f0 > 0, FALSE) AND v1 AND coalesce(observed = declared, FALSE))::INT AS gate FROM x""",
    "op_p17_first_status": f"""{_V}, e AS (SELECT task, sample, count(*) AS n, sum(solved::INT) AS h FROM o GROUP BY ALL)
SELECT task, sample, CASE WHEN NOT coalesce(proxy_valid, FALSE) AND n IS NULL THEN 'failed' WHEN n IS NULL THEN 'pending' WHEN n < 4 THEN 'incomplete'
  WHEN h IN (0, 4) THEN 'inconclusive' ELSE 'descriptive' END AS status FROM c LEFT JOIN e USING (task, sample)""",
    "op_p19_gold_gates": f"{_V} SELECT task, sample, replicate, coalesce(arg_max(solved, step) AND NOT arg_min(solved, step), FALSE)::INT AS gold FROM s GROUP BY ALL",
    "op_p20_compact_index": f"{_V} SELECT task, sha256(task) AS digest, len(regexp_split_to_array(task, '[._]')) AS parts FROM t",
    "a17_curve_report": f"""{_V}, {_K}, l AS (SELECT *, lag(f) OVER w AS pf, lag(r) OVER w AS pr, lag(v) OVER w AS pv FROM k {_W}),
g AS (SELECT count(*) AS n, count(*) FILTER (v) AS vn, bool_or(v AND pv AND NOT (f <= pf AND r <= pr) AND f >= pf AND r >= pr) AS neg FROM l GROUP BY task, sample, replicate)
SELECT count(*) AS rollouts, sum(n)::BIGINT AS states, sum(vn)::BIGINT AS valid_states, sum(n - 1)::BIGINT AS mutations, count(*) FILTER (vn < n) AS with_invalid,
  count(*) FILTER (neg) AS with_negative FROM g""",
    "w14_gae": f"""{_V}, k AS (SELECT *, row_number() OVER w AS i, coalesce(solved::INT, 0) + 0.9 * coalesce(lead(coalesce(p_t, 0)) OVER w, 0) - coalesce(p_t, 0) AS e FROM s {_W})
SELECT a.task, a.sample, a.replicate, a.step, round(sum(b.e * power(0.72, b.i - a.i)), 8) + 0.0 AS gae FROM k a JOIN k b
  ON a.task = b.task AND a.sample = b.sample AND a.replicate = b.replicate AND b.i >= a.i GROUP BY ALL""",
    "f19_feedback": f"""{_V} SELECT state_id, CASE WHEN coalesce(invalid_body, FALSE) THEN 'Previous edit was invalid; source unchanged. ' ELSE '' END || CASE WHEN coalesce(public_status = 'scored', FALSE)
  THEN 'Public tests: ' || round(p_t * {TESTS})::INT || '/{TESTS} passed; exitcode=' || CASE WHEN round(p_t * {TESTS})::INT = {TESTS} THEN 0 ELSE 1 END || '.'
  ELSE 'Public tests unavailable: ' || coalesce(public_status, 'invalid_observation') || '.' END AS feedback FROM s""",
    "s2_broken_lines": f"""{_V} SELECT '{{"task":"' || task || '","n":' || row_id AS value FROM t WHERE row_id % 3 = 0""",
    "s3_object_rows": f"{_V} SELECT task[1:1] AS folder, task[1:1] AS first, count(*) AS tasks FROM t GROUP BY ALL",
    "f28_replayed": f"""{_V}, k AS (SELECT task, sample, replicate, step, row_number() OVER w AS i FROM s {_W})
SELECT task, sample, replicate, CASE WHEN sample <> 0 THEN 'src/a.py' END AS path, CASE WHEN sample <> 0 THEN string_agg(CASE WHEN i = 1 THEN 'end' ELSE step::VARCHAR END, chr(10) ORDER BY i DESC) END AS text,
  CASE WHEN sample = 0 THEN 'a path that leaves its root' END AS error FROM k GROUP BY task, sample, replicate""",
    "v_planted_breaks": f"""{_V}, q AS (SELECT task, sha, q FROM c WHERE sha IS NOT NULL AND q IS NOT NULL), q2 AS (SELECT * FROM q UNION ALL SELECT task, sha, q + 0.5 FROM q WHERE q < 0.3),
k AS (SELECT task, sample, replicate, step, CASE WHEN state_id % 50 = 0 THEN 'x' ELSE prior_sha END AS pr, lag(step) OVER w AS ps, lag(sha) OVER w AS ph FROM s {_W}),
b AS (SELECT task, regexp_replace(lower(split), '[^a-z]', '', 'g') AS part, row_id FROM t WHERE split IS NOT NULL)
SELECT 'manifest' AS check, (count(*) FILTER (p8 IS NULL) > 0)::BIGINT AS broken FROM o
UNION ALL SELECT 'hash', count(*) FROM states WHERE source IS NOT NULL AND source_sha256 IS NOT NULL AND sha256(source) <> CASE WHEN state_id % 97 = 0 THEN reverse(lower(source_sha256)) ELSE lower(source_sha256) END
UNION ALL SELECT 'chain', count(*) FROM k WHERE ps = step - 1 AND pr <> ph
UNION ALL SELECT 'dependency', count(*) FROM (SELECT 1 FROM q2 GROUP BY task, sha HAVING min(q) <> max(q))
UNION ALL SELECT 'formula', count(*) FROM c WHERE p IS NOT NULL AND solved IS NOT NULL AND candidate_id % 10 = 0
UNION ALL SELECT 'orphan', count(*) FROM (SELECT task, CASE WHEN replicate = 3 THEN sample + 1000 ELSE sample END AS sample FROM o) ANTI JOIN c USING (task, sample)
UNION ALL SELECT 'bins', count(*) FROM embeddings WHERE vec_id % 9 = 0
UNION ALL SELECT 'splits', count(*) FROM (SELECT 1 FROM (SELECT task, part FROM b UNION ALL SELECT task, CASE WHEN part = 'train' THEN 'heldout' ELSE 'train' END FROM b WHERE row_id % 5 = 0)
  GROUP BY task HAVING count(DISTINCT part) > 1)""",
}
