"""Message logs, patches, identifiers and other texts.

The tables hold no message logs, so one is made for each rollout from its states: every step calls a tool (an editor or
a shell, by the step), and is answered. Arguments are JSON text or a nested object, and some are broken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import messages as msg
from ..operators import views
from ..tables import table

KEYS = ["task", "sample", "replicate"]
COMMANDS = {2: "create", 4: "str_replace", 6: "undo_edit", 8: "view"}
SHELL = {3: "sed -i s/a/b/ setup.py", 5: "grep -rn TODO . | head", 7: "GIT CHECKOUT -- . && rm out.txt > log.txt"}


def _case(step, values: dict[int, str]):
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(step == k, v).otherwise(out)
    return out


def logs(spark: SparkSession, directory: str) -> DataFrame:
    """One row per rollout: its messages as JSON and its final patch."""
    s = views.states(spark, directory).withColumn("call_id", F.concat(F.lit("call-"), "state_id"))
    s = s.withColumn("path", F.concat(F.lit("/testbed/src/"), fn.slug(fn.family(F.col("task"))), F.lit("_"), F.col("step").cast("string"), F.lit(".py")))
    edit = F.to_json(F.struct(_case(F.col("step"), COMMANDS).alias("command"), "path"))
    shell = F.to_json(F.struct(_case(F.col("step"), SHELL).alias("command")))
    arguments = F.when(F.col("state_id") % 10 == 0, "{broken").when(F.col("step") % 2 == 0, edit).otherwise(shell)
    name = F.when(F.col("step") % 2 == 0, msg.EDITOR).otherwise("bash")
    # nested object instead of text for a third of the calls
    quoted = F.when(F.col("state_id") % 3 == 0, arguments).otherwise(F.to_json(F.struct(arguments.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(arguments.alias("x")))) - 6))
    quoted = F.when(F.col("state_id") % 10 == 0, F.lit('"{broken"')).otherwise(quoted)
    call = F.concat(F.lit('{"role":"assistant","message_type":"action","tool_calls":[{"id":"'), "call_id", F.lit('","function":{"name":"'), name, F.lit('","arguments":'), quoted, F.lit("}}]}"))
    said = F.when(F.col("solved"), F.concat(F.lit("File created successfully at: "), "path")).otherwise(F.concat(F.lit("The file "), "path", F.lit(" has been edited.")))
    text = F.concat(F.lit("OBSERVATION:\\n\\n"), said)
    content = F.when(F.col("state_id") % 2 == 0, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit('[{"text":"'), text, F.lit('"}]')))
    answer = F.concat(F.lit('{"role":"tool","tool_call_ids":["'), "call_id", F.lit('"],"content":'), content, F.lit("}"))
    diff = F.when(F.col("step").isin(4, 7), F.concat(F.lit("diff --git a/"), F.substr("path", F.lit(10)), F.lit(" b/"), F.substr("path", F.lit(10)), F.lit("\n")))
    rows = s.select(*KEYS, "step", call.alias("call"), answer.alias("answer"), F.when(F.col("public_status") == "scored", diff).alias("diff"))
    # a rollout has at most seven steps
    whole = rows.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("step", "call", "answer", "diff"))).alias("steps"))
    parts = F.flatten(F.transform("steps", lambda x: F.array(x["call"], x["answer"])))
    patch = F.array_join(F.filter(F.transform("steps", lambda x: x["diff"]), lambda d: d.isNotNull()), "")
    return whole.select(*KEYS, F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")).alias("messages"), patch.alias("patch"))


def _calls(spark: SparkSession, directory: str) -> DataFrame:
    return msg.tool_calls(msg.messages(logs(spark, directory), "messages", KEYS), KEYS)


def structured_edits(spark: SparkSession, directory: str) -> DataFrame:
    return msg.structured_edits(_calls(spark, directory)).select(*KEYS, "call_id", "command", fn.strip_root(F.col("path")).alias("path"))


def action_counts(spark: SparkSession, directory: str) -> DataFrame:
    m = msg.messages(logs(spark, directory), "messages", KEYS)
    return m.groupBy(*KEYS).agg(F.count(F.when(F.col("m.message_type") == "action", 1)).alias("actions"), F.count("*").alias("messages"))


def suspicious_shell(spark: SparkSession, directory: str) -> DataFrame:
    rows = msg.shell_commands(_calls(spark, directory))
    return rows.select(F.explode_outer("labels").alias("label")).groupBy("label").agg(F.count("*").alias("calls"))


def undo_counts(spark: SparkSession, directory: str) -> DataFrame:
    return msg.undo_calls(_calls(spark, directory)).groupBy("task").agg(F.count("*").alias("undone"))


def edit_outcomes(spark: SparkSession, directory: str) -> DataFrame:
    """Edits with success and first telling line, from the last response to the call."""
    m = msg.messages(logs(spark, directory), "messages", KEYS)
    edits = msg.structured_edits(msg.tool_calls(m, KEYS))
    out = msg.edit_outcomes(edits, msg.responses(m, KEYS), KEYS)
    return out.select(*KEYS, "call_id", F.col("succeeded").cast("int").alias("succeeded"), "first_line")


def patch_alignment(spark: SparkSession, directory: str) -> DataFrame:
    rows = logs(spark, directory)
    edits = msg.structured_edits(msg.tool_calls(msg.messages(rows, "messages", KEYS), KEYS)).withColumn("path", fn.strip_root(F.col("path")))
    changed = edits.where("command <> 'create'").groupBy(*KEYS).agg(F.collect_set("path").alias("changed"))
    both = rows.select(*KEYS, "patch").join(changed, KEYS, "left")
    label = msg.patch_alignment(F.col("patch"), F.coalesce("changed", F.array().cast("array<string>")))
    return both.groupBy(label.alias("class")).agg(F.count("*").alias("rollouts"))


def patch_paths(spark: SparkSession, directory: str) -> DataFrame:
    rows = logs(spark, directory).where("patch <> ''")
    return rows.select(*KEYS, F.array_join(fn.patch_paths(F.col("patch"), "a"), ",").alias("old"), F.array_join(fn.patch_paths(F.col("patch"), "b"), ",").alias("new"))


def task_parts(spark: SparkSession, directory: str) -> DataFrame:
    t = views.tasks(spark, directory)
    k = F.col("task")
    digest = fn.joined_hash(k, F.col("row_id"))
    return t.select("task", fn.repo_key(k).alias("repo"), fn.profile_id(k).alias("profile"), fn.family(k).alias("family"), fn.slug(k).alias("slug"),
                    digest.alias("row_digest"), fn.seed_of(digest).alias("seed"))


def content_hashes(spark: SparkSession, directory: str) -> DataFrame:
    d = table(spark, directory, "documents")
    return d.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


def fence_bodies(spark: SparkSession, directory: str) -> DataFrame:
    """Length of the code inside the first fence of each completion."""
    c = table(spark, directory, "candidates").where("completion is not null")
    return c.select("candidate_id", F.length(fn.fence_body(F.col("completion"))).alias("code_chars"))


def edits_once(spark: SparkSession, directory: str) -> DataFrame:
    """Exactly-once replacement of the word return in each completion: occurrences, and the new length if it was one."""
    c = table(spark, directory, "candidates").where("completion is not null")
    old, new = F.lit("return"), F.lit("yield")
    return c.select("candidate_id", fn.fits_once(F.col("completion"), old).alias("occurrences"), F.length(fn.replace_once(F.col("completion"), old, new)).alias("new_length"))


def tagged_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of a tagged block built around each task's parts."""
    t = views.tasks(spark, directory)
    text = F.concat(F.lit("x <failing_test>\n  "), F.col("task"), F.lit("  \n\n "), F.coalesce("image_name", F.lit("none")), F.lit("\n</failing_test> y"))
    return t.select("task", F.array_join(fn.tagged_lines(text, "failing_test"), "|").alias("lines"))


def rewards(spark: SparkSession, directory: str) -> DataFrame:
    """Three rewards of each candidate with q: outcome alone, and with half of p or of q."""
    c = views.candidates(spark, directory).where("p is not null and q is not null and solved is not null")
    y = F.col("solved").cast("double")
    return c.select("task", "sample", y.alias("terminal"), F.round(fn.terminal_reward(F.col("solved"), F.col("p")), 9).alias("test"), F.round(fn.terminal_reward(F.col("solved"), F.col("q")), 9).alias("semantic"))


def objective(spark: SparkSession, directory: str) -> DataFrame:
    """Clipped objective and divergence of tokens made from p and q: means per task."""
    c = views.candidates(spark, directory).where("p is not null and q is not null")
    r = F.col("q") - F.col("p")
    return c.groupBy("task").agg(F.round(F.avg(fn.clipped_objective(r, F.col("p") - 0.5)), 8).alias("objective"), F.round(F.avg(fn.kl_estimate(r)), 8).alias("kl"),
                                 F.round(F.avg(fn.sigmoid(r)), 8).alias("sigmoid"))


def json_events(spark: SparkSession, directory: str) -> DataFrame:
    """Events by type with the mean of a number in their JSON properties."""
    e = table(spark, directory, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.avg("k"), 9).alias("mean_k"), F.max("k").alias("most_k"))


QUERIES = {
    "p1_edits": structured_edits, "p2_action_counts": action_counts, "p6_suspicious_shell": suspicious_shell, "p7_undo_counts": undo_counts,
    "j14_edit_outcomes": edit_outcomes, "p5_patch_alignment": patch_alignment, "f8_patch_paths": patch_paths, "f1_task_parts": task_parts,
    "f7_content_hashes": content_hashes, "f31_fence_bodies": fence_bodies, "f28_edits_once": edits_once, "f11_tagged_lines": tagged_lines,
    "f17_rewards": rewards, "f23_objective": objective, "s_json_events": json_events,
}
# the prefix p and a number is kept for the training-data problems
QUERIES = {("op_" + k if k[0] == "p" else k): v for k, v in QUERIES.items()}

_V = f"WITH {views.SQL}"
_PATH = "'src/' || trim(regexp_replace(split_part(split_part(task, '.', -1), '__', 1), '[^A-Za-z0-9]+', '_', 'g'), '_') || '_' || step || '.py'"
_EDITS = f"""{_V}, e AS (
  SELECT task, sample, replicate, step, solved, 'call-' || state_id AS call_id, CASE step WHEN 2 THEN 'create' ELSE 'str_replace' END AS command, {_PATH} AS path
  FROM s WHERE step IN (2, 4) AND state_id % 10 <> 0
)"""
_PATCH = f"""d AS (SELECT task, sample, replicate, list({_PATH} ORDER BY step) FILTER (step IN (4, 7) AND public_status = 'scored') AS paths FROM s GROUP BY ALL)"""

ORACLE = {
    "op_p1_edits": f"{_EDITS} SELECT task, sample, replicate, call_id, command, path FROM e",
    "op_p2_action_counts": f"{_V} SELECT task, sample, replicate, count(*) AS actions, 2 * count(*) AS messages FROM s GROUP BY ALL",
    "op_p6_suspicious_shell": f"""{_V}, k AS (SELECT step, state_id % 10 = 0 AS broken FROM s WHERE step IN (3, 5, 7))
SELECT label, count(*) AS calls FROM (SELECT unnest(CASE WHEN broken OR step = 5 THEN [NULL] WHEN step = 3 THEN ['sed_in_place']
  ELSE ['filesystem_command', 'git_mutation'] END) AS label FROM k) GROUP BY label""",
    "op_p7_undo_counts": f"{_V} SELECT task, count(*) AS undone FROM s WHERE step = 6 AND state_id % 10 <> 0 GROUP BY task",
    "j14_edit_outcomes": f"""{_EDITS} SELECT task, sample, replicate, call_id, (coalesce(solved, FALSE) = (command = 'create'))::INT AS succeeded,
  CASE WHEN solved THEN 'File created successfully at: /testbed/' || path ELSE 'The file /testbed/' || path || ' has been edited.' END AS first_line FROM e""",
    "op_p5_patch_alignment": f"""{_EDITS}, {_PATCH}, m AS (SELECT task, sample, replicate, list(path) FILTER (command <> 'create') AS changed FROM e GROUP BY ALL)
SELECT CASE WHEN len(coalesce(paths, [])) = 0 THEN 'empty_patch' WHEN list_has_any(paths, coalesce(changed, [])) THEN 'aligned_non_create_path'
  WHEN len(coalesce(changed, [])) = 0 THEN 'no_non_create_editor_mutation' ELSE 'disjoint_nonempty_patch' END AS class, count(*) AS rollouts
FROM d LEFT JOIN m USING (task, sample, replicate) GROUP BY 1""",
    "f8_patch_paths": f"{_V}, {_PATCH} SELECT task, sample, replicate, array_to_string(paths, ',') AS old, array_to_string(paths, ',') AS new FROM d WHERE len(paths) > 0",
    "f1_task_parts": f"""{_V}, k AS (SELECT *, sha256(task || chr(0) || row_id) AS d FROM t)
SELECT task, split_part(task, '.', 1) AS repo, regexp_replace(task, '\\.[^.]*$', '') AS profile, split_part(split_part(task, '.', -1), '__', 1) AS family,
  trim(regexp_replace(task, '[^A-Za-z0-9]+', '_', 'g'), '_') AS slug, d AS row_digest, ('0x' || d[1:8])::BIGINT AS seed FROM k""",
    "f7_content_hashes": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "f31_fence_bodies": """SELECT candidate_id, length(CASE WHEN regexp_matches(completion, '(?s)```[A-Za-z]*\\n.*?```')
  THEN regexp_extract(completion, '(?s)```[A-Za-z]*\\n(.*?)\\n?```', 1) ELSE completion END) AS code_chars FROM candidates WHERE completion IS NOT NULL""",
    "f28_edits_once": """SELECT candidate_id, (length(completion) - length(replace(completion, 'return', ''))) // 6 AS occurrences,
  CASE WHEN (length(completion) - length(replace(completion, 'return', ''))) // 6 = 1 THEN length(completion) - 1 END AS new_length FROM candidates WHERE completion IS NOT NULL""",
    "f11_tagged_lines": f"{_V} SELECT task, task || '|' || coalesce(trim(image_name), 'none') AS lines FROM t",
    "f17_rewards": f"""{_V} SELECT task, sample, solved::INT::DOUBLE AS terminal, round(solved::INT + 0.5 * p, 9) AS test, round(solved::INT + 0.5 * q, 9) AS semantic
FROM c WHERE p IS NOT NULL AND q IS NOT NULL AND solved IS NOT NULL""",
    "f23_objective": f"""{_V}, k AS (SELECT task, q - p AS r, p - 0.5 AS a FROM c WHERE p IS NOT NULL AND q IS NOT NULL)
SELECT task, round(avg(least(exp(r) * a, greatest(0.8, least(1.2, exp(r))) * a)), 8) AS objective, round(avg(exp(r) - r - 1), 8) AS kl, round(avg(1 / (1 + exp(-r))), 8) AS sigmoid FROM k GROUP BY task""",
    "s_json_events": """SELECT event_type, count(*) AS events, round(avg((props->>'$.k')::INT), 9) AS mean_k, max((props->>'$.k')::INT) AS most_k FROM events GROUP BY 1""",
}
