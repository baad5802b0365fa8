"""Nested message logs: tool calls, structured edits, responses, shell commands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn

#: Explicit schema: ``content`` and ``arguments`` may be text or nested JSON; either way they arrive as text.
SCHEMA = (
    "array<struct<role string, message_type string, content string, tool_call_ids array<string>, "
    "tool_calls array<struct<id string, function struct<name string, arguments string>>>>>"
)
EDITOR, SHELLS = "str_replace_editor", ("bash", "shell", "terminal")
EDITS = ("create", "insert", "str_replace")
# Labels of shell commands that may change files, and the patterns that define them, found anywhere in a
# command whatever the letter case.
SUSPICIOUS = {
    "sed_in_place": r"\bsed\s+(?:[^\n]*\s)?-i(?:\s|['\"]|$)",
    "perl_in_place": r"\bperl\s+[^\n]*(?:-pi|-p\s+-i)\b",
    "python_write_text": r"\bwrite_text\s*\(",
    "python_open_write": r"\bopen\s*\([^\n]{0,160},\s*['\"](?:w|a|x)[+b]?['\"]",
    "shell_redirect": r"\b(?:cat|echo|printf)\b[^\n]*(?:>>|>)",
    "tee": r"(?:^|[;&|]\s*)tee(?:\s|$)",
    "filesystem_command": r"(?:^|[;&|]\s*)(?:mv|cp|rm|touch)\s",
    "git_mutation": r"\bgit\s+(?:checkout|restore|apply|reset|clean)\b",
    "patch_command": r"(?:^|[;&|]\s*)patch(?:\s|$)",
}
# The four classes of a final patch against the edits.
EMPTY, ALIGNED, NO_EDIT, DISJOINT = "empty_patch", "aligned_non_create_path", "no_non_create_editor_mutation", "disjoint_nonempty_patch"


def messages(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """One row per message with its position; a log that isn't a JSON array has none."""
    parsed = F.from_json(F.col(column), SCHEMA, {"mode": "PERMISSIVE"})
    return df.select(*keys, F.posexplode(parsed).alias("message_index", "m")).where("m is not null")


def tool_calls(msgs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per tool call: name and arguments, which stay text."""
    calls = msgs.select(*keys, "message_index", F.posexplode("m.tool_calls").alias("call_index", "c"))
    return calls.select(*keys, "message_index", "call_index", F.col("c.id").alias("call_id"), F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments"))


def structured_edits(calls: DataFrame) -> DataFrame:
    """Calls of the editor that create, insert or replace; arguments that can't be read are skipped."""
    a = F.from_json("arguments", "command string, path string", {"mode": "PERMISSIVE"})
    rows = calls.where(F.col("name") == EDITOR).withColumn("a", a)
    return rows.where(F.col("a.command").isin(*EDITS)).withColumns({"command": F.col("a.command"), "path": F.col("a.path")}).drop("a", "arguments", "name")


def undo_calls(calls: DataFrame) -> DataFrame:
    a = F.from_json("arguments", "command string")
    return calls.where((F.col("name") == EDITOR) & (a["command"] == "undo_edit"))


def shell_commands(calls: DataFrame) -> DataFrame:
    """Shell calls with the labels of what may change files; unreadable arguments count as an empty command."""
    command = F.coalesce(F.from_json("arguments", "command string")["command"], F.lit(""))
    rows = calls.where(F.col("name").isin(*SHELLS)).withColumn("command", command)
    return rows.withColumn("labels", fn.matched_labels(F.col("command"), SUSPICIOUS)).drop("arguments", "name")


def plain_content(content: Column) -> Column:
    """Text of a message's content: itself, or the texts of a list of parts joined by line ends."""
    parts = F.from_json(content, "array<struct<text string>>")
    listed = F.startswith(F.ltrim(content), F.lit("[")) & parts.isNotNull()
    return F.when(listed, F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "\n")).otherwise(content)


def responses(msgs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last response to each call: ``keys, call_id, response``."""
    rows = msgs.select(*keys, "message_index", F.explode("m.tool_call_ids").alias("call_id"), plain_content(F.col("m.content")).alias("text"))
    return rows.groupBy(*keys, "call_id").agg(F.max_by("text", "message_index").alias("response"))


def edit_outcomes(edits: DataFrame, answered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edits with success read from the response, and its first telling line; no response means no success."""
    ok = F.when(F.col("command") == "create", F.contains("response", F.lit("File created successfully at:"))).otherwise(F.contains("response", F.lit(" has been edited.")))
    joined = edits.join(answered, [*keys, "call_id"], "left")
    return joined.withColumn("succeeded", F.coalesce(ok, F.lit(False))).withColumn("first_line", fn.first_said(F.col("response"))).drop("response")


def patch_alignment(patch: Column, edited_not_created: Column) -> Column:
    """How a final patch meets the paths of the edits that aren't creations: the first class that holds. A null patch is empty."""
    paths = fn.patch_paths(F.coalesce(patch, F.lit("")))
    return fn.first_label(
        [(F.coalesce(patch, F.lit("")) == "", EMPTY), (F.arrays_overlap(paths, edited_not_created), ALIGNED), (F.size(edited_not_created) == 0, NO_EDIT)], DISJOINT
    )
