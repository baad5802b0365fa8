"""Runs of identical or nearly identical consecutive events in ordered sequences.

Events of an entity are split into chunks of consecutive step numbers, so an entity of any length is spread over many
tasks. The last possible neighbour of a chunk is carried over by copying each event at a chunk's end into the next
chunk. Run starts are found against the step before; their positions go into one sorted array per chunk, every event
finds its run by binary search in that array, and the events are summed by run. A run that began in an earlier chunk
gets its start from the largest start before the chunk; an entity has at most 2^32 / CHUNK chunks, since a step is a
32-bit number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Workspace

#: Steps in a chunk; bounds the arrays. 2^32 / 4096 chunks of one entity at most.
CHUNK = 4096
#: Edits between two sources that still count as near.
MAX_EDITS = 3


def bare_text(source: Column) -> Column:
    """The letters and digits of a text in lower case, without white space, punctuation and underscores."""
    return F.lower(F.regexp_replace(source, r"[^\p{L}\p{N}]+", ""))


def near(text_a: Column, hash_a: Column, text_b: Column, hash_b: Column, max_edits: int = MAX_EDITS) -> Column:
    """Whether two events are the same or near: at most ``max_edits`` characters apart; where a text is null, equal
    hashes in either letter case. Unknown (a text and the other hash missing) counts as different."""
    by_text = (text_a == text_b) | (
        (F.abs(F.length(text_a) - F.length(text_b)) <= max_edits)
        & (F.levenshtein(text_a, text_b, max_edits) >= 0)
    )
    by_hash = F.lower(hash_a) == F.lower(hash_b)
    both = text_a.isNotNull() & text_b.isNotNull()
    return F.coalesce(F.when(both, by_text).otherwise(by_hash), F.lit(False))


def _with_previous(df: DataFrame, keys: Sequence[str], step: str, tie: Sequence[str], chunk: int) -> DataFrame:
    """One row per step, the fullest one, with the step before it in columns ``_p_*``; one shuffle by entity chunk."""
    number = F.col(step).cast("long")
    own = F.floor(number / F.lit(chunk)).cast("long")
    last = F.pmod(number, F.lit(chunk)) == chunk - 1
    spread = df.withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.when(last, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))
    )
    missing = F.col("_text").isNull().cast("int") * 2 + F.col("_hash").isNull().cast("int")
    order = Window.partitionBy(*keys, "_chunk").orderBy(step, missing, *tie)
    distinct = spread.withColumn("_again", F.lag(step).over(order)).where(f"not (_again <=> `{step}`)")
    for c, name in ((step, "_p_step"), ("_text", "_p_text"), ("_hash", "_p_hash")):
        distinct = distinct.withColumn(name, F.lag(c).over(order))
    return distinct.where("_own = _chunk").drop("_own", "_again")


def run_start_of(starts: Column, step: Column) -> Column:
    """The largest element of the sorted array that isn't above ``step``, by binary search; null if there is none."""
    size = F.size(starts)
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(size + F.lit(1))).cast("int"))

    def halve(state: Column, _: Column) -> Column:
        lo, hi = state["lo"], state["hi"]
        middle = F.floor((lo + hi + 1) / 2).cast("int")
        right = F.get(starts, middle - 1) <= step
        return (
            F.when(lo >= hi, state)
            .when(right, F.struct(middle.alias("lo"), hi.alias("hi")))
            .otherwise(F.struct(lo.alias("lo"), (middle - 1).alias("hi")))
        )

    found = F.aggregate(halvings, F.struct(F.lit(0).alias("lo"), size.alias("hi")), halve, lambda s: s["lo"])
    return F.when(found > 0, F.get(starts, found - 1))


def collapse_runs(
    df: DataFrame,
    keys: Sequence[str],
    step: str,
    text: str,
    digest: str,
    at: str,
    tie: Sequence[str],
    work: Workspace,
    max_edits: int = MAX_EDITS,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per run: the keys, ``first_step``, ``last_step``, ``steps``, ``started_at`` and ``seconds``.

    A run is a longest stretch of consecutive step numbers of which each is the same as or near the one before. A step
    recorded twice counts once (the fullest, then earliest record). Rows without a step have no place in the sequence
    and are left out; null keys form an entity of their own. An event without a time counts, but doesn't extend the
    duration; ``seconds`` is null if no event of the run has a time. Other columns are ignored; keys mustn't have the
    names of the result's columns or begin with an underscore.
    """
    rows = df.where(F.col(step).isNotNull()).select(
        *keys, step, *[c for c in dict.fromkeys([at, *tie]) if c not in keys and c != step],
        bare_text(F.col(text)).alias("_text"), F.col(digest).alias("_hash"),
    )
    before = _with_previous(rows, keys, step, list(dict.fromkeys([at, *tie])), chunk)
    joined = (F.col("_p_step") == F.col(step) - 1) & near(
        F.col("_text"), F.col("_hash"), F.col("_p_text"), F.col("_p_hash"), max_edits
    )
    marked = before.select(*keys, "_chunk", step, at, (~F.coalesce(joined, F.lit(False))).alias("_start"))
    chunks = marked.groupBy(*keys, "_chunk").agg(
        F.sort_array(F.collect_list(F.when(F.col("_start"), F.col(step)))).alias("_starts"),
        F.collect_list(F.struct(F.col(step).alias("_s"), F.col(at).alias("_t"))).alias("_events"),
    )
    events = chunks.select(*keys, "_chunk", "_starts", F.explode("_events").alias("_e")).select(
        *keys, "_chunk", run_start_of(F.col("_starts"), F.col("_e._s")).alias("_run"), "_e._s", "_e._t"
    )
    parts = events.groupBy(*keys, "_chunk", "_run").agg(
        F.max("_s").alias("_last"), F.count("*").alias("_steps"), F.min("_t").alias("_a"), F.max("_t").alias("_b")
    )
    parts = work.write(parts, "parts")
    # what continues a run of an earlier chunk takes the largest start before its chunk
    heads = parts.groupBy(*keys, "_chunk").agg(F.max("_run").alias("_newest"), F.bool_or(F.col("_run").isNull()).alias("_open"))
    before_chunk = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.withColumn("_carry", F.max("_newest").over(before_chunk)).where("_open")
    c = carried.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_c"), "_carry")
    open_parts = parts.where("_run is null").join(
        c, [*[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_chunk") == F.col("_c")]
    )
    named = parts.where("_run is not null").unionByName(open_parts.withColumn("_run", F.col("_carry")).select(*parts.columns))
    return (
        named.groupBy(*keys, "_run")
        .agg(F.max("_last").alias("last_step"), F.sum("_steps").alias("steps"), F.min("_a").alias("started_at"), F.max("_b").alias("_ended"))
        .withColumn("seconds", F.expr("timestampdiff(MICROSECOND, started_at, _ended)") / 1e6)
        .withColumnRenamed("_run", "first_step")
        .select(*keys, "first_step", "last_step", "steps", "started_at", "seconds")
    )
