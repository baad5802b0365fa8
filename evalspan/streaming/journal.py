"""Streams of rollout events: resumed work, complete blocks only, and keyed progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """New parquet files under a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, at: str, group: str, width: str, late: str) -> DataFrame:
    """Counts and mean value per window and group; rows later than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), group).agg(F.count("*").alias("events"), F.avg("value").alias("mean_value"))


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return work.join(done.select(*keys), list(keys), "left_anti")


def complete_blocks(df: DataFrame, keys: Sequence[str], member: str, members: int) -> DataFrame:
    """Rows of the groups that have exactly the members 0 to ``members - 1``, once each: a live table's finished part."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(member).alias("d"), F.min(member).alias("lo"), F.max(member).alias("hi"))
    full = sizes.where((F.col("n") == members) & (F.col("d") == members) & (F.col("lo") == 0) & (F.col("hi") == members - 1))
    return df.join(full.select(*keys), list(keys), "left_semi")


def process_complete(stream: DataFrame, table: str, keys: Sequence[str], member: str, members: int, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Keep each batch, then hand over the blocks that it completed; runs until nothing new is there.

    Batches are kept under their number, so that a batch that runs again after a failure replaces itself.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        touched = batch.select(*keys).distinct()
        have = spark.read.option("basePath", table).parquet(table).where(F.col("batch") <= number).drop("batch")
        handle(complete_blocks(have.join(touched, list(keys), "left_semi"), keys, member, members), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PROGRESS = "task string, sample int, replicate int, next_step int, status string"
_STATE = "next_step int, waiting string"


def progress(stream: DataFrame, first: int, last: int) -> DataFrame:
    """Per rollout the earliest step still missing, whatever the order of arrival; steps seen twice count once.

    The state is the next step and the set of later ones that came early, at most ``last - first`` numbers.
    """

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, waiting = state.get if state.exists else (first, "")
        early = {int(x) for x in waiting.split(",") if x}
        for f in frames:
            early |= {int(x) for x in f["step"].dropna() if following <= x <= last}
        while following in early:
            early.discard(following)
            following += 1
        state.update((following, ",".join(map(str, sorted(early)))))
        status = "complete" if following > last else "ready" if not early else "gap"
        yield pd.DataFrame([(*key, following, status)], columns=["task", "sample", "replicate", "next_step", "status"])

    return stream.groupBy("task", "sample", "replicate").applyInPandasWithState(update, PROGRESS, _STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there into a table in memory; for tests and small reports."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
