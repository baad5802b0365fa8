"""Session defaults for local runs; on a cluster the submitted settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings of a local session. A cluster passes its own, larger figures.
LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def local_session(cores: int | str = 8, **extra: str) -> SparkSession:
    """A session on ``local[cores]`` with the defaults above, overridden by ``extra``."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("evalspan")
    for key, value in {**LOCAL_DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
