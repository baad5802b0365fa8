"""Sinks: sorted-key JSON lines, keyed journals, atomic replacement, whitelisted exports and manifests."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as JSON with its keys in order, nulls kept: equal rows give equal bytes."""
    row = F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, order: Sequence[str] = (), overwrite: bool = False) -> None:
    """Sorted-key JSON lines, ordered by range over the files; fails if the path exists unless told otherwise."""
    ordered = df.orderBy(*order) if order else df
    json_lines(ordered).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def export_public(df: DataFrame, fields: Sequence[str], path: str, expected: int | None = None) -> int:
    """Write the whitelisted columns only and return the number of rows; fails on a missing column or another number."""
    missing = [c for c in fields if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    df.select(*fields).write.mode("errorifexists").parquet(path)
    rows = df.sparkSession.read.parquet(path).count()
    if expected is not None and rows != expected:
        raise ValueError(f"{rows} rows, {expected} expected")
    return rows


def append_journal(df: DataFrame, path: str, keys: Sequence[str], batch: str) -> None:
    """Append the rows whose keys the journal hasn't yet, as one batch that a repeated call replaces.

    A batch is a folder of its own that appears at once with the commit of its job.
    """
    spark = df.sparkSession
    target = f"{path}/batch={batch}"
    p, fs = _fs(spark, path)
    known = None
    if fs.exists(p) and len(fs.listStatus(p)):
        known = spark.read.option("basePath", path).parquet(path).where(F.col("batch").cast("string") != batch).select(*keys)
    rows = df.dropDuplicates(list(keys))
    if known is not None:
        rows = rows.join(known.distinct(), list(keys), "left_anti")
    replace(rows, target)


def read_journal(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """All rows of a journal; fails if a key occurs twice."""
    df = spark.read.option("basePath", path).parquet(path)
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("the journal holds a key twice")
    return df


def replace(df: DataFrame, path: str) -> None:
    """Write beside the path, put the old table aside, rename, and delete the old one last.

    At any time one of the two tables is whole on disk; if the second rename fails, the old table is put back.
    """
    spark = df.sparkSession
    fresh = f"{path}.{uuid.uuid4().hex}.tmp"
    df.write.parquet(fresh)
    new, fs = _fs(spark, fresh)
    old, _ = _fs(spark, path)
    aside, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.old")
    fs.mkdirs(old.getParent())
    existed = fs.exists(old)
    if existed and not fs.rename(old, aside):
        raise OSError(f"can't put {path} aside")
    if not fs.rename(new, old):
        if existed:
            fs.rename(aside, old)
        raise OSError(f"can't rename {fresh}")
    if existed:
        fs.delete(aside, True)


def content_digest(df: DataFrame) -> str:
    """SHA-256 over a table's content whatever the order of its rows: a digest of sums of row digests.

    Rows are hashed where they are; five parts of each digest are added up exactly, so nothing is gathered.
    """
    rows = json_lines(df).select(F.sha2("value", 256).alias("d"))
    parts = [F.conv(F.substring("d", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(5)]
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)]).first()
    return hashlib.sha256(json.dumps([str(x) for x in sums]).encode()).hexdigest()


def manifest(protocol: str, parameters: Mapping, tables: Mapping[str, DataFrame]) -> dict:
    """Protocol, parameters, and of each table the columns, the number of rows and the content's digest."""
    return {
        "protocol": protocol, "parameters": dict(sorted(parameters.items())),
        "tables": {n: {"columns": df.dtypes, "rows": df.count(), "sha256": content_digest(df)} for n, df in sorted(tables.items())},
    }


def check_manifest(saved: Mapping, tables: Mapping[str, DataFrame]) -> list[str]:
    """Names of the tables whose content isn't that of the manifest any more, or that only one side has."""
    now = {n: content_digest(df) for n, df in tables.items()}
    then = {n: t["sha256"] for n, t in saved["tables"].items()}
    return sorted(n for n in {*now, *then} if now.get(n) != then.get(n))


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """SHA-256 and size of each file, hashed where it is read."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.sha2("content", 256).alias("sha256"))
