"""Materialisation in the shared folder, skew-safe joins and small plan helpers.

Intermediate results that are read more than once are written as parquet to the folder the cluster names in
``spark.checkpoint.dir``: a written table survives lost executors, keeps no copy in executor memory and gives the
optimiser exact sizes for its next choice of join.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
_LOCAL: list[str] = []
_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, or for a local master a temporary folder.

    Raises on a cluster that names no folder, since a machine-local one would be invisible to the executors.
    """
    folder = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"set {_CONF} to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="evalspan-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="evalspan-code-")  # read by the driver only, which sends it on
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "evalspan_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))


class Workspace:
    """Tables of one query under the shared folder; its results may be read while the application lives."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/evalspan-{name}-{uuid.uuid4().hex}"
        self.written: dict[str, str] = {}
        if self.root.startswith(("file:", "/")):  # elsewhere the folder's owner clears what ended applications left
            atexit.register(shutil.rmtree, "/" + self.root.removeprefix("file:").lstrip("/"), ignore_errors=True)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as parquet and return the table read back; this cuts the lineage."""
        path = f"{self.root}/{len(self.written)}-{name}" if name not in self.written else f"{self.root}/{uuid.uuid4().hex}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        self.written[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def write_bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """Write ``df`` once in buckets of a key, one file each, and return the table: a join on that key then shuffles
        the other side only. There are as many buckets as shuffle partitions, which the cluster sets by its input."""
        path = f"{self.root}/{len(self.written)}-{name}"
        table = f"evalspan_{name.replace('-', '_')}_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        placed = df.repartition(buckets, key)
        placed.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
        self.written[name] = path
        atexit.register(_forget, self.spark, table)
        return self.spark.table(table)

    def release(self) -> None:
        """Let the driver collect its garbage: only then Spark deletes the shuffle files of plans that have ended."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str) -> None:
        """Delete the table last written under a name; no later plan may read it."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.written[name])
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _forget(spark: SparkSession, table: str) -> None:
    """Take a table out of the catalogue at the end of the application, if the session still lives."""
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def skew_safe_join(edges: DataFrame, values: DataFrame, key: str, heavy: DataFrame | None) -> DataFrame:
    """Inner join of ``edges`` with one row per key in ``values``, where some keys hold very many edges.

    ``heavy`` holds the rows of ``values`` for the keys above a stated share of all edges, so their number is bounded
    by the inverse of that share, and they are broadcast; every other key goes through an ordinary join.
    """
    if heavy is None:
        return edges.join(values, key)
    marked = edges.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), key, "left")
    hot = marked.where("_heavy").drop("_heavy")
    rest = marked.where("_heavy is null").select(*edges.columns).join(values, key)
    return hot.unionByName(rest)
