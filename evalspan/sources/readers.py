"""Scans of JSON lines, JSON objects, folders of them, XML reports and CSV: always with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> tuple[DataFrame, bool]:
    """The rows of a file of JSON lines and whether it exists; a missing file has no rows.

    Blank lines are skipped and extra fields ignored. A line that isn't an object of the schema, such as one written in
    part, fails the read: nothing is dropped. ``strict`` names the file and the number of the line in the error and adds
    ``_line_number``, at the cost of a count of lines; without it the read is one scan. ``bad_lines`` gives the broken
    lines themselves, for a quarantine.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if not exists(spark, path):
        empty = spark.createDataFrame([], schema)
        return (empty.withColumn("_line_number", F.lit(0).cast("long")) if strict else empty), False
    if not strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path), True
    fields, broken = _parsed(schema)
    where = F.concat(F.lit("not an object of the schema: "), "_file", F.lit(":"), F.col("_line_number").cast("string"))
    rows = numbered_lines(spark, path).withColumn("_o", F.when(broken, F.raise_error(where).cast(fields)).otherwise(_object(schema)))
    return rows.select(*[F.col(f"_o.`{f.name}`") for f in schema.fields], "_line_number"), True


def _object(schema: T.StructType) -> Column:
    extended = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    return F.from_json("value", extended, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def _parsed(schema: T.StructType) -> tuple[T.StructType, Column]:
    """The type of a parsed ``value`` and whether it isn't an object of the schema."""
    extended = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    return extended, _object(schema)["_bad"].isNotNull() | ~F.startswith(F.ltrim("value"), F.lit("{"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``_file``, ``_line_number`` (from 1) and ``value`` of each line that isn't blank.

    The numbers come from one small aggregation: the lines of each block of a file are counted, and a block starts where
    the ones before end, so no line is sorted or gathered.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = lines.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # the blocks of one file
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = lines.join(blocks, ["_file", "_block"]).withColumn("_line_number", F.col("_at") - F.col("_first") + F.col("_before") + 1)
    return numbered.where(F.trim("value") != "").select("_file", "_line_number", "value")


def bad_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Numbered lines that aren't JSON objects of the schema, for a report with line numbers."""
    return lines.where(_parsed(T._parse_datatype_string(schema))[1])


def read_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON object."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_objects(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """One row per file of a glob, with its path in ``_file``."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(pattern)
    return df.withColumn("_file", F.input_file_name())


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def test_report(spark: SparkSession, path: str) -> DataFrame:
    """Per report file the numbers of test cases, failures, errors and skipped ones, from its ``testcase`` rows."""
    schema = "_name string, failure string, error string, skipped string"
    cases = spark.read.format("xml").option("rowTag", "testcase").option("nullValue", "\u0000").schema(schema).load(path)
    cases = cases.withColumn("_file", F.input_file_name())

    def present(c: str) -> Column:
        return F.count(F.when(F.col(c).isNotNull(), 1))

    return cases.groupBy("_file").agg(F.count("*").alias("collected"), present("failure").alias("failures"), present("error").alias("errors"), present("skipped").alias("skipped"))


def report_counts(document: Column) -> Column:
    """The same numbers as a struct, for a whole report held in a column; null for null and for what isn't XML."""
    case = "struct<_name: string, failure: string, error: string, skipped: string>"
    cases = F.from_xml(document, f"testcase array<{case}>", {"nullValue": "\u0000"})["testcase"]

    def having(c: str) -> Column:
        return F.size(F.filter(cases, lambda t: t[c].isNotNull()))

    return F.struct(F.size(cases).alias("collected"), having("failure").alias("failures"), having("error").alias("errors"), having("skipped").alias("skipped"))


def report_verdict(report: DataFrame, requested: int) -> DataFrame:
    """``valid`` if as many ran as were requested and none was skipped; ``nonpassing`` counts failures and errors."""
    return report.withColumn("valid", (F.col("collected") == requested) & (F.col("skipped") == 0)).withColumn("nonpassing", F.col("failures") + F.col("errors"))


def byte_ranges(spark: SparkSession, size: int, chunk: int) -> DataFrame:
    """``(part, start, stop)`` of consecutive ranges of at most ``chunk`` bytes that cover ``size`` bytes."""
    if size < 0 or chunk <= 0:
        raise ValueError("size must be at least 0 and chunk positive")
    r = spark.range(-(-size // chunk))
    return r.select(F.col("id").alias("part"), (F.col("id") * chunk).alias("start"), F.least((F.col("id") + 1) * chunk, F.lit(size)).alias("stop"))
