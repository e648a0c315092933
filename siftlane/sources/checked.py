"""Logs with damaged lines: every line is kept, as a row or in quarantine, and counted.

A plain JSON read gives a row of nulls for a line it cannot read.  Here lines are read as text and
parsed once, beside the file they come from; batch and stream share the code.  A line is
damaged if it is no JSON, if a field has another type than the schema says, or if a field that
every record needs is missing.  Blank lines are no records.  Of a line with text behind its first
JSON value, the value counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlane import schemas

REQUIRED = ("session_id", "seq", "kind")
NOT_JSON, WRONG_TYPE, MISSING = "not JSON", "wrong type", "missing field"
_CORRUPT, _EXTRA = "_corrupt_record", ["_problem", "_line", "_file"]


def _checked(lines: DataFrame, schema: T.StructType, required: Sequence[str]) -> DataFrame:
    with_corrupt = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    record = F.from_json("_line", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    read = (lines.select(F.col("value").alias("_line"), F.col("_metadata.file_path").alias("_file"))
            .where(F.trim("_line") != "").withColumn("_record", record))
    unread = F.col(f"_record.{_CORRUPT}").isNotNull() | F.col("_record").isNull()
    missing = F.lit(False)
    for name in required:
        missing |= F.col("_record").getField(name).isNull()
    problem = (F.when(unread & F.try_parse_json("_line").isNull(), NOT_JSON).when(unread, WRONG_TYPE).when(missing, MISSING))
    return read.withColumn("_problem", problem).select(*[F.col("_record").getField(f.name).alias(f.name) for f in schema.fields], *_EXTRA)


def read_checked(spark: SparkSession, path: str, schema: T.StructType = schemas.CAPTURE, required: Sequence[str] = REQUIRED) -> DataFrame:
    """The records of a JSON-lines log with ``_problem`` (null for good ones), ``_line`` and ``_file``."""
    return _checked(spark.read.text(path), schema, required)


def stream_checked(spark: SparkSession, path: str, schema: T.StructType = schemas.CAPTURE, required: Sequence[str] = REQUIRED,
                   files_per_batch: int = 200) -> DataFrame:
    """The same over new files as they come."""
    return _checked(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path), schema, required)


def good_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("_problem").isNull()).drop(*_EXTRA)


def bad_lines(checked: DataFrame) -> DataFrame:
    """The quarantine: ``file, line, problem``; the lines are whole, so a repaired reader can take them again."""
    return checked.where(F.col("_problem").isNotNull()).select(F.col("_file").alias("file"), F.col("_line").alias("line"), F.col("_problem").alias("problem"))


def counted(checked: DataFrame, observation) -> DataFrame:
    """Count lines and problems while they are read: pass an ``Observation``, or a name for a stream's progress reports."""
    return checked.observe(observation, F.count("*").alias("lines"), *[
        F.count_if(F.col("_problem") == p).alias(p.replace(" ", "_").lower()) for p in (NOT_JSON, WRONG_TYPE, MISSING)])


def split_batches(good_path: str, quarantine_path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: good rows to one table and damaged lines to another, each micro-batch in a folder of its own, so that a replay overwrites."""
    def write(rows: DataFrame, number: int) -> None:
        good_rows(rows).write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        bad_lines(rows).write.mode("overwrite").parquet(f"{quarantine_path}/batch={number}")

    return write
