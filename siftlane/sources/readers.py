"""Readers for capture, page and trace data.

Schemas are fixed, so no reader scans data to infer one.  Formats: ``json`` (one record per
line), ``parquet``, ``orc``.  Parquet and ORC also push filters and prune columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlane import schemas


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan with fewer splits than cores before per-row Python work.

    A large input has more splits than cores and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_capture(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Requests and responses; see ``schemas.CAPTURE``."""
    return _read(spark, path, schemas.CAPTURE, fmt)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captured page frames.  Columns a source lacks come out null; a missing
    ``frame_index`` means the top frame."""
    return _read(spark, path, schemas.PAGES, fmt).withColumn("frame_index", F.coalesce("frame_index", F.lit(0)))


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """A directory of HTML files, one row per file; ``url`` is the file's address."""
    return (spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")))


def read_storage(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _read(spark, path, schemas.STORAGE, fmt)


def read_mutations(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _read(spark, path, schemas.MUTATIONS, fmt)


def read_calls(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _read(spark, path, schemas.CALLS, fmt)


def read_listeners(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _read(spark, path, schemas.LISTENERS, fmt)


def read_stylesheets(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _read(spark, path, schemas.STYLESHEETS, fmt)


def _stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str, files_per_batch: int) -> DataFrame:
    # The file limit bounds what one micro-batch, and so one key in it, can hold.
    return (spark.readStream.schema(schema).format(fmt)
            .option("maxFilesPerTrigger", files_per_batch).load(path))


def stream_capture(spark: SparkSession, path: str, fmt: str = "json", files_per_batch: int = 200) -> DataFrame:
    """The capture log as a stream of new files."""
    return _stream(spark, path, schemas.CAPTURE, fmt, files_per_batch)


def stream_pages(spark: SparkSession, path: str, fmt: str = "json", files_per_batch: int = 200) -> DataFrame:
    """Captured pages as a stream of new files."""
    return _stream(spark, path, schemas.PAGES, fmt, files_per_batch)
