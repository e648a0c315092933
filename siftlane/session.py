"""Session settings used by tests and benchmarks; a cluster brings its own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", app: str = "siftlane") -> SparkSession:
    """A local session with the settings the operators expect."""
    return (SparkSession.builder.master(f"local[{cores}]").appName(app)
            .config("spark.sql.shuffle.partitions", str(partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", memory)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="siftlane-")
    return _LOCAL_DIRS[spark.sparkContext.applicationId]


def store(df: DataFrame, name: str = "table") -> str:
    """Write a table to a new place in the shared folder and return its path."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/siftlane/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Store a table that several later branches read, and read it back.

    The copy is columnar, so branches prune and push down, and it outlives lost executors.
    """
    return df.sparkSession.read.schema(df.schema).parquet(store(df, name))


def stored_by(df: DataFrame, key: str, name: str = "table") -> DataFrame:
    """Store a table in as many buckets of a key as there are shuffle partitions; joins on the key then leave it where it lies.

    Each task writes a file for every bucket that it has rows of, so this is for few large rows. The session's catalog knows the table.
    """
    spark = df.sparkSession
    number, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"siftlane_{name}_{uuid.uuid4().hex}"
    (df.write.format("parquet").bucketBy(number, key)
     .option("path", f"{ensure_checkpoint_dir(spark)}/siftlane/{table}").saveAsTable(table))
    return spark.table(table)
