"""Session for tests and local runs; on a cluster the caller brings its own."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("schedlake")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SCHEDLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_FOLDER: list[str] = []


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        if not _LOCAL_FOLDER:
            _LOCAL_FOLDER.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = _LOCAL_FOLDER[0]
    return f"{base.rstrip('/')}/schedlake/{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder all executors see: under spark.checkpoint.dir, or local where that is unset and so is the master."""
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def drop_written(spark: SparkSession) -> None:
    """Deletes what this application wrote to the shared folder; results that read it must have been used by then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_base(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: read by several branches, computed once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_A_TASK = 500_000  # of tables that pack so well that a task sized by bytes would hold many millions
SENT_ROWS = 500_000  # beyond so many rows a table is shuffled, however small its files


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The rows by key in so many tasks that each has a bounded number of them; Spark sizes tasks by packed bytes."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, rows // ROWS_A_TASK)
    return df.repartition(tasks, *keys)


def met(df: DataFrame, other: DataFrame, keys: list[str], rows: int, sent: int) -> DataFrame:
    """Inner join of ``rows`` with a table of ``sent``, which goes to every task only while it is short."""
    return df.join(other, keys) if sent <= SENT_ROWS else dealt(df, keys, rows).join(other.hint("merge"), keys)
