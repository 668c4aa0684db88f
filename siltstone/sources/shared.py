"""Tables between steps: written once to the folder that the driver and all executors share, and read from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured row count times its row width stays below this.
BROADCAST_BYTES = 16 << 20


def folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where unset, a local one is set, but only if the executors are local too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="siltstone-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/siltstone-{uuid.uuid4().hex}/{name}"


def stage(rows: DataFrame, name: str) -> DataFrame:
    """The same rows from a table of their own: lineage is cut, and a lost executor loses nothing of it."""
    path = fresh(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Tasks for work that the size of its input does not tell: a few a core."""
    return 3 * spark.sparkContext.defaultParallelism


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """Rows of few bytes and much work each, dealt by key: a scan of them alone would be one task."""
    return rows.repartition(tasks(rows.sparkSession), *key)


def small_or_plain(rows: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the (already written) side is measured small; else none."""
    return F.broadcast(rows) if rows.count() * row_bytes <= limit else rows


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
