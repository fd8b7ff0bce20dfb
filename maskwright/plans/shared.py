"""Tables in the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a folder of our own in local mode; on a cluster that is an error, since each
    executor would write to its own disk."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or os.path.join(tempfile.gettempdir(), "maskwright-shared")).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out to all cores. A file of one row group is read by one task, which would also make all that is made of its rows."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage by writing the table and reading it back; it survives lost executors."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As :func:`written`, with the path."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
