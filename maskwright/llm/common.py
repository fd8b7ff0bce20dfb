"""Shared pieces of the training-data operators: tables in the shared folder and hashing of byte words."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that belong to no word of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` become spaces; A-Z are lower-cased.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a folder of our own in local mode, and an error
    on a cluster, where each executor would write to its own disk."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or os.path.join(tempfile.gettempdir(), "maskwright-shared")).rstrip("/")


def materialize(df: DataFrame, name: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`materialize` that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sized(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """As :func:`materialize`, without the path."""
    return materialize(df, name)[0]


def trim() -> None:
    """Gives the memory that this process has freed back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def forget() -> None:
    """Drops the tokenizers that an earlier stage left in this worker: Spark's workers are used again, whatever the stage."""
    if (bpe := sys.modules.get("maskwright.llm.bpe")) and bpe.codec.cache_info().currsize:
        bpe.codec.cache_clear()
        gc.collect()  # it refers to itself
        trim()


def lean_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keep: bool = False) -> DataFrame:
    """``mapInArrow``, after which the workers keep no free memory, and in which they have no tokenizer but with ``keep``."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            forget()
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(lean, schema)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns of the input can't clash with ours."""
    return df.select(*(F.col(f"`{n}`") for n in names))
