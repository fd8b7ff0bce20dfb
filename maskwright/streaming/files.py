"""Rules on a folder of files that grows: the same projection, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from maskwright.operators.anonymize import column_infos, plan_table, transform
from maskwright.plans.config import Config, resolve_key
from maskwright.plans.shared import shared_path


def anonymize_stream(spark: SparkSession, source: str, table: str, config: Config, key: bytes | None = None) -> DataFrame:
    """A stream of the parquet files that come to ``source``, with the rules of ``table`` applied; it keeps no state.

    Unique columns are refused: what one batch may use depends on all before.
    """
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    plan = plan_table(table, column_infos(stream), config)
    if any(i.unique and plan.rules[c].kind == "preset" for c, i in plan.infos.items()):
        raise ValueError("unique columns can not be streamed")
    return transform(stream, plan, resolve_key(config) if key is None else key)


def start(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there now and ends; called again it goes on where it stopped."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(spark: SparkSession, source: str, out: str, table: str, config: Config, key: bytes | None = None, checkpoint: str | None = None) -> DataFrame:
    """All files there are, as a table."""
    query = start(anonymize_stream(spark, source, table, config, key), out, checkpoint or shared_path(spark, "stream"))
    query.awaitTermination()
    return spark.read.parquet(out)
