"""Contiguous shards of near equal bytes: global prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskwright.llm.common import only, sized


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: documents in id order, cut where the running size passes equal targets.

    ``size`` is the text's UTF-8 length plus 1. A document goes where the middle of its bytes falls, so no shard is off its
    target by more than one document's size. Null texts have size 1 and crc32 0; null ids come first; rows with one id are
    ordered by checksum and size, and rows equal in all of these are interchangeable. An empty table gives no rows; other
    columns are ignored.

    Only ids, sizes and checksums are shuffled, once by range. The sorted rows are written with their partition number, since
    sampled range bounds may differ when recomputed; running sums are kept within a partition, and one row of totals for
    each partition gives every partition its offset.
    """
    spark = docs.sparkSession
    raw = F.col(text_col).cast("binary")
    rows = only(docs, id_col, text_col).select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0).cast("long")).alias("text_crc32"),
    )
    ranged = rows.repartitionByRange("doc_id", "text_crc32", "size").withColumn("part", F.spark_partition_id())
    held = sized(spark, ranged, "shards")
    totals = held.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(  # one row for each partition, not for each document
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(W.partitionBy()).alias("total"),
    )
    within = W.partitionBy("part").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = held.select("*", F.sum("size").over(within).alias("upto"), F.row_number().over(W.partitionBy("part").orderBy("doc_id", "text_crc32", "size")).alias("nth"))
    placed = summed.join(offsets, "part").select(
        "doc_id", "size", "text_crc32",
        F.expr(f"cast(least({shards - 1}, ((2 * (bytes_before + upto) - size) * {shards}) div (2 * total)) as int)").alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("row"),
    )
    placed = sized(spark, placed, "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def op10_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 of near equal size."""
    out = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 * (n & 1)
        table.append(n)
    return table


SQL = {
    "op10_byte_shards": f"""
with d as (select doc_id, octet_length(coalesce(encode(text), ''::blob)) as n, hex(coalesce(encode(text), ''::blob)) as h from documents),
c as (select doc_id, n + 1 as size, xor(4294967295, list_reduce(
        list_transform(regexp_extract_all(h, '..'), lambda x: cast('0x' || x as bigint)),
        lambda crc, b: xor(crc >> 8, ({_crc_table()}::bigint[])[cast(xor(crc, b) & 255 as integer) + 1]), 4294967295::bigint)) as text_crc32 from d),
s as (select *, sum(size) over (order by doc_id rows unbounded preceding) as upto, sum(size) over () as total,
             row_number() over (order by doc_id) - 1 as row from c),
p as (select *, least(15, ((2 * upto - size) * 16) // (2 * total)) as shard from s)
select doc_id, cast(size as bigint) as size, text_crc32, 'bytes' as law, cast(shard as integer) as shard,
       cast(row - min(row) over (partition by shard) as bigint) as slot, cast(null as integer) as grown_shard
from p"""
}
