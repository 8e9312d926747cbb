"""Op 9. Contiguous shards of nearly equal bytes, by global prefix sums from per-partition totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import documents, partitions, written


def with_prefix_sums(rows: DataFrame, order: list[str], value: str, prefix: str = "before", rank: str = "row") -> DataFrame:
    """rows with `prefix`, the sum of `value` over all rows before this one, and `rank`, their number, in the order of `order`.

    One range exchange and a sort give ordered partitions, which are written once, so each row keeps its partition. A small
    table of one row for each partition turns the totals into offsets; within a partition a running sum does the rest. No task
    sees more than its own range, and rows that tie in `order` are split over tasks only if `order` ends in something that differs.
    """
    spark = rows.sparkSession
    part = "partition_of_range"
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id())
    dealt = written(dealt, "ranges")
    totals = dealt.groupBy(part).agg(F.sum(value).alias("sum_of_range"), F.count(F.lit(1)).alias("rows_of_range"))
    past = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = totals.select(part, *(F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"{c}_before") for c in ("sum_of_range", "rows_of_range")))
    own = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({prefix: F.coalesce(F.sum(value).over(own), F.lit(0)), rank: F.count(F.lit(1)).over(own)})
    local = local.join(F.broadcast(offsets), part)  # as many rows as there are partitions
    return local.withColumns({prefix: F.col(prefix) + F.col("sum_of_range_before"), rank: F.col(rank) + F.col("rows_of_range_before")}).drop(part, "sum_of_range_before", "rows_of_range_before")


def shard_by_bytes(docs: DataFrame, shards: int, size: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, size, the extra columns, shard and slot: contiguous runs of ascending doc_id with nearly equal sums of size.

    A document goes to the shard in whose equal share of the bytes its middle byte lies, so a shard's bytes differ from the
    share by one document at most. slot counts from 0 within the shard. Null doc_ids come first; rows with equal doc_id are
    ordered by text checksum and size. size must be positive; an empty table gives no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), *((v.alias(k)) for k, v in (extra or {}).items()))
    summed = with_prefix_sums(slim, ["doc_id", "text_crc32", "size"], "size")
    total = summed.agg(F.sum("size").alias("all_bytes"))
    placed = summed.crossJoin(F.broadcast(total))  # one row
    middle = (F.col("before") * 2 + F.col("size")) * shards / (F.col("all_bytes") * 2)
    placed = placed.withColumn("shard", F.least(F.floor(middle), F.lit(shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("row") - F.col("first_row")).drop("before", "row", "first_row", "all_bytes")


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    placed = shard_by_bytes(documents(spark, sf_dir), 8, size)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


