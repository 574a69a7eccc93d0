"""Balanced contiguous shards by prefix sums of document sizes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import stored

#: Bytes of an entry besides its text.
OVERHEAD = 8


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size and CRC-32 of every row; a null text has no bytes."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"))


def in_blocks(rows: DataFrame, order: list[str], rows_per_block: int) -> DataFrame:
    """``rows`` dealt to blocks that follow each other in ``order``; written once, so that
    every later step sees the same blocks. Rows equal in ``order`` may lie in several
    neighbouring blocks: a row number splits them."""
    blocks = max(1, math.ceil(rows.count() / rows_per_block))
    dealt = (rows.withColumn("tie", F.monotonically_increasing_id())
             .repartitionByRange(blocks, *order, "tie").sortWithinPartitions(*order, "tie")
             .withColumn("block", F.spark_partition_id()))
    return stored(dealt)


def assign(docs: DataFrame, shards: int = 24, rows_per_block: int = 50_000) -> DataFrame:
    """Shard and place of every document under the law ``bytes``.

    Documents in the order of doc_id (then checksum) are laid end to end, and the line is
    cut at equal byte targets: a document belongs to the shard that holds its middle, so
    that a shard misses its target by half a document at each end at most. Sums are taken
    per block, the block totals (one row a block) get a running sum, and a window per
    block adds the rest; no window spans the table.

    Equal texts are separate entries: a group of copies larger than a shard could not stay
    whole under this law. Null or empty texts weigh OVERHEAD bytes; a null doc_id comes
    first; repeated rows are separate rows; an empty table gives no rows; other columns are
    not read.
    """
    rows = in_blocks(measured(docs), ["doc_id", "text_crc32"], rows_per_block)
    totals = rows.groupBy("block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("total"))
    inside = Window.partitionBy("block").orderBy("doc_id", "text_crc32", "tie")
    placed = (
        rows.join(starts, "block")
        .withColumn("end", F.col("bytes_before") + F.sum("size").over(
            inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("rank", F.col("n_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(
            f"cast((2 * cast(end as decimal(38,0)) - size) * {shards} div (2 * total) as int)")))
    placed = stored(placed.select("doc_id", "size", "text_crc32", "shard", "rank"))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """The documents as one folder per shard. Rows of one id lie in one shard or, at a cut,
    in neighbours; the checksum tells them apart."""
    places = assign(docs, shards).groupBy(F.col("doc_id").alias("_id"), F.col("text_crc32").alias(
        "_crc")).agg(F.min("shard").alias("_shard"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.crc32(raw) == F.col("_crc"))
    (docs.join(places, same).drop("_id", "_crc").write.partitionBy("_shard")
     .mode("overwrite").parquet(path))
