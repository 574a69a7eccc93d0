"""Chat rendering by perspective rotation: each speaker once as the assistant."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.sharding import in_blocks

SYSTEM, UNNAMED = "system", "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _body(text: Column) -> Column:
    """The text with the opening of any marker it holds itself broken up."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(role: Column, speaker: Column) -> Column:
    return F.when(role == SYSTEM, F.lit(f"{OPEN}{SYSTEM}\n")).when(
        role == speaker, F.lit(f"{OPEN}assistant\n")).otherwise(
        F.concat(F.lit(f"{OPEN}user name="), role, F.lit("\n")))


def rotations(turns: DataFrame, rows_per_block: int = 50_000) -> DataFrame:
    """Every conversation once per speaker, one row per turn.

    Columns: conv_id, speaker, place (from 0), turn, role, segment (the rendered turn),
    start and length of the segment in the rendered conversation, mask_start and
    mask_length of the part that is learned from (the speaker's own words and the closing
    mark; length 0 elsewhere), all in characters. The segments of a conversation and
    speaker, in order of place, are its rendering.

    Turns are ordered by turn, role and MD5 of the text; nulls come first. Exactly repeated
    rows are one turn. A null role is the speaker ``unknown``; ``system`` turns are no
    one's: they stay system turns in every rotation, and a conversation of these alone has
    no rotation. A null text is empty. A null conv_id is a conversation like any other. An
    empty table gives no rows; other columns are not read.

    Starts are differences of running sums over all rows, taken per block of a sort, so a
    conversation of any length spreads over blocks; only lengths are sorted, and each text
    is shuffled once.
    """
    key = ["conv_id", "turn", "role", "text_key"]
    said = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(UNNAMED)).alias("role"),
        _body(F.col("text")).alias("body")).withColumn("text_key", F.md5("body"))
    said = said.dropDuplicates(key)
    sizes = said.select(*key, F.length("body").alias("size"))
    speakers = sizes.where(F.col("role") != SYSTEM).select(
        F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    rows = sizes.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").withColumn(
        "length", F.length(_head(F.col("role"), F.col("speaker"))) + F.col("size")
        + len(CLOSE) + 1)
    blocks = in_blocks(rows, ["conv_id", "speaker", "turn", "role", "text_key"], rows_per_block)
    totals = blocks.groupBy("block").agg(F.sum("length").alias("chars"), F.count("*").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before")
                                      for c in ("chars", "n")])
    inside = Window.partitionBy("block").orderBy("conv_id", "speaker", "turn", "role", "text_key")
    placed = blocks.join(starts, "block").withColumn(
        "from", F.col("chars_before") + F.sum("length").over(
            inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).withColumn(
        "nth", F.col("n_before") + F.row_number().over(inside) - 1)
    begins = placed.groupBy(F.col("conv_id").alias("c"), F.col("speaker").alias("s")).agg(
        F.min("from").alias("begin"), F.min("nth").alias("first"))
    placed = placed.join(begins, F.col("conv_id").eqNullSafe(F.col("c"))
                         & (F.col("speaker") == F.col("s"))).select(
        *[F.col(k).alias(f"_{k}") for k in key], "speaker", "length",
        (F.col("from") - F.col("begin")).alias("start"),
        (F.col("nth") - F.col("first")).alias("place"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key))
    head = _head(F.col("role"), F.col("speaker"))
    own = F.col("role") == F.col("speaker")
    return said.join(placed, same).select(
        "conv_id", "speaker", F.col("place").cast("long"), "turn", "role",
        F.concat(head, "body", F.lit(f"{CLOSE}\n")).alias("segment"),
        F.col("start").cast("long"), F.col("length").cast("long"),
        F.when(own, F.col("start") + F.length(head)).otherwise(F.col("start"))
        .cast("long").alias("mask_start"),
        F.when(own, F.length("body") + len(CLOSE)).otherwise(0).cast("long").alias("mask_length"))


#: The same rows for the table ``conversations``.
SQL = """
with said as (
  select distinct conv_id, turn, coalesce(role, 'unknown') as role,
         replace(coalesce(text, ''), '<|', '< |') as body
  from conversations),
speakers as (select distinct conv_id, role as speaker from said where role <> 'system'),
headed as (
  select said.conv_id, speaker, turn, role, body, md5(body) as text_key,
         case when role = 'system' then '<|im_start|>system' || chr(10)
              when role = speaker then '<|im_start|>assistant' || chr(10)
              else '<|im_start|>user name=' || role || chr(10) end as head
  from said join speakers on said.conv_id is not distinct from speakers.conv_id),
sized as (
  select *, head || body || '<|im_end|>' || chr(10) as segment,
         length(head) + length(body) + 11 as length
  from headed),
placed as (
  select *, row_number() over w - 1 as place,
         coalesce(sum(length) over (w rows between unbounded preceding and 1 preceding), 0) as start
  from sized
  window w as (partition by conv_id, speaker
               order by turn nulls first, role, text_key))
select conv_id, speaker, cast(place as bigint) as place, turn, role, segment,
       cast(start as bigint) as start, cast(length as bigint) as length,
       cast(case when role = speaker then start + length(head) else start end as bigint) as mask_start,
       cast(case when role = speaker then length(body) + 10 else 0 end as bigint) as mask_length
from placed
"""
