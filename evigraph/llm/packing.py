"""Packing token sequences by minimum bin slack over remaining lengths."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import mapped, stored
from evigraph.llm.tokens import word_tokenizer

CAPACITY = 4096
END_ID = 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
           end_id: int = END_ID) -> DataFrame:
    """Every document's ids, with ``end_id`` after them, cut at multiples of ``capacity``."""
    step = 4 * capacity
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = word_tokenizer(tokenizer_path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = encode(text.as_py() or "") + end
                for at in range(0, len(raw), step):
                    piece = raw[at:at + step]
                    for column, value in zip(out, (doc_id, at // 4, len(piece) // 4,
                                                   zlib.crc32(piece), len(raw) // 4)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        encode.forget()

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), cut, PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the multisets within ``counts`` (length to number left), one whose sum comes
    closest to ``room`` from below.

    Bit s of ``sums`` says that the lengths seen so far reach s. A length's number is taken
    in powers of two, and the bits before each step stay for the way back: where bit s was
    not set before the step, the step's copies belong to the answer.
    """
    mask = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            part = min(part, left)
            grown = sums | (sums << (length * part)) & mask
            if grown != sums:
                steps.append((length, part, sums))
                sums = grown
            left, part = left - part, part * 2
        if sums >> room & 1:
            break
    at, chosen = sums.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + part
            at -= length * part
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """How the pieces of each length fill the sequences.

    Each window opens with the longest length left and takes the multiset that fills it
    best; the same filling repeats while the numbers allow. Rows: length, first rank of
    that length, copies in one sequence, sequences, first sequence, offset of the first
    copy; in order of length and rank. At most a few rows per distinct length and filling,
    however many pieces there are.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        filling = fullest(left, capacity - longest)
        left[longest] += 1
        filling[longest] = filling.get(longest, 0) + 1
        times = min(left[k] // m for k, m in filling.items())
        offset = 0
        for length in sorted(filling, reverse=True):
            m = filling[length]
            rows.append((length, used[length], m, times, sequence, offset))
            offset += m * length
            used[length] += m * times
            left[length] -= m * times
            if not left[length]:
                del left[length]
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
         end_id: int = END_ID) -> DataFrame:
    """The sequence and offset of every piece of every document.

    Documents longer than a sequence are cut at multiples of the capacity; what remains of
    each is one piece. Only the number of pieces per length, at most ``capacity`` numbers,
    comes to the driver, where the plan is made. A piece finds its place through its rank
    among the pieces of its length: ranks are local to a block (one written partition),
    plus the running totals of the blocks before it, so no task holds a length's pieces.

    A null or empty text is the end id alone; repeated rows and ids are separate pieces; a
    null doc_id stays null; an empty table gives no rows; other columns are not read.
    """
    rows = stored(pieces(docs, tokenizer_path, capacity, end_id)
                  .withColumn("block", F.spark_partition_id())
                  .withColumn("tie", F.monotonically_increasing_id()))
    totals = rows.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = totals.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0))
                           .alias("before"))
    histogram = totals.groupBy("length").agg(F.sum("n").alias("n")).collect()
    places = plan({r["length"]: r["n"] for r in histogram}, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        # One sort key for (length, rank): ranks stay below the largest one used.
        span = int((table[:, 1] + table[:, 2] * table[:, 3]).max(initial=0)) + 1
        keys = table[:, 0] * span + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy()
                            for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length * span + rank, "right") - 1]
            nth = rank - row[:, 1]
            columns = [batch.column(i) for i in range(5)]
            columns += [pa.array(row[:, 4] + nth // row[:, 2]),
                        pa.array(row[:, 5] + nth % row[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in (
                PIECES + ", sequence_id long, offset long").split(", ")])

    inside = Window.partitionBy("block", "length").orderBy("tie")
    ranked = rows.withColumn("nth", F.row_number().over(inside) - 1).join(
        starts, ["length", "block"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("nth") + F.col("before")).alias("rank"))
    return mapped(ranked, place, PIECES + ", sequence_id long, offset long")
