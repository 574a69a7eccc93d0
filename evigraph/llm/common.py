"""Reading tables, cutting lineage and walking text batches."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that one step of a task turns into arrays; bounds the memory of a worker.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="evigraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: a lineage cut that
    outlives lost executors. The files stay until the folder is emptied by its owner."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/evigraph-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context."""
    context = spark.sparkContext
    if getattr(context, "_evigraph_sent", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="evigraph-code-"), "evigraph_code.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    context._evigraph_sent = True


def mapped(df: DataFrame, fn: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def held_out(doc_id: Column) -> Column:
    """The documents no classifier may learn from: CRC-32 of the id's digits, mod 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def text_steps(batch: pa.RecordBatch, column: int = 0,
               size: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``size`` text bytes: first row, row after the last, the UTF-8
    bytes of their texts in one array, and where each text starts in it (and the last ends).
    A null text has no bytes."""
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    _, starts, data = texts.buffers()
    starts = np.frombuffer(starts, dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, last, data[starts[first]:starts[last]], starts[first:last + 1] - starts[first]
        first = last


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, pa.Table]]:
    """The groups of a stream that is sorted by its first column, whole, with their names."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        names = np.asarray(batch.column(0).to_pylist(), object)
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if held and names[a] != name:
                    yield name, pa.Table.from_batches(held)
                    held = []
                name = names[a]
                held.append(batch.slice(a, b - a))
    if held:
        yield name, pa.Table.from_batches(held)
