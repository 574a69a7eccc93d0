"""Session settings and lineage cuts shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evigraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


#: A statement begun under this setting removes its shuffle files as it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Tables written in here need their shuffle files no more once they are complete; else
    these stay until the driver's JVM happens to collect its garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and drop its lineage.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a local
    session without one (a test) gets a temporary folder; a cluster must name a shared
    folder that outlives its executors.
    """
    shared_folder(df.sparkSession)
    with _freeing_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


class Scratch:
    """Tables of a job in the reliable folder, removed as soon as it is through with them.

    Unless they are large for certain they are written uncompressed: Spark broadcasts by the
    size of the files, which then is near what they take in memory.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, compression: str = "none") -> DataFrame:
        """``df`` written once and read back. Large tables, which are compressed, free their
        shuffles; for very many small ones that costs the driver more than it gains."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        with nullcontext() if compression == "none" else _freeing_shuffles(self.spark):
            df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        """Delete all tables; nothing may read them afterwards."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder of the session, that of its checkpoints."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
            "spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="evigraph-ckpt-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()
