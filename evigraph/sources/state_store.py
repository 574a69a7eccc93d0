"""A state as tables of records, in versions that a manifest commits.

A bundle, the exported form, is one JSON document with lists; a store holds one row per
record, so its size is no task's. Each version is written whole, counted and digested as
read back, and then named in a manifest; what has no manifest was never committed. A restore
takes the newest version whose tables still are what its manifest says.
"""

from __future__ import annotations

import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.operators import entities as en
from evigraph.operators import normalize as nz
from evigraph.sources.files import EDGE, EDGE_ROWS, PEOPLE_ROWS, PERSON

# Fixed value: the percentage from which imports are accepted unless the state says so.
DEFAULT_THRESHOLD = 80
#: Records of one file lie below this number times the file's rank plus one.
FILE_SPAN = 1 << 32
QUEUED = ("struct<id:string,candidateId:string,candidateName:string,confidence:double,"
          "duplicateId:string,status:string>")
LINKED = ("struct<id:string,sourceId:string,targetId:string,sourceName:string,targetName:string,"
          "reason:string,score:double,createdAt:string>")
AUDITED = "struct<id:string,candidateId:string,candidateName:string,action:string,at:string>"
BUNDLE = (f"version int, exportedAt string, people array<{PERSON}>, edges array<{EDGE}>, "
          f"importReviewQueue array<{QUEUED}>, linkReviewQueue array<{LINKED}>, "
          f"importAuditLog array<{AUDITED}>, importConfidenceThreshold string, "
          "rejectedLinkSuggestionKeys array<string>")
QUEUE_ROWS = {"candidateId": "candidate_id", "candidateName": "candidate_name",
              "duplicateId": "duplicate_id"}
LINK_ROWS = {"sourceId": "source_id", "targetId": "target_id", "sourceName": "source_name",
             "targetName": "target_name", "createdAt": "created_at"}
AUDIT_ROWS = {"candidateId": "candidate_id", "candidateName": "candidate_name"}
#: Tables of a state; ``settings`` has the row (threshold).
TABLES = ["people", "edges", "import_queue", "link_queue", "audit", "rejected_keys", "settings"]


class NoValidPeople(ValueError):
    """A state without a single valid person is none."""


def _ranked_files(bundles: DataFrame) -> DataFrame:
    """Bundles with ``file``, the rank of their file by name: one small row per file."""
    names = bundles.select("path").distinct()
    rank = F.row_number().over(Window.orderBy("path")) - 1
    return bundles.join(names.select("path", rank.cast("long").alias("file")), "path")


def read_bundles(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """State tables of the JSON bundles under ``path``; see ``bundle_tables``."""
    raw = spark.read.schema(BUNDLE).option("multiLine", True).option(
        "mode", "PERMISSIVE").json(path)
    return bundle_tables(raw.withColumn("path", F.col("_metadata.file_path")))


def bundle_tables(bundles: DataFrame) -> dict[str, DataFrame]:
    """Validated tables of bundles(path, ...), with an ``ord`` that no two records share.

    The order of files is that of their names; within a file it is the list's. The last
    file that states a threshold sets it, between 0 and 100. A state without a valid person
    is an error, as in a restore it would wipe what is there.
    """
    filed = _ranked_files(bundles)

    def rows(column: str, renamed: dict[str, str], *more: str) -> DataFrame:
        return filed.select("file", *more, F.posexplode(column).alias("pos", "x")).filter(
            "x is not null").select((F.col("file") * FILE_SPAN + F.col("pos")).alias("ord"),
                                    *more, "x.*").withColumnsRenamed(renamed)

    people, bad_people = nz.people(rows("people", PEOPLE_ROWS))
    if people.isEmpty():
        raise NoValidPeople("no valid people in the state")
    edges, bad_edges = nz.edges(rows("edges", EDGE_ROWS), people)
    keys = filed.select("file", F.posexplode("rejectedLinkSuggestionKeys").alias("pos", "key"))
    keys = keys.filter("key is not null").groupBy("key").agg(
        F.min(F.col("file") * FILE_SPAN + F.col("pos")).alias("ord"))
    given = F.col("importConfidenceThreshold").try_cast("double")
    stated = filed.filter(given.isNotNull() & ~F.isnan(given)).agg(
        F.max_by(given, "file").alias("given"))
    settings = stated.select(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(
        "given", F.lit(float(DEFAULT_THRESHOLD))))).alias("threshold"))
    return {
        "people": people, "edges": edges, "people_rejects": bad_people, "edge_rejects": bad_edges,
        "import_queue": nz.import_queue(rows("importReviewQueue", QUEUE_ROWS)),
        "link_queue": nz.link_queue(rows("linkReviewQueue", LINK_ROWS, "exportedAt"),
                                    F.col("exportedAt")).drop("exportedAt"),
        "audit": rows("importAuditLog", AUDIT_ROWS), "rejected_keys": keys.select("ord", "key"),
        "settings": settings}


def _measured(df: DataFrame, name: str) -> DataFrame:
    """Number and order-free digest of a table's rows."""
    # Rows as text, so that a column read back in another place counts the same.
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    return df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.coalesce(
        F.bit_xor(row), F.lit(0).cast("long")).alias("mixed"),
        F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("summed"))


def _manifests(spark: SparkSession, root: str) -> DataFrame | None:
    """The manifest rows of all committed versions, None without a store."""
    schema = "version long, folder string, table string, rows long, mixed long, summed string, written_at timestamp"
    try:
        return spark.read.schema(schema).json(f"{root}/manifests")
    except PySparkException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def commit(tables: dict[str, DataFrame], root: str, at: Column) -> int:
    """Write the tables as the next version and commit it; earlier ones stay as they are.

    The tables go to a folder of their own, so a commit that fails half-way leaves nothing
    that a restore could take. One writer at a time numbers the versions.
    """
    spark = next(iter(tables.values())).sparkSession
    known = _manifests(spark, root)
    last = known.agg(F.max("version")).first()[0] if known is not None else None
    version = (last or 0) + 1
    folder = f"versions/{version:08d}-{uuid.uuid4().hex[:8]}"
    written = []
    for name, df in tables.items():
        df.write.parquet(f"{root}/{folder}/{name}")
        written.append(_measured(spark.read.parquet(f"{root}/{folder}/{name}"), name))
    manifest = reduce(DataFrame.unionByName, written).select(
        F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder"), "table",
        "rows", "mixed", "summed", at.alias("written_at"))
    manifest.coalesce(1).write.mode("append").json(f"{root}/manifests")
    return version


def versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """Committed versions and their folders, newest first."""
    known = _manifests(spark, root)
    if known is None:
        return []
    rows = known.filter("version is not null").select("version", "folder").distinct().collect()
    return sorted(((r.version, r.folder) for r in rows), reverse=True)


def restore(spark: SparkSession, root: str) -> tuple[int, dict[str, DataFrame]] | None:
    """Number and tables of the newest whole version, None if there is none.

    A version counts if every table its manifest names can be read and has the rows and
    digests it was committed with; one that is missing, cut short or altered is passed over
    for the one before it.
    """
    for version, folder in versions(spark, root):
        wanted = _manifests(spark, root).filter(
            (F.col("version") == version) & (F.col("folder") == folder)).select(
            "table", "rows", "mixed", "summed")
        try:
            names = [r.table for r in wanted.select("table").collect()]
            tables = {n: spark.read.parquet(f"{root}/{folder}/{n}") for n in names}
            found = reduce(DataFrame.unionByName, [_measured(df, n) for n, df in tables.items()])
            whole = found.exceptAll(wanted).isEmpty()
        except PySparkException:
            continue
        except Py4JJavaError as error:  # a file cut short, found while the schema is read
            if "FAILED_READ_FILE" not in str(error):
                raise
            continue
        if whole:
            return version, tables
    return None


def restored_entities(tables: dict[str, DataFrame]) -> DataFrame:
    """The typed entities of a restored state."""
    return en.expanded(tables["people"], tables["edges"])
