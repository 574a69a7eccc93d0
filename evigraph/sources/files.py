"""File sources and sinks: state bundles, delimited people tables, thread bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import taxonomy as tax
from evigraph.functions import text as tx
from evigraph.operators import entities as en
from evigraph.operators import normalize as nz
from evigraph.operators.edge_validation import listed

PERSON = ("struct<id:string,name:string,birth:double,death:double,fields:array<string>,"
          "subfields:array<string>,region:string,era:string,movement:string,"
          "bridge_score:double,works:array<string>,influenced:array<string>,"
          "claimIds:array<string>,notes:string>")
EDGE = ("struct<id:string,source:string,target:string,sourceEntityType:string,"
        "targetEntityType:string,type:string,strength:double,note:string,confidence:double,"
        "sourceClaims:array<string>,claimIds:array<string>,threadIds:array<string>,"
        "status:string>")
BUNDLE = f"version int, updatedAt string, people array<{PERSON}>, edges array<{EDGE}>"
PEOPLE_ROWS = {"claimIds": "claim_ids"}
EDGE_ROWS = {"sourceEntityType": "source_type", "targetEntityType": "target_type",
             "sourceClaims": "source_claims", "claimIds": "claim_ids", "threadIds": "thread_ids"}


def read_state_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Validated people, edges and entities of a JSON state bundle, and the rejects."""
    bundle = spark.read.schema(BUNDLE).option("multiLine", True).option(
        "mode", "PERMISSIVE").json(path)
    return state_tables(bundle)


def state_tables(bundle: DataFrame) -> dict[str, DataFrame]:
    """Tables of a bundle DataFrame; the order of list entries becomes ``ord``."""
    rows = lambda c: bundle.select(F.posexplode(c).alias("pos", "x")).filter(
        "x is not null").select(F.col("pos").cast("long").alias("ord"), "x.*")
    people, bad_people = nz.people(rows("people").withColumnsRenamed(PEOPLE_ROWS))
    edges, bad_edges = nz.edges(rows("edges").withColumnsRenamed(EDGE_ROWS), people)
    return {"people": people, "edges": edges, "entities": en.expanded(people, edges),
            "people_rejects": bad_people, "edge_rejects": bad_edges}


def write_state(tables: dict[str, DataFrame], path: str, version: int, at: Column) -> None:
    """One parquet folder per table and a manifest row with version and time."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(F.lit(version).alias("version"), at.alias("updated_at")).write.mode(
        "overwrite").json(f"{path}/manifest")


def read_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a written state."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ["people", "edges"]}


def read_latest_state(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame] | None:
    """First snapshot that can be read, newest version first."""
    for path in paths:
        try:
            return read_state_bundle(spark, path)
        except Exception as error:  # a missing version falls through to the older one
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return None


# Accepted headers per column of a people CSV.
HEADER_ALIASES = {
    "name": ["name", "person", "thinker"], "birth": ["birth", "birthyear", "born"],
    "death": ["death", "deathyear", "died"], "field": ["field", "discipline", "domain"],
    "notes": ["notes", "description", "summary"], "topics": ["topics", "subfields", "tags"],
    "source_url": ["sourceurl", "source", "url"], "region": ["region", "place"],
    "era": ["era"], "movement": ["movement", "school"], "works": ["works", "work"],
}


def read_people_csv(spark: SparkSession, path: str) -> DataFrame:
    """Import candidates of a people CSV with any of the accepted headers."""
    raw = spark.read.options(
        header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True).csv(path)
    return csv_candidates(raw)


def csv_candidates(raw: DataFrame) -> DataFrame:
    """Candidates of CSV rows; rows without a name or a numeric birth are dropped."""
    known = {"".join(ch for ch in c.lower() if ch.isalnum()): c for c in raw.columns}
    named = {}
    for column, aliases in HEADER_ALIASES.items():
        found = [known[a] for a in known if a in aliases]
        text = F.trim(F.col(f"`{found[0]}`")) if found else F.lit(None).cast("string")
        named[column] = F.coalesce(text, F.lit("")).alias(column)
    df = raw.select(*named.values())
    birth = F.col("birth").try_cast("double")
    parts = lambda c: F.filter(F.transform(F.split(c, "[;|]"), lambda v: F.trim(v)),
                               lambda v: v != "")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    field = F.coalesce(blank("field"), tax.infer_field(F.col("notes")))
    topics = parts("topics")
    score = 60 + 10 + F.when(F.size(topics) > 0, 10).otherwise(0) + F.when(
        F.col("source_url") != "", 10).otherwise(0)
    year = F.when(F.col("birth") == "", 0).otherwise(birth).cast("int")
    return df.filter((F.col("name") != "") & (year.isNotNull())).select(
        F.concat(F.lit("csv-"), tx.spaced_name_key(F.col("name")), F.lit("-"),
                 _digest(*HEADER_ALIASES)).alias("id"), "name",
        F.coalesce(blank("notes"), F.lit("CSV imported candidate.")).alias("description"),
        year.alias("birth"), F.col("death").try_cast("double").cast("int").alias("death"),
        F.array(field).alias("fields"), topics.alias("topics"), blank("region").alias("region"),
        F.coalesce(blank("era"), tax.era_from_year(year)).alias("era"),
        blank("movement").alias("movement"), parts("works").alias("works"),
        F.coalesce(blank("source_url"), F.lit("manual-paste")).alias("source_url"),
        F.when(F.col("source_url").contains("wikipedia.org"), F.col("source_url"))
        .alias("wikipedia_url"), F.least(F.lit(95), score).alias("confidence"))


def _digest(*columns) -> Column:
    """Tells rows of one name apart; equal rows have equal digests."""
    return F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8)


def pipe_candidates(lines: DataFrame) -> DataFrame:
    """Candidates of ``name|birth|death|field|notes`` text rows (column ``value``)."""
    cells = F.transform(F.split(F.trim("value"), r"\|"), lambda v: F.trim(v))
    df = lines.filter(F.col("value").contains("|")).withColumn("c", cells)
    cell = lambda i: F.coalesce(F.get("c", F.lit(i)), F.lit(""))
    notes = F.trim(F.array_join(F.slice("c", F.lit(5), F.greatest(
        F.size("c") - 4, F.lit(0))), " | "))
    birth = F.when(cell(1) == "", 0).otherwise(cell(1).try_cast("double")).cast("int")
    death = F.nullif(cell(2), F.lit("")).try_cast("double").cast("int")
    field = F.coalesce(F.nullif(cell(3), F.lit("")), tax.infer_field(notes))
    score = 55 + 15 + F.when(notes != "", 15).otherwise(0) + F.when(
        death.isNotNull(), 5).otherwise(0)
    return df.filter((cell(0) != "") & birth.isNotNull()).select(
        F.concat(F.lit("manual-"), tx.spaced_name_key(cell(0)), F.lit("-"),
                 _digest(F.array_join("c", "|"))).alias("id"), cell(0).alias("name"),
        F.coalesce(F.nullif(notes, F.lit("")), F.lit("Manual pasted import."))
        .alias("description"), birth.alias("birth"), death.alias("death"),
        F.array(field).alias("fields"), tax.era_from_year(birth).alias("era"),
        F.lit("manual-paste").alias("source_url"), F.least(F.lit(95), score).alias("confidence"))


def read_pipe_rows(spark: SparkSession, path: str) -> DataFrame:
    return pipe_candidates(spark.read.text(path))


def people_csv(people: DataFrame) -> DataFrame:
    """The eleven export columns; lists joined, nulls empty."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    joined = lambda c, n: F.concat_ws("; ", listed(c)).alias(n)
    return people.select(
        "id", "name", "birth", blank("death"), joined("fields", "fields"),
        joined("subfields", "topics"), blank("region"), blank("era"), blank("movement"),
        joined("works", "works"), blank("notes"))


def write_people_csv(people: DataFrame, path: str) -> None:
    people_csv(people).write.mode("overwrite").options(
        header=True, escape='"', emptyValue="").csv(path)


THREADS = ("schemaVersion int, threads array<struct<id:string,title:string,field:string,"
           "purpose:string,people:array<string>,concepts:array<string>,keyWorks:array<string>,"
           "edgeTypes:array<string>,confidence:string,sourceStatus:string>>")


def read_threads(spark: SparkSession, path: str, bundled: DataFrame) -> DataFrame:
    """Bundled threads plus the valid ones of a thread bundle."""
    from evigraph.operators.threads import merge_imported, valid_bundle_threads

    raw = spark.read.schema(THREADS).option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("threads").alias("ord", "x")).select(
        F.col("ord").cast("long"), "x.*").withColumnsRenamed({
            "keyWorks": "key_works", "edgeTypes": "edge_types", "sourceStatus": "source_status"})
    return merge_imported(bundled, valid_bundle_threads(rows))


def write_json(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON folder per artifact: reports, rosters, candidate edges, thread bundles."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
