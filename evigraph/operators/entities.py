"""People and edges projected into typed knowledge entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import taxonomy as tax
from evigraph.functions import text as tx
from evigraph.operators.edge_validation import listed
from evigraph.operators.normalize import endpoints_match, last_per


def _claim_ids(df: DataFrame) -> Column:
    return listed("claim_ids") if "claim_ids" in df.columns else F.array().cast("array<string>")


def persons(people: DataFrame) -> DataFrame:
    return people.select(
        F.concat(F.lit("person:"), "id").alias("id"), F.lit("Person").alias("type"),
        F.col("name").alias("label"), _claim_ids(people).alias("claim_ids"),
        F.col("id").alias("thinker_id"), "birth", "death", "fields")


def works(people: DataFrame) -> DataFrame:
    """One work per person and title slug; the last spelling wins."""
    listed_titles = people.select(
        "id", "ord", F.posexplode("works").alias("pos", "raw")).withColumn("title", F.trim("raw"))
    rows = listed_titles.filter("title <> ''").select(
        tx.work_id(F.col("id"), F.col("title")).alias("id"),
        F.col("title"), tx.person_entity_id(F.col("id")).alias("author_id"),
        F.struct("ord", "pos").alias("_order"))
    return (last_per(rows, ["id"], F.col("_order"))
            .select("id", F.lit("Work").alias("type"), F.col("title").alias("label"), "title",
                    F.array("author_id").alias("author_ids")))


def authorship(people: DataFrame) -> DataFrame:
    kind = "person authored work"
    return works(people).select("id", "label", F.explode("author_ids").alias("author")).select(
        tx.relationship_id(F.col("author"), F.col("id"), F.lit(kind)).alias("id"),
        F.lit("Relationship").alias("type"),
        F.concat("author", F.lit(" authored "), "label").alias("label"),
        F.col("author").alias("source_id"), F.lit("Person").alias("source_type"),
        F.col("id").alias("target_id"), F.lit("Work").alias("target_type"),
        F.lit(kind).alias("relationship_type"), F.lit("accepted").alias("status"))


def concepts(people: DataFrame) -> DataFrame:
    """Concepts by slug with the union of their people's fields; last label wins.

    Fields are a small vocabulary, so the distinct (concept, field) rows stay few.
    """
    tagged = people.select("ord", "fields", F.posexplode("subfields").alias("pos", "raw"))
    rows = tagged.withColumn("label", F.trim("raw")).filter("label <> ''").withColumn(
        "id", tx.entity_id("concept", F.col("label")))
    labels = rows.groupBy("id").agg(F.max_by("label", F.struct("ord", "pos")).alias("label"))
    fields = (rows.select("id", F.explode("fields").alias("field"))
              .groupBy("id").agg(F.array_sort(F.collect_set("field")).alias("fields")))
    return labels.join(fields, "id", "left").select(
        "id", F.lit("Concept").alias("type"), "label", listed("fields").alias("fields"))


def movements(people: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """Curated and observed movements; curated labels and dates win, fields unite."""
    observed = people.filter("movement is not null and movement <> ''").withColumn(
        "id", tx.entity_id("movement", F.col("movement")))
    labels = observed.groupBy("id").agg(F.min_by("movement", "ord").alias("_seen_label"))
    fields = (observed.select("id", F.explode("fields").alias("field")).groupBy("id")
              .agg(F.collect_set("field").alias("_seen_fields")))
    seen = labels.join(fields, "id", "left")
    if curated is None:
        schema = "id string, label string, start int, end int, fields array<string>"
        known = people.sparkSession.createDataFrame([], schema)
    else:
        known = curated.select(tx.entity_id("movement", F.col("name")).alias("id"),
                               F.col("name").alias("label"), "start", "end", "fields")
    return known.join(seen, "id", "full_outer").select(
        "id", F.lit("Movement").alias("type"),
        F.coalesce("label", "_seen_label").alias("label"), "start", "end",
        F.array_sort(tx.merge_unique(F.col("fields"), F.col("_seen_fields"))).alias("fields"))


def institutions(table: DataFrame) -> DataFrame:
    return table.select(
        tx.entity_id("institution", F.col("name")).alias("id"), F.lit("Institution").alias("type"),
        F.col("name").alias("label"), "city",
        F.transform("figures", tx.person_entity_id).alias("figure_ids"))


def relationships(edges: DataFrame) -> DataFrame:
    """Edges as typed relationships; web addresses become deterministic claim ids."""
    source_type = F.coalesce("source_type", F.lit("Person"))
    target_type = F.coalesce("target_type", F.lit("Person"))
    kind = F.when(endpoints_match(F.col("type"), source_type, target_type), F.col("type")
                  ).otherwise("person influenced person")
    end = lambda t, c: F.when(t == "Person", tx.person_entity_id(F.col(c))
                              ).otherwise(F.col(c))
    keyed = edges.select(
        "id", F.col("type").alias("_type"), "strength", "confidence", "status", "source_claims",
        source_type.alias("source_type"), target_type.alias("target_type"),
        kind.alias("relationship_type"), end(source_type, "source").alias("source_id"),
        end(target_type, "target").alias("target_id"))
    record = F.coalesce("id", tx.relationship_id(
        F.col("source_id"), F.col("target_id"), F.col("relationship_type")))
    claim_ids = F.transform(listed("source_claims"), lambda url, i: F.when(
        tx.is_web_url(url), tx.claim_id(
            F.col("id"), F.concat(F.lit("sourceClaims."), i.cast("string")), tx.url_host(url), url)
    ).otherwise(url))
    return keyed.withColumn("id", record).select(
        "id", F.lit("Relationship").alias("type"),
        F.concat_ws(" ", "source_id", "relationship_type", "target_id").alias("label"),
        "source_id", "source_type", "target_id", "target_type", "relationship_type", "strength",
        "confidence", "status", claim_ids.alias("claim_ids"), "source_claims")


def edge_claims(edges: DataFrame) -> DataFrame:
    """One reference claim per web address of an edge."""
    rel = relationships(edges)
    cited = rel.select("id", "confidence", "claim_ids",
                       F.posexplode(listed("source_claims")).alias("pos", "url"))
    return cited.filter(tx.is_web_url(F.col("url"))).select(
        F.col("claim_ids")[F.col("pos")].alias("id"), F.lit("SourceClaim").alias("type"),
        F.concat(tx.url_host(F.col("url")), F.lit(": sourceClaims."), F.col("pos").cast("string"))
        .alias("label"),
        tx.url_host(F.col("url")).alias("source_name"), F.col("url").alias("source_url"),
        F.lit("reference").alias("source_type"), F.lit(0.6).alias("source_reliability"),
        F.lit("manual_seed").alias("extraction_method"), F.col("id").alias("subject_id"),
        F.lit("Relationship").alias("subject_type"),
        F.concat(F.lit("sourceClaims."), F.col("pos").cast("string")).alias("field"),
        F.col("url").alias("value"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
        F.lit("observed").alias("status"))


def expanded(people: DataFrame, edges: DataFrame) -> DataFrame:
    """All entity kinds in one wide table with a type column."""
    parts = [persons(people), works(people), concepts(people), movements(people),
             relationships(edges).drop("source_claims"),
             edge_claims(edges).withColumnRenamed("source_type", "claim_source_type")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def attach_identifier(entities: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Append (source_name, source_id, source_url) identifiers that are not present yet."""
    new = F.struct("source_name", "source_id", "source_url")
    arriving = identifiers.groupBy("id").agg(F.array_sort(F.collect_set(new)).alias("_new"))
    kind = "array<struct<source_name:string,source_id:string,source_url:string>>"
    current = F.coalesce("source_ids", F.array().cast(kind))
    fresh = F.filter("_new", lambda n: ~F.exists(current, lambda c: (
        c["source_name"] == n["source_name"]) & (c["source_id"] == n["source_id"])))
    return entities.join(arriving, "id", "left").withColumn(
        "source_ids", F.concat(current, F.coalesce(fresh, F.array().cast(kind)))).drop("_new")


def metadata_edges(people: DataFrame, explicit: DataFrame) -> DataFrame:
    """Recorded influences of people that no explicit edge states."""
    claimed = people.select(F.col("id").alias("source"), "ord",
                            F.posexplode("influenced").alias("pos", "target"))
    names = people.select(F.col("id").alias("target"), F.col("name").alias("_name"))
    stated = explicit.select("source", "target").distinct()
    return (claimed.filter("source <> target").join(names, "target")
            .join(stated, ["source", "target"], "left_anti")
            .select("source", "target", F.lit("Recorded influence").alias("type"),
                    F.lit(3).alias("strength"), F.lit(0.85).alias("confidence"),
                    F.lit("Derived from existing thinker influence metadata").alias("note"),
                    F.array(tx.article_url(F.col("_name"))).alias("source_claims"), "ord", "pos"))


def candidate_text() -> Column:
    return F.concat_ws(" ", "description", "movement", "works", "_fields")


def drafts(candidates: DataFrame) -> DataFrame:
    """Candidates as person drafts: inferred field, topics and era."""
    fields = F.when(F.size(listed("fields")) > 0, F.col("fields")).otherwise(
        F.array(tax.infer_field(F.col("description"))))
    df = candidates.withColumn("_fields", fields)
    return df.select(
        "id", "ord", "name", F.coalesce("birth", F.lit(0)).alias("birth"), "death",
        F.col("_fields").alias("fields"),
        tax.auto_topics(F.col("_fields"), candidate_text(), F.col("topics"), 12)
        .alias("subfields"),
        "region", F.coalesce("era", tax.era_from_year(F.col("birth"))).alias("era"),
        F.coalesce("movement", F.lit("Imported")).alias("movement"),
        F.lit(2).alias("bridge_score"), listed("works").alias("works"),
        F.col("description").alias("notes"))


def unique_ids(candidates: DataFrame, people: DataFrame) -> DataFrame:
    """Slug ids; a slug that is taken or shared gets the candidate id appended."""
    slug = tx.underscore_slug(F.col("name"))
    keyed = candidates.withColumn("_slug", F.coalesce(F.nullif(slug, F.lit("")), F.lower("id")))
    shared = keyed.groupBy("_slug").agg(F.min("ord").alias("_first"))
    taken = people.select(F.col("id").alias("_slug"), F.lit(True).alias("_taken")).distinct()
    suffix = tx.underscore_slug(F.col("id"))
    clash = F.col("_taken").isNotNull() | (F.col("ord") != F.col("_first"))
    return (keyed.join(shared, "_slug").join(taken, "_slug", "left")
            .withColumn("person_id", F.when(clash, F.concat_ws("_", "_slug", suffix))
                        .otherwise(F.col("_slug")))
            .drop("_slug", "_first", "_taken"))


def bridge_score(n_fields: Column, n_topics: Column, n_works: Column, has_movement: Column,
                 n_links: Column) -> Column:
    signals = [n_fields > 1, n_topics >= 4, n_works >= 2, has_movement, n_links >= 2]
    total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(False)).cast("int") for s in signals])
    return F.greatest(F.lit(1), F.least(F.lit(5), 2 + total))


def split_observations(observations: DataFrame) -> DataFrame:
    """Candidate claims held by raw observations, one row per normalized claim."""
    from evigraph.operators.normalize import claims

    nested = observations.select(F.col("id").alias("observation_id"),
                                 F.explode("normalized_claims").alias("c"))
    return claims(nested.select("observation_id", "c.*"))
