"""Schema enforcement: keep and repair valid rows, report the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text as tx
from evigraph.functions import vocab
from evigraph.operators.edge_validation import listed, reasons
from evigraph.operators.evidence_policy import clamp01

PEOPLE_ARRAYS = ["subfields", "works", "influenced", "claim_ids"]


def finite(value: Column) -> Column:
    number = value.cast("double")
    return F.coalesce(value.isNotNull() & ~F.isnan(number)
                      & (F.abs(number) < float("inf")), F.lit(False))


def person_problems() -> Column:
    """Why a raw people row cannot be kept; empty when it can."""
    return reasons(
        (F.col("id").isNull(), "id must be a string"),
        (F.col("name").isNull(), "name must be a string"),
        (~finite(F.col("birth")), "birth must be a number"),
        (F.col("death").isNotNull() & ~finite(F.col("death")), "death must be a number or null"),
        (F.size(listed("fields")) == 0, "fields must not be empty"))


def people(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept people with default arrays, rejects with their problems)."""
    judged = raw.withColumn("problems", person_problems())
    kept = judged.filter(F.size("problems") == 0).drop("problems").withColumns(
        {c: listed(c) for c in PEOPLE_ARRAYS if c in raw.columns})
    return kept, judged.filter(F.size("problems") > 0)


def has_evidence() -> Column:
    return (F.size(listed("source_claims")) > 0) | (F.size(listed("claim_ids")) > 0)


def edge_status(status: Column, confidence: Column, evidence: Column) -> Column:
    """Keep a known status; otherwise derive it from evidence and confidence."""
    derived = F.when(~evidence, "needs_source").when(
        F.coalesce(confidence, F.lit(0.0)) >= 0.75, "accepted").otherwise("suggested")
    return F.when(status.isin(vocab.EDGE_STATUSES), status).otherwise(derived)


def _judged_edges(raw: DataFrame, people_ids: DataFrame) -> DataFrame:
    ids = people_ids.select("id").distinct()
    kinds = {c: F.when(F.col(c).isin(vocab.ENDPOINT_TYPES), F.col(c)).otherwise("Person")
             for c in ["source_type", "target_type"]}
    df = raw.withColumns(kinds)
    for end in ["source", "target"]:
        known = ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}_known"))
        df = df.join(known, end, "left")
    return df.withColumn("problems", reasons(
        (F.col("source").isNull(), "source must be a string"),
        (F.col("target").isNull(), "target must be a string"),
        (F.col("type").isNull(), "type must be a string"),
        (~finite(F.col("strength")), "strength must be a number"),
        (F.col("source").isNotNull() & (F.col("source_type") == "Person")
         & F.col("_source_known").isNull(), "source person is missing"),
        (F.col("target").isNotNull() & (F.col("target_type") == "Person")
         & F.col("_target_known").isNull(), "target person is missing"),
    )).drop("_source_known", "_target_known")


def edges(raw: DataFrame, people_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept edges with defaults, rejects with their problems)."""
    judged = _judged_edges(raw, people_ids)
    confidence = F.when(finite(F.col("confidence")), clamp01(F.col("confidence")))
    kept = judged.filter(F.size("problems") == 0).drop("problems").withColumns({
        "id": F.coalesce("id", F.concat_ws(":", "source", "type", "target")),
        "confidence": confidence,
        "status": edge_status(F.col("status"), confidence, has_evidence()),
        "source_claims": listed("source_claims"), "claim_ids": listed("claim_ids"),
        "thread_ids": listed("thread_ids")})
    return kept.select(*raw.columns), judged.filter(F.size("problems") > 0)


def issues(table: str, rejects: DataFrame, key: str = "ord") -> DataFrame:
    """Reject rows as (path, message) issues."""
    return rejects.select(
        F.concat(F.lit(f"{table}["), F.col(key).cast("string"), F.lit("]")).alias("path"),
        F.array_join("problems", "; ").alias("message"))


def seed_edges(raw: DataFrame) -> DataFrame:
    """Clamp and default seed edges, then keep the first edge per source and target."""
    confidence = clamp01(F.col("confidence"))
    confidence = F.when(F.col("confidence").isNotNull(), confidence)
    ready = raw.withColumns({
        "confidence": confidence,
        "status": edge_status(F.col("status"), confidence, has_evidence()),
        "source_claims": listed("source_claims"), "claim_ids": listed("claim_ids")})
    return first_per(ready, ["source", "target"], "ord")


def first_per(df: DataFrame, keys: list, order: str) -> DataFrame:
    """First row per key by ``order``; reduces map-side, so hot keys stay cheap."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
            .select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns]))


def last_per(df: DataFrame, keys: list, order: Column) -> DataFrame:
    """Last row per key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest), order).alias("_row"))
            .select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns]))


def import_queue(rows: DataFrame) -> DataFrame:
    """Queue rows with an id and a candidate; confidence an integer percentage."""
    # Review states of a queued import.
    states = ["queued", "edited", "accepted", "skipped", "duplicate"]
    percent = F.greatest(F.lit(0), F.least(F.lit(100), F.round(
        F.coalesce("confidence", F.lit(0.0))).cast("int")))
    default = F.when(F.col("duplicate_id").isNotNull(), "duplicate").otherwise("queued")
    return rows.filter("id is not null and candidate_id is not null and candidate_name is not null"
                       ).withColumns({
        "confidence": percent,
        "status": F.when(F.col("status").isin(states), F.col("status")).otherwise(default)})


def link_queue(rows: DataFrame, now: Column) -> DataFrame:
    """Link-review rows with defaulted names, reason, score and time."""
    filled = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), d)
    return rows.filter("id is not null and source_id is not null and target_id is not null"
                       ).withColumns({
        "source_name": filled("source_name", F.col("source_id")),
        "target_name": filled("target_name", F.col("target_id")),
        "reason": filled("reason", F.lit("Queued suggested relationship.")),
        "score": F.when(finite(F.col("score")), F.col("score")).otherwise(1.0),
        "created_at": F.coalesce("created_at", now)})


# Columns each entity type must carry.
ENTITY_REQUIREMENTS = {
    "Person": ["thinker_id", "birth", "fields"], "Work": ["title"], "Concept": [],
    "Movement": [], "Institution": [], "Relationship": ["source_id", "target_id",
                                                         "relationship_type"],
    "SourceClaim": ["source_name", "subject_id", "subject_type", "field", "value"],
}


def entities(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mixed entity table: (rows valid for their type, rejects)."""
    valid = F.lit(False)
    for kind, needed in ENTITY_REQUIREMENTS.items():
        present = [F.col(c).isNotNull() for c in needed if c in raw.columns]
        missing = [c for c in needed if c not in raw.columns]
        complete = reduce(lambda a, b: a & b, present, F.lit(not missing))
        valid = F.when(F.col("type") == kind, complete).otherwise(valid)
    valid = F.coalesce(valid & F.col("id").isNotNull() & F.col("label").isNotNull(), F.lit(False))
    judged = raw.withColumn("_valid", valid)
    kept = judged.filter("_valid").drop("_valid")
    if "identifiers" in raw.columns:
        kept = kept.withColumn("identifiers", F.map_filter(
            "identifiers", lambda k, v: v.isNotNull() & (v != "")))
    return kept, judged.filter(~F.col("_valid")).drop("_valid")


def integrity(people: DataFrame, edges: DataFrame) -> DataFrame:
    """Schema problems, impossible dates, self-links and dangling references."""
    finding = lambda df, code, target: df.select(
        F.lit(code).alias("code"), target.alias("target_id"))
    arrow = F.concat("source", F.lit("->"), "target")
    ids = people.select("id").distinct()
    # Fixed value: this source id marks derived metadata edges.
    real = edges.filter(F.col("source") != "metadata")
    broken = people.filter(F.size(person_problems()) > 0)
    missing_source = real.join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
    missing_target = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    return reduce(DataFrame.unionByName, [
        finding(broken, "schema", F.coalesce("id", F.col("ord").cast("string"))),
        finding(people.filter("death < birth"), "impossible-dates", F.col("id")),
        finding(edges.filter("source = target"), "self-link", arrow),
        finding(missing_source, "missing-source", arrow),
        finding(missing_target, "missing-target", arrow)])


def authority_ids(identifiers: Column) -> Column:
    """Trimmed, non-empty, distinct ids per authority; empty authorities dropped."""
    cleaned = F.transform_values(identifiers, lambda k, v: F.array_distinct(
        F.filter(F.transform(v, lambda v: F.trim(v)), lambda x: x != "")))
    return F.map_filter(cleaned, lambda k, v: F.size(v) > 0)


# Claim source types and extraction methods, with their defaults.
SOURCE_TYPES = ["reference", "encyclopedia", "bibliographic", "primary_text", "institutional",
                "citation_index", "curated_dataset"]
EXTRACTION_METHODS = ["api_field", "parser", "text_extraction", "citation_graph",
                      "model_generated_summary", "manual_seed"]


def claims(drafts: DataFrame, default_status: str = "observed") -> DataFrame:
    """Drafts with deterministic ids, labels, known enumerations and bounded scores."""
    known = lambda c, values, d: F.when(F.col(c).isin(values), F.col(c)).otherwise(d)
    score = lambda c: clamp01(F.coalesce(F.col(c), F.lit(0.5)))
    made = tx.claim_id(F.col("subject_id"), F.col("field"), F.col("source_name"), F.col("value"))
    return drafts.withColumns({
        "id": F.coalesce("id", made),
        "label": F.coalesce("label", F.concat("source_name", F.lit(": "), "field")),
        "source_type": known("source_type", SOURCE_TYPES, "reference"),
        "extraction_method": known("extraction_method", EXTRACTION_METHODS, "manual_seed"),
        "source_reliability": score("source_reliability"), "confidence": score("confidence"),
        "status": known("status", vocab.CLAIM_STATUSES, default_status)})


def endpoints_match(kind: Column, source_type: Column, target_type: Column) -> Column:
    """Typed relationships fix their endpoint types; other types accept any."""
    match = F.lit(True)
    for name, (source, target) in vocab.TYPED_RELATIONSHIPS.items():
        match = F.when(kind == name, (source_type == source) & (target_type == target)
                       ).otherwise(match)
    return match


def unusable_urls(df: DataFrame, kind: str, url: str = "source_url") -> DataFrame:
    """Warnings for rows whose url is missing or does not parse as http or https."""
    protocol = F.lower(F.try_parse_url(F.trim(url), F.lit("PROTOCOL")))
    usable = F.coalesce(protocol.isin("http", "https"), F.lit(False))
    return df.filter(~usable).select("id", F.lit(kind).alias("kind"), F.concat(
        F.lit(f"Source {kind} "), F.col("id"), F.lit(" has no usable source URL."))
        .alias("message"))


def relationship_status(status: Column) -> Column:
    return F.when(status.isin(vocab.EDGE_STATUSES), status).otherwise("suggested")
