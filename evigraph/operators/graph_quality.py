"""Graph quality metrics, audit findings, review lists and repair plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text as tx
from evigraph.functions import vocab
from evigraph.operators.edge_validation import is_refinement_candidate, listed, recency_days
from evigraph.operators.normalize import has_evidence


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def cited_sources() -> Column:
    """The list that counts as sources: an empty url list still hides the claim ids."""
    return F.coalesce("source_claims", "claim_ids", F.array().cast("array<string>"))


def endpoints(edges: DataFrame, loops_once: bool = False) -> DataFrame:
    """One row per edge end; ``loops_once`` counts a self-link a single time."""
    ends = F.array("source", "target")
    return edges.withColumn("id", F.explode(F.array_distinct(ends) if loops_once else ends))


def degree(edges: DataFrame, loops_once: bool = False) -> DataFrame:
    return endpoints(edges.select("source", "target"), loops_once).groupBy("id").agg(
        F.count(F.lit(1)).alias("degree"))


def with_degree(people: DataFrame, edges: DataFrame, loops_once: bool = False) -> DataFrame:
    return people.join(degree(edges, loops_once), "id", "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0).cast("long")))


def ratio(count: Column, total: Column, scale: int = 1000) -> Column:
    """count / total rounded half up to 1/scale, zero for an empty total."""
    exact = F.floor((count * (2 * scale) + total) / (total * 2)) / F.lit(float(scale))
    return F.when(total == 0, 0.0).otherwise(exact)


def metrics(people: DataFrame, edges: DataFrame, claims: DataFrame, threads: DataFrame,
            now: Column) -> DataFrame:
    """Long (metric, value) rows of the seven quality metrics."""
    one = F.count(F.lit(1))
    row = lambda df, name: df.select(F.lit(name).alias("metric"), "value")
    milli = F.round(F.coalesce("confidence", F.lit(0.5)) * 1000).cast("long")
    of_edges = edges.agg(
        ratio(F.count_if(F.size(cited_sources()) > 0), one).alias("sourced"),
        ratio(F.count_if(F.col("status") == "accepted"), one).alias("accepted"),
        ratio(F.coalesce(F.sum(milli), F.lit(0)), one * 1000).alias("confidence"))
    isolated = people.join(endpoints(edges).select("id").distinct(), "id", "left_anti")
    shared = people.groupBy(tx.spaced_name_key(F.col("name")).alias("k")).agg(one.alias("n"))
    ages = recency_days(F.col("observed_at"), now)
    aged = claims.agg(F.when(F.count(ages) > 0, ratio(F.sum(ages), F.count(ages), 10))
                      .alias("value"))
    members = threads.select(F.explode("people").alias("id")).distinct()
    covered = (members.select(F.lit(1).alias("m"), F.lit(0).alias("p"))
               .unionByName(people.select(F.lit(0).alias("m"), F.lit(1).alias("p")))
               .agg(ratio(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum("p"), F.lit(0)))
                    .alias("value")))
    edge_rows = of_edges.unpivot([], ["sourced", "accepted", "confidence"], "metric", "value")
    edge_rows = edge_rows.replace({
        "sourced": "sourced_edge_percentage", "accepted": "accepted_edge_percentage",
        "confidence": "average_edge_confidence"}, subset="metric")
    return union_all([
        edge_rows,
        row(isolated.agg(one.cast("double").alias("value")), "isolated_node_count"),
        row(shared.filter("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")
                                       .alias("value")), "duplicate_risk_count"),
        row(aged, "average_source_freshness_days"),
        row(covered, "canonical_thread_coverage")])


# Finding code -> (severity, message).
FINDINGS = {
    "dangling-reference": ("critical", "Edge references a missing person."),
    "unsupported-edge": ("warning", "Edge has no source claims."),
    "isolated-node": ("warning", "Person has no graph edges."),
    "sparse-high-bridge-node": ("warning", "High bridge-score person has sparse connectivity."),
    "impossible-dates": ("critical", "Death year is earlier than birth year."),
    "missing-works": ("info", "Person has no works listed."),
    "missing-institutions": ("info", "Person has no institution or movement context."),
    "over-broad-tag": ("info", "Person has broad tags without narrower topics."),
    "duplicate-entity-risk": ("warning", "Entity has a duplicate name risk."),
    "stale-source-claim": ("warning", "Source claim is stale."),
}


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def _coded(df: DataFrame, cases: list[tuple[str, Column]], target: Column) -> DataFrame:
    """One finding row per case that holds."""
    codes = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in cases]))
    return df.select(target.alias("target_id"), F.explode(codes).alias("code"))


def audit(people: DataFrame, edges: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """Findings (code, severity, target_id, message) over people, edges and claims."""
    ids = people.select("id").distinct()
    known = edges
    for end in ["source", "target"]:
        known = known.join(ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")),
                           end, "left")
    of_edges = _coded(known, [
        ("dangling-reference", F.col("_source").isNull() | F.col("_target").isNull()),
        ("unsupported-edge", F.size(cited_sources()) == 0),
    ], F.concat("source", F.lit("->"), "target"))
    key = tx.spaced_name_key(F.col("name"))
    names = people.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_same"))
    ready = with_degree(people.withColumn("_key", key), edges).join(names, "_key")
    of_people = _coded(ready, [
        ("isolated-node", F.col("degree") == 0),
        ("sparse-high-bridge-node", (F.col("bridge_score") >= 4) & (F.col("degree") <= 1)),
        ("impossible-dates", F.col("death") < F.col("birth")),
        ("missing-works", F.size(listed("works")) == 0),
        ("missing-institutions", _blank("region") & _blank("movement")),
        ("over-broad-tag", F.exists("fields", lambda f: f.isin(vocab.BROAD_FIELDS))
         & (F.size(listed("subfields")) == 0)),
        ("duplicate-entity-risk", F.col("_same") > 1),
    ], F.col("id"))
    old = (F.col("status") == "stale") | F.coalesce(
        recency_days(F.col("observed_at"), now) > 3650, F.lit(False))
    of_claims = _coded(claims, [("stale-source-claim", old)], F.col("id"))
    table = F.create_map(*[x for code, (severity, message) in FINDINGS.items() for x in (
        F.lit(code), F.struct(F.lit(severity).alias("s"), F.lit(message).alias("m")))])
    return union_all([of_edges, of_people, of_claims]).select(
        "code", table[F.col("code")]["s"].alias("severity"), "target_id",
        table[F.col("code")]["m"].alias("message"))


def severity_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))


def repair_triggers(findings: DataFrame, critical: int = 1, warning: int = 5) -> DataFrame:
    """Dry-run repair jobs for severities whose finding count reaches its threshold."""
    limit = F.when(F.col("severity") == "critical", critical).otherwise(warning)
    return (findings.filter(F.col("severity").isin("critical", "warning"))
            .groupBy("severity").agg(F.count(F.lit(1)).alias("n"),
                                     F.array_sort(F.collect_set("code")).alias("finding_codes"))
            .filter(F.col("n") >= limit)
            .select(F.concat(F.lit("repair:"), "severity", F.lit("-findings")).alias("id"),
                    F.lit(True).alias("dry_run"),
                    F.concat(F.col("n").cast("string"), F.lit(" "), F.col("severity"),
                             F.lit(" graph quality findings")).alias("reason"),
                    "finding_codes"))


def health_report(people, edges, claims, threads, now) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics, findings, findings per severity)."""
    findings = audit(people, edges, claims, now)
    return metrics(people, edges, claims, threads, now), findings, severity_summary(findings)


def connect_isolated(people: DataFrame, edges: DataFrame, candidates: DataFrame,
                     threshold: float = 0.8) -> DataFrame:
    """Add-edge patches from confident candidates that touch an isolated person."""
    isolated = people.select("id").join(endpoints(edges).select("id").distinct(), "id", "left_anti")
    ready = candidates.filter(F.col("confidence") >= threshold).withColumns({
        "source": tx.strip_person_prefix(F.col("source_id")),
        "target": tx.strip_person_prefix(F.col("target_id"))})
    for end in ["source", "target"]:
        ready = ready.join(isolated.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")),
                           end, "left")
    strength = F.greatest(F.lit(1), F.floor(F.col("confidence") * 5 + 0.5).cast("int"))
    return ready.filter("_source or _target").select(
        F.lit("add-edge").alias("action"),
        F.lit("Connect isolated node through validated high-confidence relationship candidate.")
        .alias("reason"),
        "source", "target", F.col("relationship_type").alias("type"),
        strength.alias("strength"), "confidence", F.lit("suggested").alias("status"))


def demote_weak(edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Update-edge patches that send weak unsupported edges back for sources."""
    weak = ((F.coalesce("confidence", F.lit(0.5)) < threshold) & (F.size(cited_sources()) == 0)
            & ~F.coalesce(F.col("status") == "needs_source", F.lit(False)))
    return edges.filter(weak).withColumns({
        "status": F.lit("needs_source"), "action": F.lit("update-edge"),
        "reason": F.lit("Demote weak unsupported edge to needs_source.")})


def attach_claims(edges: DataFrame, claims: DataFrame, reliability: float = 0.75) -> DataFrame:
    """(edge, claim) rows that would source accepted edges lacking sources."""
    relationship = F.coalesce("id", F.concat(
        F.lit("relationship:person:"), "source", F.lit(":"), "type", F.lit(":person:"), "target"))
    bare = edges.filter((F.col("status") == "accepted") & (F.size(cited_sources()) == 0)).select(
        "ord", relationship.alias("subject_id"))
    usable = claims.filter((F.col("subject_type") == "Relationship")
                           & (F.col("source_reliability") >= reliability)
                           & ~F.col("status").isin("rejected", "stale"))
    return bare.join(usable.select("subject_id", F.col("id").alias("claim_id")), "subject_id")


def is_source_gap() -> Column:
    return (F.coalesce(F.col("status") == "needs_source", F.lit(False))
            | (F.coalesce("confidence", F.lit(1.0)) < 0.5) | ~has_evidence())


def source_gap_people(people: DataFrame, edges: DataFrame) -> DataFrame:
    """People touching a source gap with their number of gap edges."""
    gaps = endpoints(edges.filter(is_source_gap()).select("source", "target"), loops_once=True)
    counts = gaps.groupBy("id").agg(F.count(F.lit(1)).alias("gap_edges"))
    return people.select("id").join(counts, "id")


def is_imported() -> Column:
    return (F.coalesce(F.col("movement") == "Imported", F.lit(False))
            | F.coalesce(F.col("notes").contains("Imported from"), F.lit(False)))


def review_facts(people: DataFrame, edges: DataFrame) -> DataFrame:
    """Per person: degree, gap edges, import flag and review status."""
    facts = endpoints(edges.withColumn("_gap", is_source_gap()), loops_once=True).groupBy(
        "id").agg(F.count(F.lit(1)).alias("degree"), F.count_if("_gap").alias("gap_edges"))
    df = people.join(facts, "id", "left").withColumns({
        "degree": F.coalesce("degree", F.lit(0).cast("long")),
        "gap_edges": F.coalesce("gap_edges", F.lit(0).cast("long")),
        "imported": is_imported()})
    untagged = F.size(listed("subfields")) == 0
    return df.withColumns({
        "untagged": untagged,
        "review_status": F.when(F.col("imported") & (F.col("degree") == 0), "Unlinked import")
        .when(F.col("gap_edges") > 0, "Needs source review").when(untagged, "Needs tags")
        .when(F.col("degree") == 0, "Orphan").when(F.col("degree") <= 1, "Sparse links")
        .when(F.col("imported"), "Imported linked").otherwise("Connected")})


def review_lists(people: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """First people of each review list; unlinked imports are listed in full."""
    facts = review_facts(people, edges)
    lists = {"unlinked": F.col("degree") == 0, "sparse": F.col("degree") == 1,
             "weakly-tagged": F.col("untagged")}
    parts = [facts.filter(c).orderBy("ord").limit(limit).select(F.lit(n).alias("list"), "id")
             for n, c in lists.items()]
    parts.append(facts.filter((F.col("degree") == 0) & F.col("imported")).select(
        F.lit("unlinked-import").alias("list"), "id"))
    return union_all(parts)


def field_report(people: DataFrame, edges: DataFrame) -> DataFrame:
    """Per field: people, isolated, metadata-only, sparse bridges and broad edges."""
    stated = edges.select(F.col("source").alias("id"), F.col("target").alias("other")).distinct()
    metadata = (people.select("id", F.explode("influenced").alias("other"))
                .join(stated, ["id", "other"], "left_anti").select("id").distinct()
                .withColumn("_metadata", F.lit(True)))
    facts = with_degree(people, edges, loops_once=True).join(metadata, "id", "left")
    alone = F.col("degree") == 0
    by_person = facts.withColumn("field", F.explode(F.array_distinct("fields"))).groupBy(
        "field").agg(
        F.count(F.lit(1)).alias("people"), F.count_if(alone).alias("isolated"),
        F.count_if(alone & F.coalesce("_metadata", F.lit(False))).alias("metadata_only"),
        F.count_if((F.coalesce("bridge_score", F.lit(0)) >= 4) & (F.col("degree") < 2))
        .alias("sparse_high_bridge"))
    fields = people.select("id", "fields")
    broad = (edges.filter(is_refinement_candidate()).select("source", "target")
             .join(fields.select(F.col("id").alias("source"), F.col("fields").alias("_a")),
                   "source", "left")
             .join(fields.select(F.col("id").alias("target"), F.col("fields").alias("_b")),
                   "target", "left"))
    touched = broad.select(F.explode(tx.merge_unique(F.col("_a"), F.col("_b"))).alias("field"))
    counts = touched.groupBy("field").agg(F.count(F.lit(1)).alias("refinement_candidates"))
    return by_person.join(counts, "field", "left").withColumn(
        "refinement_candidates", F.coalesce("refinement_candidates", F.lit(0).cast("long")))


def conflicting_pairs(edges: DataFrame) -> DataFrame:
    """Unordered pairs linked in both directions or by several types."""
    low, high = F.least("source", "target"), F.greatest("source", "target")
    forward = F.col("source") == F.col("low")
    return (edges.withColumns({"low": low, "high": high}).groupBy("low", "high").agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(forward).alias("_up"),
        F.count_if(~forward).alias("_down"), F.min("type").alias("_first"),
        F.max("type").alias("_last"))
        .filter("(_up > 0 and _down > 0) or _first <> _last").select("low", "high", "edges"))


def thread_coverage(people: DataFrame, threads: DataFrame) -> DataFrame:
    """Covered and total people per field and per era."""
    members = threads.select(F.explode("people").alias("id")).distinct().withColumn(
        "_in", F.lit(True))
    df = people.select("id", "fields", "era").join(members, "id", "left")
    inside = F.count_if(F.coalesce("_in", F.lit(False))).alias("covered")
    total = F.count(F.lit(1)).alias("total")
    by_field = df.withColumn("value", F.explode(F.array_distinct("fields"))).groupBy(
        "value").agg(inside, total).select(F.lit("field").alias("facet"), "value", "covered",
                                           "total")
    by_era = df.groupBy(F.col("era").alias("value")).agg(inside, total).select(
        F.lit("era").alias("facet"), "value", "covered", "total")
    return by_field.unionByName(by_era)


def missing_thread_people(people: DataFrame, threads: DataFrame) -> DataFrame:
    return threads.select(F.explode("people").alias("id")).distinct().join(
        people.select("id"), "id", "left_anti")
