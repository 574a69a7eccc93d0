"""Per-edge verdicts: structure, evidence, type rules, report lanes, repairs and gate.

Pair and claim statistics are aggregated first and joined back, so that a hot pair or
claim shrinks map-side and its join partition can be split at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import vocab



def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def listed(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def reasons(*cases: tuple[Column, str]) -> Column:
    """The messages whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in cases]))


def thousandths(value: Column) -> Column:
    return F.round(value * 1000).cast("long")


def is_directional(kind: Column) -> Column:
    return ~kind.isin(vocab.NON_DIRECTIONAL)


def pair_key(source: Column, target: Column, kind: Column) -> list[Column]:
    """Endpoints of the canonical key: unordered for non-directional types."""
    swap = ~is_directional(kind) & (source > target)
    return [F.when(swap, target).otherwise(source), F.when(swap, source).otherwise(target)]


def canonical_key(source="source", target="target", kind="type") -> Column:
    source, target, kind = F.col(source), F.col(target), F.col(kind)
    low, high = F.least(source, target), F.greatest(source, target)
    return F.when(is_directional(kind), F.concat(source, F.lit("->"), target, F.lit(":"), kind)
                  ).otherwise(F.concat(low, F.lit("<->"), high, F.lit(":"), kind))


def _last(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per id: the last by ``ord``, or the greatest where there is no order."""
    order = F.col("ord") if "ord" in df.columns else F.struct(*columns)
    kept = df.groupBy("id").agg(F.max_by(F.struct(*columns), order).alias("_last"))
    return kept.select("id", *[F.col("_last")[c].alias(c) for c in columns])


def structure(people: DataFrame, edges: DataFrame) -> DataFrame:
    """Endpoint, self-link, chronology, duplicate and type checks for each edge."""
    births = _last(people, ["birth"])
    source, target = F.col("source"), F.col("target")
    keyed = edges.withColumns({"_low": F.least(source, target),
                               "_high": F.greatest(source, target)})
    pairs = (keyed.groupBy("_low", "_high", "type")
             .agg(F.count_if(source == F.col("_low")).alias("_up"),
                  F.count_if(source != F.col("_low")).alias("_down")))
    joined = (
        keyed.join(pairs, ["_low", "_high", "type"], "left")
        .join(births.select(F.col("id").alias("source"), F.lit(True).alias("_has_source"),
                            F.col("birth").alias("_source_birth")), "source", "left")
        .join(births.select(F.col("id").alias("target"), F.lit(True).alias("_has_target"),
                            F.col("birth").alias("_target_birth")), "target", "left"))
    impossible = F.coalesce(is_directional(F.col("type")) & (
        F.col("_source_birth") > F.col("_target_birth") + 20), F.lit(False))
    same = F.when(source == F.col("_low"), F.col("_up")).otherwise(F.col("_down"))
    blocking = reasons(
        (F.col("_has_source").isNull(), "missing-source"),
        (F.col("_has_target").isNull(), "missing-target"),
        (source == target, "self-link"),
        (impossible, "impossible-chronology"),
        (same > 1, "duplicate-same-direction"),
        ((F.col("_up") > 0) & (F.col("_down") > 0), "duplicate-opposite-direction"),
        (~F.col("type").isin(vocab.VALID_RELATIONSHIPS), "invalid-relationship-type"))
    return with_structure(joined, blocking, impossible).drop(
        "_low", "_high", "_up", "_down", "_has_source", "_has_target", "_source_birth",
        "_target_birth")


def with_structure(checked: DataFrame, blocking: Column, impossible: Column) -> DataFrame:
    """The structural verdict of rows with these faults."""
    valid = F.size("blocking_reasons") == 0
    return (
        checked.withColumn("blocking_reasons", blocking)
        .withColumns({
            "origin": F.lit("existing-edge"),
            "structural_status": F.when(valid, "valid").otherwise("invalid"),
            "chronology_status": F.when(impossible, "impossible").otherwise("valid"),
            "evidence_status": F.lit("unsupported"),
            "source_claim_coverage": F.lit(0.0),
            "confidence_score": F.coalesce("confidence", F.lit(0.5)),
            "recommended_action": F.when(valid, "auto-investigate").otherwise("remove"),
            "final_disposition": F.when(~valid, "removed-existing-edge"),
        }))


def recency_days(observed_at: Column, now: Column) -> Column:
    """Whole days since observation, never negative; null without a date."""
    days = F.floor((F.unix_millis(now) - F.unix_millis(observed_at.cast("timestamp")))
                   / F.lit(86400000))
    return F.when(days < 0, F.lit(0).cast("long")).otherwise(days)


def claim_support(edges: DataFrame, claims: DataFrame, now: Column, texts: bool = False,
                  key: str = "ord") -> DataFrame:
    """Per edge: counts over the claims it cites and, if asked, their texts in order.

    The texts of one edge are as many as its own ``claim_ids`` array has entries.
    """
    stale = F.coalesce(F.col("status") == "stale", F.lit(False)) | (
        F.coalesce(recency_days(F.col("observed_at"), now), F.lit(0)) > 3650)
    words = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in ["field", "value", "source_name"]])
    dated = _last(claims.withColumns({"_old": stale, "_text": words}),
                  ["subject_type", "status", "_old", "_text"]).withColumnRenamed("id", "_claim")
    direct = F.col("subject_type") == "Relationship"
    columns = [
        F.count("subject_type").alias("n_attached"),
        F.count_if(direct).alias("n_direct"),
        F.count_if(direct & ~F.col("status").isin(vocab.DEAD_CLAIM_STATUSES)).alias("n_usable"),
        F.count_if("_old").alias("n_stale"),
        F.count_if(F.col("status").isin("rejected", "conflicting")).alias("n_refuted")]
    if texts:
        entries = F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_text", F.lit("")))))
        columns.append(F.transform(entries, lambda e: e["col2"]).alias("claim_texts"))
    return (edges.select(key, F.posexplode("claim_ids").alias("_pos", "_claim"))
            .join(dated, "_claim", "left").groupBy(key).agg(*columns))


# Fixed values: (pattern, relationship types, blocking reason) of the type rules.
TYPE_RULES = [
    ("explicit|influence|influenced|citation|reception|named mention|mentor|advisor|student",
     ["Influence", "person influenced person"], "direct-influence-needs-transmission-evidence"),
    ("indirect|precursor|reception|transmission|revived|anticipated|citation|influence",
     ["Indirect influence"], "indirect-influence-needs-mediated-evidence"),
    ("mentor|mentored|advisor|student|supervisor|tutor",
     ["Mentorship", "person mentored person"], "mentorship-needs-advisor-student-evidence"),
    ("collaborat|coauthor|co-author|correspondence|jointly|worked with",
     ["Collaboration", "person collaborated with person"],
     "collaboration-needs-shared-work-evidence"),
    ("source-context|source proximity|context|same source|neighbor|co-mentioned",
     ["Source-context neighbor"], "source-context-neighbor-needs-proximity-evidence"),
    ("parallel|independent|shared concept|concurrent|rival school",
     ["Parallel", "Parallel development"],
     "parallel-development-needs-non-transmission-evidence"),
]


COUNTS = ["n_attached", "n_direct", "n_usable", "n_stale", "n_refuted"]


def evidence(people: DataFrame, edges: DataFrame, claims: DataFrame, now: Column,
             rules: bool = False) -> DataFrame:
    """Structure plus evidence checks; ``rules`` adds the type-specific ones.

    Structurally invalid edges keep their structural verdict.
    """
    support = claim_support(edges, claims, now, texts=rules)
    df = structure(people, edges).join(support, "ord", "left").withColumns({
        "n_claims": F.size(listed("claim_ids")), "n_urls": F.size(listed("source_claims")),
        "in_thread": F.size(listed("thread_ids")) > 0})
    if rules:
        text = F.lower(F.concat_ws(" ", F.coalesce("note", F.lit("")), "source_claims",
                                   "claim_texts"))
        df = df.withColumns({f"hit_{n}": text.rlike(pattern)
                             for n, (pattern, _, _) in enumerate(TYPE_RULES)}).drop("claim_texts")
    return judge(df, rules)


def judge(df: DataFrame, rules: bool) -> DataFrame:
    """Verdicts from structural results, evidence counts and rule hits."""
    df = df.withColumns({c: F.coalesce(c, F.lit(0)) for c in [*COUNTS, "n_claims", "n_urls"]})
    n_urls = F.col("n_urls")
    n_refs = F.col("n_claims") + n_urls
    confidence = F.coalesce("confidence", F.lit(0.5))
    in_thread = F.col("in_thread")
    accepted = F.coalesce(F.col("status") == "accepted", F.lit(False))
    high_impact = accepted | (F.col("strength") >= 4) | in_thread
    weak = high_impact & (confidence < 0.75)
    # Rounded to thousandths in integers, halves up.
    coverage = F.when(n_refs == 0, F.lit(0)).otherwise(F.floor(
        ((F.col("n_usable") + n_urls) * 2000 + n_refs) / (n_refs * 2)))
    found = reasons(
        (n_refs == 0, "missing-source-evidence"),
        (F.col("n_stale") > 0, "stale-source-claim"),
        (accepted & (F.col("n_refuted") > 0), "rejected-or-conflicting-claim-on-accepted-edge"),
        (weak, "weak-confidence-high-impact-edge"),
        ((F.col("n_attached") > 0) & (F.col("n_direct") == 0), "endpoint-only-source-claims"))
    score = F.least(F.lit(1000), F.floor((thousandths(confidence) + F.col("_coverage") + 1) / 2))
    status = (F.when(F.col("n_refuted") > 0, "conflicting").when(weak, "weak")
              .when(F.col("_coverage") > 0, "supported").otherwise("unsupported"))
    df = df.withColumn("_coverage", coverage).withColumns({
        "_found": found, "_status": status, "_score": score / F.lit(1000.0)})
    confirmed = (F.col("_status") == "supported") & (F.size("_found") == 0)
    if rules:
        broken = [(F.col("type").isin(types) & ~F.coalesce(F.col(f"hit_{n}"), F.lit(False)),
                   reason) for n, (_, types, reason) in enumerate(TYPE_RULES)]
        broken.append((in_thread & ((confidence < 0.85) | (n_refs == 0)),
                       "canonical-thread-edge-needs-high-confidence-source-support"))
        df = df.withColumn("_broken", reasons(*broken))
        failed = F.size("_broken") > 0
        df = df.withColumns({
            "_found": F.concat("_found", "_broken"),
            "_status": F.when(failed & (F.col("_status") != "conflicting"), "weak")
            .otherwise(F.col("_status"))})
        confirmed = (F.col("_status") == "supported") & (F.size("_found") == 0)
    valid = F.col("structural_status") == "valid"
    confirmed = valid & confirmed
    return df.withColumns({
        "final_disposition": F.when(confirmed, "confirmed-existing-edge")
        .otherwise(F.col("final_disposition")),
        "recommended_action": F.when(confirmed, "confirm")
        .otherwise(F.col("recommended_action")),
        "evidence_status": F.when(valid, F.col("_status")).otherwise(F.col("evidence_status")),
        "source_claim_coverage": F.when(valid, F.col("_coverage") / F.lit(1000.0))
        .otherwise(F.col("source_claim_coverage")),
        "confidence_score": F.when(valid, F.col("_score")).otherwise(F.col("confidence_score")),
        "blocking_reasons": F.when(valid, F.col("_found")).otherwise(F.col("blocking_reasons")),
    }).drop("_coverage", "_found", "_status", "_score", "_broken", "n_claims", "n_urls",
            "in_thread", *COUNTS, *[f"hit_{n}" for n in range(len(TYPE_RULES))])


def relationship_rules(people, edges, claims, now) -> DataFrame:
    return evidence(people, edges, claims, now, rules=True)


def validate_candidates(people, candidates, claims, now) -> DataFrame:
    """The same checks over candidate edge rows, with add/discard dispositions."""
    return as_candidates(relationship_rules(people, candidates, claims, now))


def as_candidates(checked: DataFrame) -> DataFrame:
    """Existing-edge verdicts restated for discovered candidates."""
    disposition = F.col("final_disposition")
    mapped = (F.when(disposition == "confirmed-existing-edge", "added-confirmed-edge")
              .when(disposition == "removed-existing-edge", "discarded-candidate"))
    action = (F.when(disposition == "confirmed-existing-edge", "add")
              .when(disposition == "removed-existing-edge", "discard")
              .otherwise(F.col("recommended_action")))
    return checked.withColumns({"origin": F.lit("discovered-candidate"),
                                "recommended_action": action, "final_disposition": mapped})


def validate_discovered(people: DataFrame, candidates: DataFrame, rows: DataFrame,
                        claims: DataFrame, now: Column) -> DataFrame:
    """Validate merged candidates against their evidence rows (``missing_edges``).

    Evidence stays one row per item, so counts and rule hits are aggregated map-side
    and a candidate backed by very many claims needs no array.
    """
    keys = ["key_a", "key_b", "type"]
    facts = claims.select(
        F.col("id").alias("claim_id"), "subject_type", "status",
        (F.coalesce(F.col("status") == "stale", F.lit(False))
         | (F.coalesce(recency_days(F.col("observed_at"), now), F.lit(0)) > 3650)).alias("_old"),
        F.concat_ws(" ", "field", "value", "source_name").alias("_text"))
    direct = F.col("subject_type") == "Relationship"
    text = F.lower(F.concat_ws(" ", "note", "url", "_text"))
    # A rule only matters for its own types.
    hits = [F.max(F.when(F.col("type").isin(types), text.rlike(p))).alias(f"hit_{n}")
            for n, (p, types, _) in enumerate(TYPE_RULES)]
    listed_rows = rows.select(*keys, "claim_id", "url", "thread_id", "note")
    # Rows without a claim have nothing to look up, and would all meet in one task.
    told = listed_rows.filter("claim_id is not null").join(facts, "claim_id", "left").unionByName(
        listed_rows.filter("claim_id is null"), allowMissingColumns=True)
    support = told.groupBy(*keys).agg(
        F.count("subject_type").alias("n_attached"), F.count_if(direct).alias("n_direct"),
        F.count_if(direct & ~F.col("status").isin(vocab.DEAD_CLAIM_STATUSES)).alias("n_usable"),
        F.count_if("_old").alias("n_stale"),
        F.count_if(F.col("status").isin("rejected", "conflicting")).alias("n_refuted"),
        F.count("claim_id").alias("n_claims"), F.count("url").alias("n_urls"),
        (F.count("thread_id") > 0).alias("in_thread"), *hits)
    ready = candidates.drop("n_claims", "n_threads").withColumn("status", F.lit("suggested"))
    return as_candidates(judge(structure(people, ready).join(support, keys, "left"), True))


def validate_lone(candidates: DataFrame) -> DataFrame:
    """Verdicts of candidates between known people that one note alone states: no claim, url
    or thread, and no other candidate of the pair and type. ``candidates(type, strength,
    confidence, note)`` with a non-directional type."""
    text = F.lower("note")
    unknown = ~F.col("type").isin(vocab.VALID_RELATIONSHIPS)
    zero = F.lit(0).cast("long")
    return as_candidates(judge(with_structure(candidates.withColumns({
        "status": F.lit("suggested"), "in_thread": F.lit(False),
        **{c: zero for c in [*COUNTS, "n_claims", "n_urls"]},
        **{f"hit_{n}": text.rlike(p) for n, (p, _, _) in enumerate(TYPE_RULES)}}),
        reasons((unknown, "invalid-relationship-type")), F.lit(False)), True))


def report_lane() -> Column:
    """Lane of a result row; null when no lane applies."""
    conflict = (F.col("evidence_status") == "conflicting") | F.exists(
        "blocking_reasons", lambda r: r.contains("conflict"))
    return (F.when(F.col("final_disposition").isNotNull(), F.col("final_disposition"))
            .when(conflict, "auto-resolving-conflict")
            .when(F.col("recommended_action") == "auto-investigate",
                  "auto-investigating-missing-source"))


def report(results: DataFrame) -> DataFrame:
    return results.withColumn("lane", report_lane())


def report_summary(results: DataFrame) -> DataFrame:
    return report(results).groupBy("lane").agg(F.count(F.lit(1)).alias("results"))


# Lane -> (decision id prefix, action, default reason).
REPAIRS = {
    "added-confirmed-edge": ("add", "add-edge", "Add automatically confirmed missing edge."),
    "removed-existing-edge": ("remove", "remove-edge",
                              "Remove invalid or unsupported existing edge."),
    "discarded-candidate": ("discard", "discard-candidate",
                            "Discard invalid discovered candidate."),
    "auto-investigating-missing-source": (
        "investigate", "auto-investigate-source",
        "Acquire stronger source evidence before final disposition."),
    "auto-resolving-conflict": ("conflict", "auto-resolve-conflict",
                                "Resolve conflicting evidence before final disposition."),
}


def repair_decisions(results: DataFrame) -> DataFrame:
    """One dry-run decision per result outside the confirmed lane."""
    lane = F.col("lane")

    def pick(position):
        chain = None
        for name, values in REPAIRS.items():
            value = F.lit(values[position])
            chain = (F.when(lane == name, value) if chain is None
                     else chain.when(lane == name, value))
        return chain

    joined = F.nullif(F.array_join("blocking_reasons", "; "), F.lit(""))
    return (report(results).filter(lane.isin(list(REPAIRS)))
            .withColumns({
                "decision_id": F.concat(F.lit("repair:"), pick(0), F.lit(":"), F.col("id")),
                "action": pick(1), "dry_run": F.lit(True),
                "reason": F.when(lane == "added-confirmed-edge", pick(2))
                .otherwise(F.coalesce(joined, pick(2)))}))


def unresolved(results: DataFrame) -> DataFrame:
    """Results that keep the acceptance gate closed."""
    settled = F.when(F.col("origin") == "existing-edge", F.col("final_disposition").isin(
        "confirmed-existing-edge", "removed-existing-edge")).otherwise(
        F.col("final_disposition").isin("added-confirmed-edge", "discarded-candidate"))
    return results.filter(~F.coalesce(settled, F.lit(False)))


def acceptance_gate(results: DataFrame) -> DataFrame:
    count = unresolved(results).agg(F.count(F.lit(1)).alias("unresolved"))
    return count.select(
        (F.col("unresolved") == 0).alias("passed"), "unresolved",
        F.when(F.col("unresolved") == 0, "Bulk edge validation acceptance gate passed.")
        .otherwise(F.concat(F.lit("Bulk edge validation acceptance gate failed for "),
                            F.col("unresolved").cast("string"),
                            F.lit(" unresolved result(s)."))).alias("message"))


def require_all_confirmed(results: DataFrame) -> DataFrame:
    """The batch gate: one row when every edge is confirmed, an error otherwise."""
    bad = F.count_if(~F.coalesce(
        F.col("final_disposition") == "confirmed-existing-edge", F.lit(False)))
    return results.agg(F.count(F.lit(1)).alias("edges"), bad.alias("unconfirmed")).withColumn(
        "passed", F.when(F.col("unconfirmed") > 0, F.raise_error(F.concat(
            F.col("unconfirmed").cast("string"), F.lit(" edges are not confirmed"))))
        .otherwise(F.lit(True)))


def promote(edges: DataFrame, candidate_results: DataFrame) -> DataFrame:
    """Existing edges plus confirmed candidates whose key is new."""
    key = canonical_key()
    existing = edges.select(key.alias("_key")).distinct()
    note = F.concat_ws(" ", "note", F.lit("Added by bulk edge validation."))
    added = (
        candidate_results
        .filter((F.col("origin") == "discovered-candidate")
                & (F.col("final_disposition") == "added-confirmed-edge"))
        .withColumn("_key", key).join(existing, "_key", "left_anti")
        .withColumns({"id": F.regexp_replace("id", "^candidate:", "edge:"),
                      "status": F.lit("accepted"),
                      "confidence": F.coalesce("confidence", F.lit(0.85)), "note": note})
        .select(*edges.columns))
    return edges.unionByName(added)


def source_gaps(relationships: DataFrame, claims: DataFrame) -> DataFrame:
    """Relationships without a claim that is neither rejected nor stale."""
    supported = (claims.filter((F.col("subject_type") == "Relationship")
                               & ~F.col("status").isin("rejected", "stale"))
                 .select(F.col("subject_id").alias("id")).distinct())
    return relationships.join(supported, "id", "left_anti")


# Ordered (pattern, refined type) and the types that get refined.
REFINED_TYPES = [
    ("mentor|advisor|supervisor|student|tutor|succeeded as head|direct .*teacher", "Mentorship"),
    ("collaboration|collaborat|co-created|co-developed|co-authored|correspondence|friendship"
     "|rivalry|worked with", "Collaboration"),
    ("parallel|independent|concurrent|rival school|contrast|challenged", "Parallel development"),
    ("source-context|context|transmission|translation|translated|preserved|revived|precursor"
     "|anticipated|thread bridge|maps to|fed ", "Source-context neighbor"),
]
BROAD_TYPES = ["Influence", "Indirect influence", "Recorded influence", "Parallel"]


def refined_type(kind: Column, note: Column) -> Column:
    text = F.lower(F.concat(kind, F.lit(" "), F.coalesce(note, F.lit(""))))
    chain = None
    for pattern, label in REFINED_TYPES:
        hit = text.rlike(pattern)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise("Influence")


def is_refinement_candidate() -> Column:
    refined = refined_type(F.col("type"), F.col("note"))
    return F.col("type").isin(BROAD_TYPES) & (refined != "Influence") & (refined != F.col("type"))
