"""Claim confidence, acceptance thresholds and decisions, and claim roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import vocab
from evigraph.operators.edge_validation import reasons, recency_days

# Component weights in hundredths.
CONFIDENCE_WEIGHTS = {
    "identity": 20, "factual": 20, "relationship": 20, "source_quality": 15, "extraction": 10,
    "graph_consistency": 15,
}


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def composed_confidence(components: dict[str, Column]) -> Column:
    """Weighted confidence in thousandths precision; missing components count one half."""
    total = F.lit(0)
    for name, weight in CONFIDENCE_WEIGHTS.items():
        value = clamp01(F.coalesce(components.get(name, F.lit(None).cast("double")), F.lit(0.5)))
        total = total + F.round(value * 100000).cast("long") * weight
    return F.floor((total + 5000) / F.lit(10000)) / F.lit(1000.0)


def _flags(modifiers: dict[str, str], weights: dict[str, int]) -> Column:
    """Sum of the modifiers' thousandths whose flag column is set."""
    total = F.lit(0)
    for modifier, column in modifiers.items():
        total = total + F.when(F.coalesce(F.col(column), F.lit(False)),
                               weights[modifier] * 10).otherwise(0)
    return total


def thresholds(claim_type: Column, strict: dict[str, str] | None = None,
               loose: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(accept, provisional) of a claim type; flag columns tighten or relax them.

    ``strict`` and ``loose`` map modifier names to boolean column names.
    """
    table = F.create_map(*[
        x for kind, (accept, provisional) in vocab.ACCEPTANCE_HUNDREDTHS.items()
        for x in (F.lit(kind), F.struct(F.lit(accept).alias("a"), F.lit(provisional).alias("p")))])
    accept, provisional = table[claim_type]["a"] * 10, table[claim_type]["p"] * 10
    if strict:
        up = _flags(strict, vocab.STRICT_HUNDREDTHS)
        accept = F.least(F.lit(990), accept + up)
        provisional = F.least(F.lit(950), provisional + (up / 2).cast("int"))
    if loose:
        down = _flags(loose, vocab.LOOSE_HUNDREDTHS)
        accept = F.greatest(F.lit(500), accept - down)
        provisional = F.greatest(F.lit(350), provisional - (down / 2).cast("int"))
    return accept / F.lit(1000.0), provisional / F.lit(1000.0)


def rejection_reasons(source: Column, target: Column, kind: Column, source_birth: Column,
                      target_birth: Column, opposite: Column, evidence: Column) -> Column:
    """Reasons that reject a relationship outright."""
    text = F.lower(F.array_join(evidence, " "))
    shared_only = (
        (kind == "person influenced person") & (F.size(evidence) > 0)
        & F.forall(evidence, lambda e: F.lower(e).contains("shared"))
        & ~text.rlike("explicit|citation|reception"))
    return reasons(
        (source == target, "self-link"),
        (F.coalesce(source_birth > target_birth + 20, F.lit(False)), "impossible-chronology"),
        (F.coalesce(opposite, F.lit(False)), "duplicate-opposite-direction"),
        (shared_only, "unsupported-direct-influence-from-shared-tags"))


def decide(df: DataFrame, policy_name: str, accepted_at: Column, dry_run: bool = False,
           score="score", accept="accept", provisional="provisional",
           rejections="rejection_reasons") -> DataFrame:
    """Add ``decision`` and, for real acceptances, ``policy_metadata``."""
    rejected = F.size(F.coalesce(F.col(rejections), F.array().cast("array<string>"))) > 0
    passes = ~rejected & (F.col(score) >= F.col(accept))
    decision = (F.when(rejected, "rejected").when(passes, "accepted")
                .when(F.col(score) >= F.col(provisional), "provisional").otherwise("rejected"))
    metadata = F.when(passes & F.lit(not dry_run), F.struct(
        F.lit(True).alias("accepted_by_policy"), F.lit(policy_name).alias("policy_name"),
        accepted_at.alias("accepted_at"), F.col(score).alias("score"),
        F.col(accept).alias("threshold")))
    return df.withColumns({"decision": decision, "dry_run": F.lit(dry_run),
                           "policy_metadata": metadata})


def claim_rollup(claims: DataFrame, list_ids: bool = False) -> DataFrame:
    """Per subject: claim count, count per status and average confidence.

    ``list_ids`` also gathers the claim ids, which grows with the subject; leave it off
    when a subject may own a large share of the claims and use ``claims_of`` instead.
    """
    columns = [F.count(F.lit(1)).alias("claims")]
    columns += [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in vocab.CLAIM_STATUSES]
    columns.append((F.sum(F.col("confidence").cast("decimal(18,6)")).cast("double")
                    / F.count(F.lit(1))).alias("average_confidence"))
    if list_ids:
        columns.append(F.array_sort(F.collect_list("id")).alias("claim_ids"))
    return claims.groupBy("subject_type", "subject_id").agg(*columns)


def claims_of(claims: DataFrame, subjects: DataFrame) -> DataFrame:
    """Claim ids of the given (subject_type, subject_id) rows."""
    return claims.join(subjects.select("subject_type", "subject_id").distinct(),
                       ["subject_type", "subject_id"], "left_semi").select(
        "subject_type", "subject_id", F.col("id").alias("claim_id"))


def claim_recency(claims: DataFrame, now: Column) -> DataFrame:
    return claims.withColumn("recency_days", recency_days(F.col("observed_at"), now))


# Adapter run states.
RUN_STATUSES = ["completed", "failed", "held"]


def adapter_run_summary(runs: DataFrame) -> DataFrame:
    """One row: all runs, runs per settled status, and the latest run time."""
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_runs") for s in RUN_STATUSES],
        F.max(F.nullif(F.col("run_at"), F.lit(""))).alias("latest_run_at"),
        F.count_if((F.col("status") == "failed")
                   & (F.coalesce("error_message", F.lit("")) != "")).alias("errors"))


def failed_adapter_runs(runs: DataFrame) -> DataFrame:
    return runs.filter((F.col("status") == "failed")
                       & (F.coalesce("error_message", F.lit("")) != "")).select(
        "adapter_id", "adapter_name", "error_message")
