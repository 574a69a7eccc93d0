"""Canonical dataset build: repairs, merges, changelog, manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text as tx
from evigraph.functions import vocab
from evigraph.operators import normalize as nz

CLAIM_FIELDS = ["source_name", "source_url", "source_type", "source_reliability",
                "extraction_method", "subject_id", "subject_type", "field", "value",
                "confidence", "status"]


def edge_key() -> Column:
    return F.coalesce("id", F.concat("source", F.lit("->"), "target", F.lit(":"), "type"))


def claim_changelog(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Added, conflicting, rejected, demoted and changed claims; the first that fits."""
    ranks = F.create_map(*[F.lit(x) for kv in vocab.CLAIM_STATUS_RANK.items() for x in kv])
    old = previous.select("id", F.struct(*CLAIM_FIELDS).alias("_old"))
    df = current.join(old, "id", "left")
    was, now = F.col("_old.status"), F.col("status")
    turned = lambda s: (now == s) & (was != s)
    kind = (F.when(F.col("_old").isNull(), "added")
            .when(turned("conflicting"), "conflicting").when(turned("rejected"), "rejected")
            .when(ranks[now] < ranks[was], "demoted")
            .when(~F.struct(*CLAIM_FIELDS).eqNullSafe(F.col("_old")), "changed"))
    return df.withColumn("change", kind).filter("change is not null").select(
        F.col("id").alias("claim_id"), "change", "subject_id", "subject_type", "field",
        was.alias("previous_status"), now.alias("current_status"))


def apply_repairs(edges: DataFrame, patches: DataFrame) -> DataFrame:
    """Edges after accepted patches, replayed in decision and diff order.

    ``patches`` has the edge columns plus ``decision_id``, ``accepted``, ``diff`` and
    ``action``. A null patch column leaves the value alone. An add creates a missing
    key once; updates before it are ignored, later ones overlay it. Per key this needs
    only aggregates: the first add, and the last non-null value among valid updates.
    """
    columns = [c for c in edges.columns]
    order = F.struct("decision_id", "diff")
    done = patches.filter("accepted").withColumn("_key", edge_key()).withColumn("_order", order)
    # The first edge of a key is the one a patch meets.
    existing = edges.withColumn("_key", edge_key())
    first_ord = existing.groupBy("_key").agg(F.min("ord").alias("_first"))
    adds = done.filter("action = 'add-edge'").groupBy("_key").agg(
        F.min_by(F.struct(*columns), "_order").alias("_added"), F.min("_order").alias("_at"))
    base = first_ord.join(adds, "_key", "full_outer").select(
        "_key", "_first", F.when(F.col("_first").isNull(), F.col("_added")).alias("_added"),
        F.when(F.col("_first").isNull(), F.col("_at")).alias("_at"))
    # An update also applies when its own key was added earlier in the replay.
    live = done.filter("action = 'update-edge'").join(
        base.select("_key", "_first", "_at"), "_key").filter(
        F.col("_first").isNotNull() | (F.col("_at") < F.col("_order")))
    overlay = live.groupBy("_key").agg(*[
        F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(c).isNotNull(), F.col("_order")))
        .alias(f"_u_{c}") for c in columns])
    updated = [F.coalesce(F.col(f"_u_{c}.v"), F.col(c)).alias(c) for c in columns]
    touched = existing.join(first_ord, "_key").join(overlay, "_key", "left")
    is_first = F.col("ord") == F.col("_first")
    kept = touched.select(*[F.when(is_first, F.coalesce(F.col(f"_u_{c}.v"), F.col(c)))
                            .otherwise(F.col(c)).alias(c) for c in columns])
    created = base.filter("_added is not null").select("_key", "_added.*").join(
        overlay, "_key", "left").select(*updated)
    return kept.unionByName(created)


def merge_people(stored: DataFrame, canonical: DataFrame, retired: DataFrame) -> DataFrame:
    """Stored people without retired ids, imports enriched by canonical rows, and the
    canonical people that are missing."""
    own = stored.join(retired.select("id"), "id", "left_anti")
    columns = [c for c in stored.columns if c != "id"]
    known = canonical.select("id", F.struct(*columns).alias("_c"))
    df = own.join(known, "id", "left")
    imported = (F.coalesce(F.col("movement") == "Imported", F.lit(False))
                | F.coalesce(F.col("notes").rlike("(?i)Imported from Wikidata"), F.lit(False)))
    enrich = imported & F.col("_c").isNotNull()
    filled = lambda c: F.coalesce(F.nullif(F.col(f"_c.{c}"), F.lit("")), F.col(c))
    notes = tx.strip_import_notes(F.col("notes"))
    merged = {
        **{c: F.col(f"_c.{c}") for c in ["name", "birth", "death"]},
        **{c: tx.merge_unique(F.col(f"_c.{c}"), F.col(c)) for c in ["fields", "subfields", "works"]
           if c in columns},
        **{c: filled(c) for c in ["region", "era", "movement"]},
        "bridge_score": F.greatest(F.coalesce("_c.bridge_score", F.lit(0)),
                                   F.coalesce("bridge_score", F.lit(0))),
        "notes": F.coalesce(F.nullif(F.col("_c.notes"), F.lit("")), notes)}
    plain = {c: F.col(c) for c in columns} | {"notes": notes}
    rows = df.select("id", *[F.when(enrich, merged.get(c, F.col(c))).otherwise(plain[c]).alias(c)
                             for c in columns])
    missing = canonical.join(own.select("id"), "id", "left_anti").select(*stored.columns)
    return rows.unionByName(missing)


def merge_edges(stored: DataFrame, canonical: DataFrame, people: DataFrame,
                retired: DataFrame) -> DataFrame:
    """Union of both edge sets by typed endpoints and type with united evidence.

    A local rejection stands; accepted edges without evidence are dropped.
    """
    keys = ["source_type", "source", "target_type", "target", "type"]
    mine, _ = nz.edges(stored, people)
    seed, _ = nz.edges(canonical, people)
    for end in ["source", "target"]:
        mine = mine.join(retired.select(F.col("id").alias(end)), end, "left_anti")
    rest = [c for c in stored.columns if c not in keys]
    last = lambda df, name: nz.last_per(df, keys, F.col("ord")).select(
        *keys, F.struct(*rest).alias(name))
    # A repeated seed key unites evidence again, so seed lists are united per key.
    lists = ["source_claims", "claim_ids", "thread_ids"]
    united = reduce(lambda a, b: a.join(b, keys, "full_outer"), [
        seed.select(*keys, F.explode(c).alias("v")).groupBy(*keys).agg(
            F.array_sort(F.collect_set("v")).alias(f"_seed_{c}")) for c in lists])
    best = seed.groupBy(*keys).agg(F.max("confidence").alias("_best"), F.max(
        F.col("status") == "accepted").alias("_any_accepted"))
    both = (last(mine, "a").join(last(seed, "b"), keys, "full_outer").join(best, keys, "left")
            .join(united, keys, "left"))
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()
    confidence = F.nullif(F.greatest(F.coalesce("a.confidence", F.lit(0.0)),
                                     F.coalesce("_best", F.lit(0.0))), F.lit(0.0))
    joined = {c: tx.merge_unique(F.col(f"a.{c}"), F.col(f"_seed_{c}")) for c in lists}
    evidence = (F.size(joined["source_claims"]) > 0) | (F.size(joined["claim_ids"]) > 0)
    wanted = F.when(F.col("_any_accepted") | (F.col("a.status") == "accepted"), "accepted"
                    ).otherwise(F.col("a.status"))
    status = F.when(F.col("a.status") == "rejected", "rejected").otherwise(
        nz.edge_status(wanted, confidence, evidence))
    made = {"confidence": confidence, "status": status, **joined}
    one = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))
    rows = both.select(*keys, *[F.when(paired, made[c]).otherwise(one(c)).alias(c)
                                if c in made else one(c).alias(c) for c in rest])
    return rows.filter((F.col("status") != "accepted") | nz.has_evidence()).select(
        *stored.columns)


def fingerprint(df: DataFrame, columns: list[str]) -> Column:
    """Order-free content digest of a table, as one aggregate."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    digest = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.sum(digest % 1000003)


def manifest(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(table, rows, fingerprint) of every input or output lane."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(fingerprint(df, cols), F.lit(0))
               .alias("fingerprint")).select(F.lit(name).alias("table"), "rows", "fingerprint")
        for name, (df, cols) in tables.items()])


def build(people: DataFrame, edges: DataFrame, claims: DataFrame, patches: DataFrame,
          overrides: DataFrame | None = None) -> dict[str, DataFrame]:
    """Canonical tables sorted by key and their manifest; overrides are only counted."""
    repaired = apply_repairs(edges, patches)
    lanes = {"people": (people, ["id"]), "edges": (repaired, ["id", "source", "target"]),
             "claims": (claims, ["id", "status"])}
    if overrides is not None:
        lanes["manual_overrides"] = (overrides, ["id"])
    return {"people": people.sort("id"), "edges": repaired.sort(edge_key()),
            "claims": claims.sort("id"), "manifest": manifest(lanes)}
