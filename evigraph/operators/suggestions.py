"""Contextual link suggestions: imported candidates to people, and person to person.

Pairs come from equal-key joins on signals that can decide a place, never from a cross
product. Person-to-person suggestions answer for the people the caller selects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import taxonomy as tax
from evigraph.functions import text as tx
from evigraph.operators.edge_validation import listed, reasons
from evigraph.operators.entities import drafts
from evigraph.operators.signal_join import top_matches
from evigraph.session import cut_lineage

# External name lists of a candidate and the reason each gives.
NAME_CLAIMS = {
    "influenced_by": "Wikidata influenced by", "advisors": "Wikidata advisor",
    "students": "Wikidata student", "employers": "Wikidata employer",
    "educated_at": "Wikidata educated at", "member_of": "Wikidata member of",
}


def _list(df: DataFrame, column: str) -> Column:
    return listed(column) if column in df.columns else F.array().cast("array<string>")


def with_lens(people: DataFrame) -> DataFrame:
    """People with lens tags and evidence tokens."""
    text = F.concat_ws(" ", "notes", "movement", "works", "subfields")
    return people.withColumns({"lens": tax.person_lens_tags(),
                               "tokens": tx.evidence_tokens(text)})


def candidate_facts(candidates: DataFrame) -> DataFrame:
    """Draft attributes, lens tags, tokens and name claims of each candidate."""
    claims = [_list(candidates, c) for c in NAME_CLAIMS]
    text = F.concat_ws(" ", "description", "movement", _list(candidates, "works"),
                       _list(candidates, "topics"), *claims)
    raw = candidates.select(
        F.col("id").alias("candidate_id"), F.col("ord").alias("c_ord"),
        F.col("birth").alias("c_birth"),
        F.col("death").alias("c_death"), F.col("movement").alias("c_movement"),
        F.col("era").alias("c_era"), F.col("region").alias("c_region"),
        tx.key_set(_list(candidates, "works"), tx.name_key).alias("c_works"),
        tx.evidence_tokens(text).alias("c_tokens"),
        *[tx.key_set(_list(candidates, c), tx.name_key).alias(f"c_{c}") for c in NAME_CLAIMS])
    draft = drafts(candidates).withColumn("lens", tax.person_lens_tags()).select(
        F.col("id").alias("candidate_id"), F.array_distinct("fields").alias("c_fields"),
        F.array_distinct("subfields").alias("c_topics"), F.col("lens").alias("c_lens"))
    return raw.join(draft, "candidate_id")


def _signals(kinds: dict[str, Column]) -> Column:
    """``kind=value`` keys of the given arrays."""
    def tagged(kind, values):
        return F.transform(values, lambda v: F.concat(F.lit(f"{kind}="), v))

    return F.array_distinct(F.concat(*[tagged(k, v) for k, v in kinds.items()]))


def _one(column: str) -> Column:
    return F.array_compact(F.array(F.nullif(F.col(column), F.lit(""))))


# Signal -> points in halves; tokens count at most three times.
SIGNAL_POINTS = {"f": 8, "t": 6, "l": 4, "m": 8, "e": 4, "r": 3, "k": 10, "n": 16, "w": 3}
MAX_TOKENS = 3


def _keyed(entries: dict[str, tuple[str, Column]]) -> Column:
    """Array of (key, points, kind flags) structs from name -> (signal, values)."""
    def rows(name, signal, values):
        flags = FLAGS.get(name, FLAGS.get(signal, 0))
        return F.transform(values, lambda v: F.struct(
            F.concat(F.lit(f"{signal}="), v).alias("k"),
            F.lit(0 if signal == "w" else SIGNAL_POINTS[signal]).alias("points"),
            F.lit(1 if signal == "w" else 0).alias("token"), F.lit(flags).alias("flags")))

    return F.concat(*[rows(n, s, v) for n, (s, v) in entries.items()])


# Bits of what a pair shares: one per name claim, then works and context.
FLAGS = {claim: 1 << n for n, claim in enumerate(NAME_CLAIMS)}
FLAGS.update({"k": 1 << 6, "f": 1 << 7, "t": 1 << 7, "l": 1 << 7})
CLAIM_BITS = (1 << 6) - 1


def asked_signals(candidates: DataFrame) -> DataFrame:
    """Signals of each candidate, keyed by ``ord``."""
    facts = candidate_facts(candidates)
    given = {"fields": ("f", F.col("c_fields")), "topics": ("t", F.col("c_topics")),
             "lens": ("l", F.col("c_lens")), "tokens": ("w", F.col("c_tokens")),
             "works": ("k", F.col("c_works")), "movement": ("m", _one("c_movement")),
             "era": ("e", _one("c_era")), "region": ("r", _one("c_region"))}
    given.update({c: ("n", F.col(f"c_{c}")) for c in NAME_CLAIMS})
    return facts.select("c_ord", "c_birth", "c_death", _keyed(given).alias("signals"))


def held_signals(people: DataFrame) -> DataFrame:
    """Signals of each person, keyed by ``ord``."""
    works = F.filter(F.transform(listed("works"), tx.name_key), lambda k: k != "")
    kept = {"name": ("n", F.array(tx.name_key(F.col("name")))), "works": ("k", works),
            "fields": ("f", F.col("fields")), "topics": ("t", listed("subfields")),
            "lens": ("l", F.col("lens")), "tokens": ("w", F.col("tokens")),
            "movement": ("m", _one("movement")), "era": ("e", _one("era")),
            "region": ("r", _one("region"))}
    return with_lens(people).select(
        F.col("ord").alias("p_ord"), "birth", "death",
        F.transform(_keyed(kept), lambda x: x["k"]).alias("keys"))


def banded(rated: DataFrame) -> DataFrame:
    """Confidence band, category and explanation of rated pairs."""
    has = lambda bits: F.col("flags").bitwiseAND(bits) > 0
    claimed = lambda *cs: has(sum(FLAGS[c] for c in cs))
    strength = F.when(F.col("score") >= 12, "strong").when(F.col("score") >= 7, "medium"
                                                          ).otherwise("weak")
    category = (F.when(claimed("advisors", "students"), "direct mentorship")
                .when(claimed("influenced_by"), "likely influence")
                .when(has(FLAGS["k"]) | claimed("employers", "educated_at", "member_of"),
                      "collaboration")
                .when(strength == "weak", "needs review")
                .when((F.col("gap") <= 40) & has(FLAGS["f"]), "parallel development")
                .otherwise("source-context neighbor"))
    explanation = (F.when(has(CLAIM_BITS), "direct Wikidata claim")
                   .when(strength == "strong", "multiple matching signals")
                   .when(strength == "medium", "shared context signals")
                   .otherwise("thin evidence"))
    return rated.withColumns({"confidence": strength, "explanation": explanation,
                              "category": category})


def candidate_suggestions(candidates: DataFrame, people: DataFrame,
                          rejected: DataFrame | None = None, cutoff: float = 4.0,
                          limit: int = 5) -> DataFrame:
    """Best ``limit`` people per candidate at or above the cutoff, none of his rejected ones.

    See ``signal_join``: pairs meet through signals rare enough to matter, and only where
    the bound of a signature of equal people reaches what the candidate has already.
    """
    mine = candidates.select(F.col("ord").alias("c_ord"), F.col("id").alias("candidate_id"))
    theirs = people.select(F.col("ord").alias("p_ord"), F.col("id").alias("person_id"))
    refused = None
    if rejected is not None:
        refused = rejected.join(mine, "candidate_id").join(theirs, "person_id").select(
            "c_ord", "p_ord")
    asked = cut_lineage(asked_signals(candidates))
    top = top_matches(asked, held_signals(people), limit, 2 * cutoff, SIGNAL_POINTS["w"],
                      MAX_TOKENS, refused)
    return banded(top).join(mine, "c_ord").join(theirs, "p_ord").select(
        "candidate_id", "person_id", "position", "score", "confidence", "explanation",
        "category", "gap", "flags")


def with_reasons(suggestions: DataFrame, candidates: DataFrame, people: DataFrame) -> DataFrame:
    """Readable reasons of chosen suggestions, looked up for those pairs only."""
    facts = candidate_facts(candidates)
    mine = with_lens(people).withColumnRenamed("id", "person_id")
    df = suggestions.join(facts, "candidate_id").join(mine, "person_id")
    hit = lambda values, given: F.filter(values, lambda v: F.array_contains(given, v))

    def tagged(tag, values, count, label=lambda v: v):
        return F.transform(F.slice(values, 1, count),
                           lambda v: F.concat(F.lit(f"{tag}: "), label(v)))

    claim_bits = reasons(*[(F.col("flags").bitwiseAND(1 << n) > 0, why)
                           for n, why in enumerate(NAME_CLAIMS.values())])
    works = F.filter(listed("works"), lambda w: F.array_contains(F.col("c_works"),
                                                                tx.name_key(w)))
    same = lambda c: F.coalesce((F.col(f"c_{c}") == F.col(c)) & (F.col(c) != ""),
                                F.lit(False))
    timely = F.when(F.col("birth") <= F.col("c_birth"), "candidate may inherit from this node"
                    ).otherwise("candidate may precede this node")
    tail = F.array_compact(F.array(
        *[F.when(same(c), F.concat(F.lit(f"{c}: "), c)) for c in ["movement", "era", "region"]],
        F.when(F.col("c_birth").isNotNull() & (F.col("gap") <= 300),
               F.concat(F.lit("chronology: "), timely))))
    return df.select(*suggestions.columns, F.concat(
        claim_bits, tagged("field", hit(F.col("fields"), F.col("c_fields")), 2),
        tagged("topic", hit(listed("subfields"), F.col("c_topics")), 2),
        tagged("lens", F.array_intersect("lens", "c_lens"), 2, tax.lens_label),
        tagged("work", works, 1), tagged("source term", F.array_intersect(
            "c_tokens", "tokens"), 2), tail).alias("reasons"))


def _shared(array: str, other: str) -> Column:
    """How many entries of the person's array the other list has, counting repeats."""
    return F.size(F.filter(listed(array), lambda v: F.array_contains(F.col(other), v)))


def link_suggestions(people: DataFrame, focus: DataFrame, edges: DataFrame,
                     rejected: DataFrame | None = None, limit: int = 8) -> DataFrame:
    """Best unlinked people for each selected person, scored by shared context.

    Work grows with people times selected people; the selection joins by signal, so a
    small one is broadcast by its size and a large one is shuffled.
    """
    ready = people.withColumn("lens", tax.person_lens_tags()).select(
        "id", "ord", "birth", "death", "fields", "subfields", "era", "lens")
    keys = _signals({"f": F.col("fields"), "t": listed("subfields"), "l": F.col("lens"),
                     "e": _one("era")})
    chosen = ready.join(focus.select("id"), "id", "left_semi")
    pairs = (chosen.select(F.col("id").alias("focus_id"), F.explode(keys).alias("k"))
             .join(ready.select("id", F.explode(keys).alias("k")), "k")
             .filter("focus_id <> id").select("focus_id", "id").distinct())
    side = chosen.select(*[F.col(c).alias(f"f_{c}") for c in chosen.columns])
    df = pairs.join(side, F.col("focus_id") == F.col("f_id")).join(ready, "id")
    gap = F.least(F.abs(F.col("birth") - F.coalesce("f_death", "f_birth")),
                  F.abs(F.col("f_birth") - F.coalesce("death", "birth")))
    # In 150ths, so that the gap term stays exact.
    points = (600 * _shared("fields", "f_fields") + 450 * F.when(
        F.col("f_subfields").isNull(), 0).otherwise(_shared("subfields", "f_subfields"))
        + 300 * _shared("lens", "f_lens")
        + F.when(F.col("era") == F.col("f_era"), 300).otherwise(0) - F.least(gap, F.lit(600)))
    linked = edges.select(F.col("source").alias("focus_id"), F.col("target").alias("id")).union(
        edges.select("target", "source"))
    if rejected is not None:
        linked = linked.union(rejected.select("focus_id", "id")).union(
            rejected.select("id", "focus_id"))
    best = Window.partitionBy("focus_id").orderBy(F.desc("points"), "ord")
    return (df.withColumn("points", points).filter("points > 150")
            .join(linked.distinct(), ["focus_id", "id"], "left_anti")
            .withColumn("position", F.row_number().over(best)).filter(F.col("position") <= limit)
            .select("focus_id", F.col("id").alias("person_id"), "position",
                    (F.col("points") / F.lit(150.0)).alias("score"),
                    (F.col("points") >= 600).alias("high_confidence")))


def suggested_edges(pairs: DataFrame, people: DataFrame, edges: DataFrame) -> DataFrame:
    """New suggested edges of (a_id, b_id, reason): older person first, unlinked only."""
    side = lambda p: people.select(F.col("id").alias(f"{p}_id"),
                                   F.col("birth").alias(f"{p}_birth"))
    forward = F.col("a_birth") <= F.col("b_birth")
    linked = edges.select(F.least("source", "target").alias("low"),
                          F.greatest("source", "target").alias("high")).distinct()
    ends = pairs.join(side("a"), "a_id").join(side("b"), "b_id").select(
        F.when(forward, F.col("a_id")).otherwise(F.col("b_id")).alias("source"),
        F.when(forward, F.col("b_id")).otherwise(F.col("a_id")).alias("target"), "reason")
    fresh = ends.withColumns({"low": F.least("source", "target"),
                              "high": F.greatest("source", "target")}).join(
        linked, ["low", "high"], "left_anti").drop("low", "high")
    return fresh.select(
        "source", "target", F.lit("Suggested relationship").alias("type"),
        F.lit(2).alias("strength"), F.lit(0.35).alias("confidence"),
        F.lit("suggested").alias("status"), F.coalesce(
            F.nullif("reason", F.lit("")), F.lit("Added from Workbench candidate review."))
        .alias("note"))


# Registry property -> (order, other leads, type, strength, confidence).
REGISTRY_PROPERTIES = {
    "P184": (0, True, "Mentorship", 5, 0.95), "P185": (1, False, "Mentorship", 5, 0.95),
    "P802": (2, False, "Mentorship", 5, 0.95), "P737": (3, True, "Influence", 4, 0.9),
}


def registry_edges(statements: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges stated by registry properties between known people, first statement wins.

    ``statements(registry_id, ord, property, pos, related_id)``; ``ids(registry_id,
    person_id)``.
    """
    known = statements.filter(F.col("property").isin(list(REGISTRY_PROPERTIES)))
    pick = lambda i: F.create_map(*[x for p, v in REGISTRY_PROPERTIES.items()
                                    for x in (F.lit(p), F.lit(v[i]))])[F.col("property")]
    leads = pick(1)
    own = F.col("registry_id")
    rows = known.select(
        "property", own.alias("evidence_id"), F.when(leads, F.col("related_id")).otherwise(own)
        .alias("s"), F.when(leads, own).otherwise(F.col("related_id")).alias("t"),
        F.struct("ord", pick(0).alias("rank"), "pos").alias("order"), pick(2).alias("type"),
        pick(3).alias("strength"), pick(4).alias("confidence"))
    side = lambda c, name: ids.select(F.col("registry_id").alias(c),
                                      F.col("person_id").alias(name))
    named = rows.join(side("s", "source"), "s").join(side("t", "target"), "t").filter(
        "source <> target")
    first = named.groupBy("source", "target", "type").agg(F.min_by(F.struct(
        "property", "evidence_id", "strength", "confidence", "s", "t"), "order").alias("x"))
    prop = F.col("x.property")
    return first.select(
        "source", "target", "type", "x.strength", "x.confidence", prop.alias("property"),
        F.concat(F.lit("https://www.wikidata.org/wiki/"), "x.evidence_id").alias("source_url"),
        F.concat_ws(" ", F.col("x.evidence_id"), prop, F.when(
            prop.isin("P184", "P737"), F.col("x.s")).otherwise(F.col("x.t")))
        .alias("evidence_claim"), F.lit("suggested").alias("status"))


def is_supported_statement() -> Column:
    """Property, address and statement of a registry edge are well formed."""
    return (F.col("property").isin(list(REGISTRY_PROPERTIES))
            & F.col("source_url").rlike(r"^https://www\.wikidata\.org/wiki/Q\d+$")
            & F.col("evidence_claim").rlike(r"Q\d+ P(184|185|737|802) Q\d+"))


def decision_feed(queue: DataFrame, links: DataFrame, audit: DataFrame,
                  limit_each: int = 4, limit: int = 8) -> DataFrame:
    """First queue, suggestion and audit rows as automated decisions, in that order.

    ``queue(id, ord, label, confidence, birth, duplicate_id, threshold)``,
    ``links(id, ord, label, score)``, ``audit(id, ord, label, status, reason)``.
    """
    lane = lambda df, n: df.orderBy("ord").limit(limit_each).withColumn("lane", F.lit(n))
    held = F.col("confidence") < F.col("threshold")
    first = lane(queue, 0).select("lane", "ord", "label", F.when(
        F.col("duplicate_id").isNotNull(), "conflicting").when(
        F.col("birth").isNull(), "rejected").when(held, "held").otherwise("accepted")
        .alias("status"))
    second = lane(links, 1).select("lane", "ord", "label", F.when(
        F.col("score") >= 4, "accepted").otherwise("held").alias("status"))
    third = lane(audit, 2).select("lane", "ord", "label", F.when(
        F.col("status") == "accepted", "accepted").when(
        F.col("status") == "duplicate", "conflicting").when(
        F.col("status") == "skipped", "rejected").otherwise("held").alias("status"))
    return (first.unionByName(second).unionByName(third).orderBy("lane", "ord").limit(limit))
