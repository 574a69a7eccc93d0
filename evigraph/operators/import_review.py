"""The review queue of imports as a fold of its events, with an audit row per decision.

Events have one order, ``ord``, unique over all of them. An item enters the queue, stays
until the first event that takes it out, and its candidate may enter again afterwards. The
fold needs no state that walks from event to event: every entry finds the event that ends it
and the entry after that by looking for the next event of its key, and the entries that count
are those reached from each candidate's first: few are walked through as a list, those of a
candidate with many are found by jumps of doubled length.

Tables between the steps are narrow and are removed when the step after them is written.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import text as tx
from evigraph.session import Scratch, cut_lineage

#: Orders of one block of ``next_after``: a key's rows are sorted by no more than these at once.
ORDER_BLOCK = 1 << 16
#: Entries of a candidate that are walked through as one list. It changes no answer.
WALKED = 256
# Statuses and reasons that the audit states for each event.
REASONS = {
    "skip": ("skipped", "Skipped from review queue"),
    "merge": ("accepted", "Merged duplicate metadata into an existing thinker"),
    "accept": ("accepted", "Bulk accepted from review queue"),
    "clear_duplicates": ("duplicate", "Cleared duplicate candidates"),
    "clear_low": ("skipped", "Cleared below threshold"),
    "clear_all": ("skipped", "Cleared entire review queue"),
}
AUDIT_LENGTH = 100
LINK_STRENGTH, LINK_CONFIDENCE = 2, 0.35


def next_after(asked: DataFrame, events: DataFrame, keys: list[str], name: str,
               block: int = ORDER_BLOCK) -> DataFrame:
    """``asked`` with ``name``, the least ``ord`` of an event of its keys after its own.

    A key's rows are looked through block by block of their orders, so that a hot key is many
    groups; only the first event of each block is passed on to the blocks before it.
    """
    place = F.floor(F.col("ord") / F.lit(block)).alias("_block")
    marks = events.select(*keys, "ord", place, F.col("ord").alias("_at"))
    rows = asked.withColumn("_block", place).withColumn("_at", F.lit(None).cast("long"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    # Descending, an order's own events come after those who ask.
    inside = Window.partitionBy(*keys, "_block").orderBy(
        F.desc("ord"), F.col("_at").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_near", F.min("_at").over(inside)).filter("_at is null").drop("_at")
    blocks = both.groupBy(*keys, "_block").agg(F.min("_at").alias("_first"))
    beyond = Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(
        Window.unboundedPreceding, -1)
    far = blocks.withColumn("_far", F.min("_first").over(beyond)).drop("_first")
    return near.join(far, [*keys, "_block"], "left").withColumn(
        name, F.coalesce("_near", "_far")).drop("_near", "_far", "_block")


def _reached(rows: DataFrame, tables: Scratch) -> DataFrame:
    """The rows that are reached from a candidate's first by jumps along ``next``, which double
    in length."""
    marked = rows.groupBy("candidate_id").agg(F.min("ord").alias("ord"))
    jumps = rows.filter("next is not null").select("candidate_id", "ord", "next")
    before = None
    while True:
        step = Scratch(rows.sparkSession)
        marked, jumps = step.keep(marked), step.keep(jumps)
        if before is not None:
            before.remove()
        if jumps.isEmpty():
            reached = tables.keep(rows.join(marked, ["candidate_id", "ord"], "left_semi"))
            step.remove()
            return reached
        onward = marked.join(jumps, ["candidate_id", "ord"]).select(
            "candidate_id", F.col("next").alias("ord"))
        marked = marked.union(onward).distinct()
        second = jumps.select("candidate_id", F.col("ord").alias("next"),
                              F.col("next").alias("_next"))
        jumps = jumps.join(second, ["candidate_id", "next"]).select(
            "candidate_id", "ord", F.col("_next").alias("next"))
        before = step


def _walked(rows: DataFrame) -> DataFrame:
    """The rows that are reached from a candidate's first along ``next``, each candidate's as
    one list."""
    fields = [c for c in rows.columns if c not in ("candidate_id", "ord")]
    listed = rows.groupBy("candidate_id").agg(F.sort_array(F.collect_list(F.struct(
        "ord", *fields))).alias("rows"))
    met = F.aggregate("rows", F.array(F.element_at("rows", 1)["ord"]), lambda acc, x: F.when(
        F.array_contains(acc, x["ord"]), F.array_union(acc, F.array_compact(F.array(x["next"]))))
        .otherwise(acc))
    return listed.withColumn("met", met).select("candidate_id", F.inline(F.filter(
        "rows", lambda x: F.array_contains("met", x["ord"]))))


def _sweeps(clearing: DataFrame) -> DataFrame:
    """(level, doubled, ord) of clearings: once for every kind of item that they take out."""
    level = F.explode(F.sequence(F.lit(0), F.lit(100))).alias("level")
    doubled = F.explode(F.array(F.lit(False), F.lit(True))).alias("doubled")
    fits = (F.when(F.col("kind") == "clear_all", True)
            .when(F.col("kind") == "clear_duplicates", F.col("doubled"))
            .otherwise(F.col("level") < F.col("threshold")))
    return clearing.select("kind", "threshold", "ord", level).select("*", doubled).filter(
        fits).select("level", "doubled", "ord")


def _entries(queued: DataFrame, removals: DataFrame, sweeps: DataFrame, block: int,
             tables: Scratch) -> DataFrame:
    """Entries into the queue that count, with ``ended``, null for those still in it."""
    first, second, third = (Scratch(queued.sparkSession) for _ in range(3))
    own = first.keep(next_after(queued, removals, ["candidate_id"], "_own", block))
    swept = next_after(own, sweeps, ["level", "doubled"], "_swept", block)
    ended = second.keep(swept.withColumn("ended", F.least("_own", "_swept")).drop(
        "_own", "_swept"))
    first.remove()
    asked = ended.withColumns({"entered": F.col("ord"), "ord": F.col("ended")})
    rows = third.keep(next_after(asked, queued.select("candidate_id", "ord"), ["candidate_id"],
                                 "next", block).withColumn("ord", F.col("entered")).drop(
        "entered"))
    second.remove()
    many = third.keep(rows.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > WALKED).select("candidate_id"))
    entries = _walked(rows.join(many, "candidate_id", "left_anti")).select(*rows.columns)
    if not many.isEmpty():
        entries = entries.unionByName(_reached(third.keep(
            rows.join(many, "candidate_id", "left_semi")), third))
    entries = tables.keep(entries.drop("next"))
    third.remove()
    return entries


class ReviewFold:
    """The tables of a fold. ``queue`` and ``audit`` follow the entries of the accepted again,
    which is done when one of the two is first asked for."""

    def __init__(self, events: DataFrame, candidates: DataFrame, people: DataFrame, block: int):
        self.block, self.tables = block, Scratch(events.sparkSession)
        self.facts = candidates.select(
            F.col("id").alias("candidate_id"), "name", "birth",
            tx.name_key(F.col("name")).alias("key"),
            F.coalesce("wikipedia_url", "source_url").alias("source_url"))
        known = events.filter("ord is not null").select(
            F.col("ord").cast("long").alias("ord"), "kind", "candidate_id", "duplicate_id",
            "threshold", F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(
                "confidence", F.lit(0)))).cast("int").alias("level"),
            F.col("duplicate_id").isNotNull().alias("doubled"))
        self.clearing = self.tables.keep(known.filter(F.col("kind").startswith("clear_")).select(
            "kind", "threshold", "ord"))
        self.mine = self.tables.keep(known.filter(F.col("kind").isin(
            "queue", "skip", "merge", "accept")).drop("threshold").join(
            self.facts.select("candidate_id"), "candidate_id", "left_semi"))
        self.queued = self.mine.filter("kind = 'queue'").drop("kind")
        self.taken = self.mine.filter(F.col("kind").isin("skip", "merge")).select(
            "candidate_id", "ord", "kind")
        # Until a name is accepted none of its acceptances has changed the queue, so the first
        # one that meets its candidate there is the one that counts.
        self.before = self._entries(self.queued, self.taken)
        fresh = self.facts.filter("birth is not null").join(
            people.select(tx.name_key(F.col("name")).alias("key")).distinct(), "key", "left_anti")
        step = Scratch(events.sparkSession)
        asked = step.keep(self.mine.filter("kind = 'accept'").select("candidate_id", "ord").join(
            fresh.select("candidate_id", "key"), "candidate_id"))
        # The entry before an acceptance is the one that it meets, if it has not ended yet.
        turned = next_after(asked.withColumn("ord", -F.col("ord")), self.before.select(
            "candidate_id", (-F.col("ord")).alias("ord")), ["candidate_id"], "entered", block)
        met = turned.filter("entered is not null").select(
            "candidate_id", "key", (-F.col("ord")).alias("at"),
            (-F.col("entered")).alias("ord")).join(
            self.before.select("candidate_id", "ord", "ended"), ["candidate_id", "ord"]).filter(
            "ended is null or ended > at")
        self.accepted = cut_lineage(met.groupBy("key").agg(F.min_by("candidate_id", "at").alias(
            "candidate_id"), F.min("at").alias("ord")).select("candidate_id", "ord"))
        step.remove()

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    def remove(self) -> None:
        """Delete all tables but ``accepted``; the others cannot be read afterwards."""
        self.tables.remove()

    def _entries(self, queued: DataFrame, removals: DataFrame) -> DataFrame:
        return _entries(queued, removals, _sweeps(self.clearing), self.block, self.tables)

    @cached_property
    def removals(self) -> DataFrame:
        return self.taken.unionByName(self.accepted.withColumn("kind", F.lit("accept")))

    @cached_property
    def named(self) -> DataFrame:
        # Only the accepted ones' later entries can differ.
        accepted = self.accepted.select("candidate_id")
        again = self.queued.join(accepted, "candidate_id", "left_semi")
        entries = self.before.join(accepted, "candidate_id", "left_anti").unionByName(
            self._entries(again, self.removals))
        return entries.join(self.facts, "candidate_id")

    @property
    def audit(self) -> DataFrame:
        ending = self.removals.select("kind", "ord", F.lit(None).cast("int").alias(
            "threshold")).unionByName(self.clearing.select("kind", "ord", "threshold"))
        pick = lambda i: F.create_map(*[F.lit(x) for k, v in REASONS.items()
                                        for x in (k, v[i])])[F.col("kind")]
        return self.named.filter("ended is not null").drop("ord").withColumnRenamed(
            "ended", "ord").join(ending, "ord").select(
            "ord", "candidate_id", F.col("name").alias("candidate_name"),
            F.col("level").alias("confidence"), pick(0).alias("status"),
            pick(1).alias("reason"), "threshold", "source_url")

    @property
    def queue(self) -> DataFrame:
        return self.named.filter("ended is null").select(
            "ord", "candidate_id", F.col("name").alias("candidate_name"),
            F.col("level").alias("confidence"), "duplicate_id",
            F.when(F.col("doubled"), "duplicate").otherwise("queued").alias("status"))


def review_fold(events: DataFrame, candidates: DataFrame, people: DataFrame,
                block: int = ORDER_BLOCK) -> ReviewFold:
    """The tables ``queue``, ``audit`` and ``accepted`` after all events in their order.

    ``events`` are (ord, kind, candidate_id, confidence, duplicate_id, threshold): ``queue``
    enters a candidate who is not in the queue; ``skip`` and ``merge`` take theirs out;
    ``accept`` takes out a dated candidate whose name no person or earlier accepted one has,
    and leaves any other where he is; ``clear_duplicates``, ``clear_low`` (below ``threshold``)
    and ``clear_all`` take out whoever fits. Events of unknown candidates or kinds, and
    decisions on someone who is not in the queue, change nothing and leave no audit row.
    Confidence is an integer percentage, 0 if null.
    """
    return ReviewFold(events, candidates, people, block)


def newest(audit: DataFrame, limit: int = AUDIT_LENGTH) -> DataFrame:
    """The latest decisions, newest first, as a report shows them."""
    return audit.orderBy(F.desc("ord"), "candidate_id").limit(limit)


def accepted_links(accepted: DataFrame, suggestions: DataFrame, candidates: DataFrame,
                   people: DataFrame) -> DataFrame:
    """One suggested edge per accepted candidate: his best suggestion, older person first.

    ``accepted(candidate_id, new_id)``; ``suggestions`` with category, explanation and
    reasons, of which position 1 counts. A candidate without one gets no edge.
    """
    facts = candidates.select(
        F.col("id").alias("candidate_id"), F.col("birth").alias("c_birth"),
        F.coalesce("wikipedia_url", "source_url").alias("source_url"))
    best = suggestions.filter("position = 1").select(
        "candidate_id", "person_id", "category", "explanation", "reasons")
    df = accepted.join(best, "candidate_id").join(facts, "candidate_id").join(
        people.select(F.col("id").alias("person_id"), "birth"), "person_id")
    forward = F.col("birth") <= F.col("c_birth")
    why = F.coalesce(F.nullif(F.array_join("reasons", ", "), F.lit("")),
                     F.lit("nearby chronology"))
    return df.select(
        F.when(forward, F.col("person_id")).otherwise(F.col("new_id")).alias("source"),
        F.when(forward, F.col("new_id")).otherwise(F.col("person_id")).alias("target"),
        F.col("category").alias("type"), F.lit(LINK_STRENGTH).alias("strength"),
        F.lit(LINK_CONFIDENCE).alias("confidence"), F.lit("suggested").alias("status"),
        F.concat(F.lit("Imported with suggested context: "), "explanation", F.lit("; "), why)
        .alias("note"), F.array_compact(F.array("source_url")).alias("source_claims"))


def accepted_people(accepted: DataFrame, candidates: DataFrame, people: DataFrame) -> DataFrame:
    """(candidate_id, new_id, ord) of accepted candidates, ids unique and in order of acceptance."""
    from evigraph.operators.entities import unique_ids

    chosen = candidates.drop("ord").join(accepted.withColumnRenamed("candidate_id", "id"), "id")
    return unique_ids(chosen, people).select(
        F.col("id").alias("candidate_id"), F.col("person_id").alias("new_id"), "ord")
