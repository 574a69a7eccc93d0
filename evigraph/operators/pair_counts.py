"""How many candidate pairs the members of a shared group form, without listing a pair.

A group is a concept or a source, of any size. Its pairs are counted from what its members
have in common: members and the links between them for concepts, the sets of sections in
which a source names people for sources.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text as tx

#: Evidence that one person passed something on to another: no parallel development.
TRANSMISSION = ["explicit_influence", "advisor", "student"]
#: Sections of one person in a source up to which all their subsets are counted; people
#: with more are met through the sections they share, so any number is exact.
SUBSETS = 6


def concept_pairs(links: DataFrame) -> DataFrame:
    """Per concept its people, the pairs they form, those of them with a transmission link
    in either direction, and the pairs left as parallel developments.

    Linked pairs meet the memberships of both their ends; everything else is a count, so a
    concept shared by everyone is one row of sums. A person is a member once, however often
    the concept is stated; links to oneself or to nobody in the group do not count.
    """
    members = links.filter("kind = 'concept'").select("value", "person_id").distinct()
    linked = links.filter(F.col("kind").isin(TRANSMISSION) & (
        F.col("person_id") != F.col("value"))).select(
        F.least("person_id", "value").alias("a_id"),
        F.greatest("person_id", "value").alias("b_id")).distinct()
    inside = (linked.join(members.withColumnRenamed("person_id", "a_id"), "a_id")
              .join(members.withColumnRenamed("person_id", "b_id"), ["b_id", "value"])
              .groupBy("value").agg(F.count(F.lit(1)).alias("linked_pairs")))
    sizes = members.groupBy("value").agg(F.count(F.lit(1)).alias("members"))
    pairs = F.expr("members * (members - 1) div 2")
    return sizes.join(inside, "value", "left").withColumn(
        "linked_pairs", F.coalesce("linked_pairs", F.lit(0).cast("long"))).select(
        F.col("value").alias("concept"), "members", pairs.alias("shared_pairs"), "linked_pairs",
        (pairs - F.col("linked_pairs")).alias("pairs"))


def section_sets(links: DataFrame) -> DataFrame:
    """Per source and set of sections how many people it names in exactly these; a person
    named once without a section fits everyone (``known`` is false, no sections)."""
    named = links.filter("kind = 'source_context'").select(
        "value", "person_id", F.nullif("section", F.lit("")).alias("section")).distinct()
    sets = named.groupBy("value", "person_id").agg(
        F.every(F.col("section").isNotNull()).alias("known"),
        F.sort_array(F.collect_set("section")).alias("sections"))
    return sets.select("value", "known", F.when(F.col("known"), F.col("sections")).otherwise(
        F.array().cast("array<string>")).alias("sections")).groupBy(
        "value", "known", "sections").agg(F.count(F.lit(1)).alias("n"))


def _subsets(sections: str) -> Column:
    """All subsets of a sorted array but the empty one."""
    none = F.array(F.array().cast("array<string>"))
    every = F.aggregate(sections, none, lambda found, s: F.concat(
        found, F.transform(found, lambda t: F.concat(t, F.array(s)))))
    return F.filter(every, lambda t: F.size(t) > 0)


def source_pairs(links: DataFrame) -> DataFrame:
    """Per source its people, those named without a section, and the pairs it names in the
    same, or in an unknown, section.

    People of equal section sets are one row with a count. Pairs that share a section are
    counted by inclusion and exclusion over the subsets of these sets: every subset's
    people form their pairs, added for odd sizes and taken off for even ones. Sets of more
    than ``SUBSETS`` sections would have too many subsets; they meet the other sets, not
    people, through shared sections. A section of many people is one number throughout.
    """
    sets = section_sets(links)
    totals = sets.groupBy("value").agg(
        F.sum("n").alias("members"),
        F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("unplaced"))
    placed = sets.filter("known")
    narrow = placed.filter(F.size("sections") <= SUBSETS).select(
        "value", F.explode(_subsets("sections")).alias("subset"), "n").groupBy(
        "value", "subset").agg(F.sum("n").alias("n")).groupBy("value").agg(F.sum(
            F.expr("if(size(subset) % 2 = 1, 1, -1) * (n * (n - 1) div 2)")).alias("some"))
    wide = placed.filter(F.size("sections") > SUBSETS)
    same = wide.groupBy("value").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("some"))
    side = lambda df, p: df.select(
        "value", F.col("sections").alias(f"{p}_sections"), F.col("n").alias(f"{p}_n"),
        F.explode("sections").alias("section"))
    # Two wide sets meet in both directions: the lesser one counts.
    met = side(wide, "w").join(side(placed, "o"), ["value", "section"]).filter(
        (F.size("o_sections") <= SUBSETS) | (F.col("w_sections") < F.col("o_sections")))
    met = met.select("value", "w_sections", "o_sections", "w_n", "o_n").distinct().groupBy(
        "value").agg(F.sum(F.col("w_n") * F.col("o_n")).alias("some"))
    shared = reduce(DataFrame.unionByName, [narrow, same, met]).groupBy("value").agg(
        F.sum("some").alias("placed_pairs"))
    anyone = F.expr("unplaced * (members - unplaced) + unplaced * (unplaced - 1) div 2")
    return totals.join(shared, "value", "left").select(
        F.col("value").alias("source"), "members", "unplaced",
        (anyone + F.coalesce("placed_pairs", F.lit(0))).alias("pairs"))


def near_miss_counts(records: DataFrame, people: DataFrame) -> DataFrame:
    """Per birth year and surname the new records, the people they could be taken for, and
    the pairs these form. Names without a surname and unknown births are nobody's near miss;
    the pairs of chosen records are listed by ``linkage.near_misses``.
    """
    surname = F.element_at(F.split(tx.person_key(F.col("name")), " "), -1)

    def counted(df: DataFrame, name: str) -> DataFrame:
        named = df.select("birth", surname.alias("surname")).filter("surname <> ''")
        return named.groupBy("birth", "surname").agg(F.count(F.lit(1)).alias(name))

    return counted(records, "records").join(counted(people, "people"), ["birth", "surname"]
                                            ).withColumn("pairs", F.col("records") * F.col("people"))
