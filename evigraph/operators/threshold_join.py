"""Pairs of records whose shared signals can reach a score, met at their rarest signals.

A record is a list of weighted signals (a name, a year, an id). Signals get one order over
all records, rarest first, by the pairs they would make. Of each record those whose followers
could still reach the cutoff are keys: two records that share enough share one of them. A key
that would bring many together and whose own points do not suffice is not opened; it is made
longer by each later signal of its records, until it is rare or proves the score by itself.
So a common name, or a common name and year, brings nobody together before a third thing does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.session import cut_lineage

#: Pairs of one key that are cheaper to score than to tell apart. It changes no answer.
BLOCK_PAIRS = 1000


def _of_kind(values: dict[str, int]) -> Column:
    """The number that belongs to the row's kind."""
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])[F.col("kind")]


def _ordered(left: DataFrame, right: DataFrame, caps: dict[str, tuple[int, int]],
             cutoff: int) -> DataFrame:
    """(asks, id, kind, value, points, pos, reach) of the records that can reach the cutoff.

    ``reach`` is what a signal and all later ones of its record can give at most.
    """
    both = left.withColumn("asks", F.lit(True)).unionByName(
        right.withColumn("asks", F.lit(False))).distinct()
    # A signal of one side alone never scores.
    common = both.groupBy("kind", "value", "points").agg(
        F.count_if("asks").alias("l"), F.count_if(~F.col("asks")).alias("r")).filter(
        "l > 0 and r > 0").select("kind", "value", "points", (F.col("l") * F.col("r")).alias("n"))
    record = Window.partitionBy("asks", "id")
    later = record.orderBy(F.desc("pos"))
    same = Window.partitionBy("asks", "id", "kind").orderBy(F.desc("pos"))
    cap = _of_kind({kind: limit for kind, (_, limit) in caps.items()})
    total = F.sum("points").over(same)
    gained = F.least(cap, total) - F.least(cap, total - F.col("points"))
    return (both.join(common, ["kind", "value", "points"])
            .withColumn("pos", F.row_number().over(record.orderBy("n", "kind", "value", "points")))
            .withColumn("gained", gained)
            .withColumn("reach", F.sum("gained").over(later))
            .withColumn("best", F.max("reach").over(record)).filter(F.col("best") >= cutoff)
            .select("asks", "id", "kind", "value", "points", "pos", "reach"))


def _longer(keys: DataFrame, signals: DataFrame, most: Column, cutoff: int) -> DataFrame:
    """Each key with each later signal of its record that adds points and can still suffice."""
    tail = signals.select("asks", "id", "kind", "value", "reach", F.col("pos").alias("p"),
                          F.col("points").alias("added"))
    used = F.size(F.filter("kinds", lambda k: k == F.col("kind")))
    return (keys.join(tail, ["asks", "id"])
            .filter((F.col("p") > F.col("pos")) & (used < most)
                    & (F.col("points") + F.col("reach") >= cutoff))
            .select("asks", "id", F.xxhash64("key", "kind", "value", "added").alias("key"),
                    F.col("p").alias("pos"), F.array_append("kinds", F.col("kind")).alias("kinds"),
                    (F.col("points") + F.col("added")).alias("points")))


def sufficient_pairs(left: DataFrame, right: DataFrame, caps: dict[str, tuple[int, int]],
                     cutoff: int, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Distinct (l, r): every pair whose shared signals reach ``cutoff``, and some below it.

    ``left`` and ``right`` are (id, kind, value, points); ``caps`` gives per kind the number
    of signals that count and their greatest sum. Signals without id, kind or value count as
    absent. A key's hash may clash with another's, which adds pairs and loses none; callers
    score the pairs.
    """
    present = "id is not null and kind is not null and value is not null and points > 0"
    columns = ["id", "kind", "value", "points"]
    signals = cut_lineage(_ordered(left.filter(present).select(columns),
                                   right.filter(present).select(columns), caps, cutoff))
    most = _of_kind({kind: number for kind, (number, _) in caps.items()})
    keys = signals.filter(F.col("reach") >= cutoff).select(
        "asks", "id", F.xxhash64("kind", "value", "points").alias("key"), "pos",
        F.array("kind").alias("kinds"), "points")
    found = []
    while True:
        blocks = cut_lineage(keys.groupBy("key", "points").agg(
            F.count_if("asks").alias("l"), F.count_if(~F.col("asks")).alias("r")).filter(
            "l > 0 and r > 0").withColumn("open", (F.col("l") * F.col("r") <= block_pairs)
                                          | (F.col("points") >= cutoff)))
        met = keys.join(blocks.filter("open").select("key", "points"), ["key", "points"],
                        "left_semi")
        side = lambda asks, name: met.filter(F.col("asks") == asks).select(
            "key", "points", F.col("id").alias(name))
        found.append(side(True, "l").join(side(False, "r"), ["key", "points"]).select("l", "r"))
        closed = blocks.filter("not open")
        if closed.isEmpty():
            return reduce(DataFrame.union, found).distinct()
        rest = keys.join(closed.select("key", "points"), ["key", "points"], "left_semi")
        keys = cut_lineage(_longer(rest, signals, most, cutoff))
