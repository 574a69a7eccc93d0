"""Which of many texts hold which of many shorter ones, by equality of short grams.

Every pattern waits at one of its grams, the one that fewest texts hold; texts bring only
grams at which some pattern could wait. What meets is checked in full. A pattern with a gram
that no text holds is left out at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gram lengths: a pattern uses the longest that fits into it, texts those that are used.
GRAMS = [8, 4, 2, 1]


def _gram_length(text: str) -> Column:
    size = F.length(text)
    found = F.lit(GRAMS[-1])
    for n in reversed(GRAMS[:-1]):
        found = F.when(size >= n, n).otherwise(found)
    return found


def _grams(text: str) -> Column:
    """The distinct grams of length ``q`` of a text."""
    starts = F.sequence(F.lit(1), F.length(text) - F.col("q") + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substr(F.col(text), i, F.col("q"))))


def text_grams(texts: DataFrame, waiting: DataFrame) -> DataFrame:
    """(id, q, gram) of the texts, for grams that some pattern has."""
    used = waiting.select("q").distinct()
    sized = texts.select("id", "text", F.explode(F.array(*map(F.lit, GRAMS))).alias("q")).join(
        used, "q", "left_semi").filter(F.length("text") >= F.col("q"))
    return sized.select("id", "q", F.explode(_grams("text")).alias("gram")).join(
        waiting.select("q", "gram").distinct(), ["q", "gram"], "left_semi")


def contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, pattern) for every text(id, text) and every pattern(pattern) that it holds,
    equal ones included. Empty and null patterns and texts meet nobody; ids are unique.

    A text is a row per gram that any pattern has, never one per substring, and travels
    once; a pattern that a third of the texts hold gives just these pairs.
    """
    known = patterns.select("pattern").filter("pattern <> ''").distinct().withColumn(
        "q", _gram_length("pattern"))
    waiting = known.select("pattern", "q", F.explode(_grams("pattern")).alias("gram"))
    held = text_grams(texts.filter("text <> ''"), waiting)
    common = held.groupBy("q", "gram").agg(F.count(F.lit(1)).alias("texts"))
    anchors = waiting.join(common, ["q", "gram"], "left").groupBy("pattern", "q").agg(
        F.min_by("gram", F.struct("texts", "gram")).alias("gram"),
        F.every(F.col("texts").isNotNull()).alias("all")).filter("all")
    met = held.join(anchors.select("pattern", "q", "gram"), ["q", "gram"]).select("id", "pattern")
    return met.join(texts.select("id", "text"), "id").filter(
        F.contains("text", "pattern")).select("id", "pattern")
